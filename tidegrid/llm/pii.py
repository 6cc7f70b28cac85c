"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

The tagger reads overlapping windows.  Every kind holds a digit or an at sign, so only windows with one of them can
have spans and only those are scored.  Each window is decoded; each character takes its tag from the window in which
it lies most centrally, and spans are read from the stitched tags of the whole text, so none is cut or found twice.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import tagger
from tidegrid.llm.common import id_type, per_document

# fixed values: the kinds in order, and the base patterns
KINDS = ("email", "ip", "card", "phone")
DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LOCAL = r"[A-Za-z0-9._%+-]"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

WINDOW, STEP = 64, 32
# tags: 0 outside, then first and inner characters of each kind
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_finder():
    """Function from a text to its base spans ``(kind number, start, end)`` by kind, then start."""
    local, domain, ip, card, phone, digits = map(re.compile, (LOCAL, DOMAIN, IP, CARD, PHONE, r"[^0-9]"))

    def find(text: str) -> list[tuple[int, int, int]]:
        out, done = [], 0
        at = text.find("@")
        while at >= 0:
            a = at
            while a > done and local.match(text, a - 1):
                a -= 1
            m = domain.match(text, at) if a < at else None
            if m:
                out.append((0, a, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
        for m in ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in card.finditer(text):
            d = digits.sub("", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in phone.finditer(text):
                if 8 <= len(digits.sub("", m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
        return out

    return find


class Model(NamedTuple):
    params: dict[str, np.ndarray]


def _invented(rng) -> tuple[int, str]:
    """A made-up piece of personal data of a random kind, in forms the patterns know and others."""
    word = lambda a, b: "".join(rng.choice(list("abcdefghijklmnoprstuvwxyz"), rng.integers(a, b)))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    kind = int(rng.integers(4))
    if kind == 0:
        sep = str(rng.choice([".", "_", "-", "", "."]))
        return 0, word(2, 9) + sep + word(1, 9) + (number(2) if rng.random() < 0.4 else "") + "@" + word(2, 9) + (number(1) if rng.random() < 0.3 else "") + "." + ("example." if rng.random() < 0.4 else "") + str(rng.choice(["com", "org", "net", "de", "fr"]))
    if kind == 1:
        return 1, ".".join(str(int(n)) for n in rng.integers(0, 256, 4))
    if kind == 2:
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = str(rng.choice(["", " ", "-"]))
        return 2, sep.join(d[i : i + 4] for i in range(0, 16, 4))
    if rng.random() < 0.6:
        sep = str(rng.choice([" ", "-", "."]))
        return 3, "+" + number(int(rng.integers(1, 3))) + sep + sep.join([number(3), number(3), number(4)])
    return 3, f"({number(3)}) {number(3)}-{number(4)}"


def _harmless(rng) -> str:
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = (number(rng.integers(1, 7)), f"{2000 + rng.integers(30)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(24)}:{rng.integers(60):02d}", f"{rng.integers(9)}.{rng.integers(20)}.{rng.integers(9)}", f"{number(2)},{number(2)}", "@" + number(2), number(9), f"{number(3)}-{number(2)}", "".join(rng.choice(list("0123456789abcdef"), 32)))
    return str(forms[rng.integers(len(forms))])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 400, pieces: int = 4000, seed: int = 11) -> Model:
    """Train the tagger on labelled windows.

    Surroundings are taken from at most ``sample_docs`` texts (those with the smallest hash of their id), at random
    places of the whole text; labelled spans are their base spans and made-up data put between them.  ``pieces`` is
    the number of training windows.  An empty table leaves blank surroundings.
    """
    find = base_finder()
    width = 3 * WINDOW

    def cut(batches):
        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = np.random.default_rng(abs(doc) % 2**32)
                spans = find(t or "")
                starts = [max(0, a - int(rng.integers(WINDOW))) for _, a, _ in spans[:4]] + [int(rng.integers(max(1, len(t or "") - width))) for _ in range(4)]
                out += [t[a : a + width] for a in starts] if t else []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["piece"])

    docs = df.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    chosen = [r["h"] for r in docs.select("h").orderBy("h").limit(sample_docs).collect()]
    found = docs.filter(F.col("h").isin(chosen)).limit(4 * sample_docs).mapInArrow(cut, "piece string").collect() if chosen else []
    around = sorted({r["piece"] for r in found}) or [" "]
    rng, table = np.random.default_rng(seed), tagger.symbol_table()
    symbols, tags = np.full((pieces, WINDOW), 97, np.uint8), np.zeros((pieces, WINDOW), np.int64)
    for row in range(pieces):
        text = around[row % len(around)]
        for _ in range(int(rng.integers(3))):
            at = int(rng.integers(len(text) + 1))
            if rng.random() < 0.6:
                at = max(text.rfind(" ", 0, at + 1), 0)
            new = _invented(rng)[1] if rng.random() < 0.6 else _harmless(rng)
            text = text[:at] + " " + new + str(rng.choice([" ", ". ", ", ", "\n"])) + text[at:]
        marks = np.zeros(len(text), np.int64)
        for k, a, b in [*_local_phones(text), *find(text)]:
            marks[a:b], marks[a] = 2 * k + 2, 2 * k + 1
        hits = np.flatnonzero(marks)
        a = max(0, int(hits[rng.integers(len(hits))]) - int(rng.integers(WINDOW))) if len(hits) and rng.random() < 0.8 else int(rng.integers(max(1, len(text) - WINDOW)))
        code = table[np.frombuffer(text[a : a + WINDOW].encode("utf-32-le"), np.uint32)]
        symbols[row, : len(code)], tags[row, : len(code)] = code, marks[a : a + WINDOW]
    return Model(tagger.train(symbols, tags, TAGS)[0])


def _local_phones(text: str) -> list[tuple[int, int, int]]:
    return [(3, m.start(), m.end()) for m in re.finditer(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", text)]


def _credible(kind: int, s: str) -> bool:
    """Whether an added span has what its kind needs."""
    digits = sum(c in "0123456789" for c in s)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]*\w", s) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(?:[.: ]+[0-9]{1,3}){3}", s) is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    if kind == 2:
        return 13 <= digits <= 19 and luhn(re.sub("[^0-9]", "", s))
    return 7 <= digits <= 15 and re.search("[A-Za-z]", s) is None


def added_spans(texts: list[str], model: Model, table: np.ndarray, batch: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Spans of the tagger in each text, by start."""
    where, rows, codes = [], [], []
    trigger = re.compile("[0-9@]")
    for i, t in enumerate(texts):
        hits = sorted({s for m in trigger.finditer(t) for s in (m.start() // STEP, m.start() // STEP - 1) if s >= 0})
        code = table[np.frombuffer(t.encode("utf-32-le"), np.uint32)] if hits else None
        codes.append(code)
        where += [(i, s) for s in hits]
    tags: dict[int, np.ndarray] = {}
    central: dict[int, np.ndarray] = {}
    weight = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1
    for at in range(0, len(where), batch):
        own = where[at : at + batch]
        rows = np.full((len(own), WINDOW), 97, np.uint8)
        for r, (i, s) in enumerate(own):
            c = codes[i][s * STEP : s * STEP + WINDOW]
            rows[r, : len(c)] = c
        for (i, s), path in zip(own, tagger.decode(tagger.scores(model.params, rows), model.params["T"])):
            if i not in tags:
                tags[i], central[i] = np.zeros(len(codes[i]) + WINDOW, np.int16), np.zeros(len(codes[i]) + WINDOW, np.int16)
            a = s * STEP
            better = weight > central[i][a : a + WINDOW]
            tags[i][a : a + WINDOW][better] = path[better]
            central[i][a : a + WINDOW][better] = weight[better]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, path in tags.items():
        path = path[: len(codes[i])]
        kind = (path + 1) // 2 - 1
        cuts = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | (path % 2 == 1))
        for a, b in zip(cuts, [*cuts[1:], len(path)]):
            if kind[a] >= 0 and _credible(int(kind[a]), texts[i][a:b]):
                out[i].append((int(kind[a]), int(a), int(b)))
    return out


def all_spans(texts: list[str], find, model: Model, table: np.ndarray):
    """Per text ``(kind, start, end, added)`` by kind, then start; added spans never touch a base span."""
    for t, extra in zip(texts, added_spans(texts, model, table)):
        base = find(t)
        new = [(k, a, b, True) for k, a, b in extra if not any(x < b and a < y for _, x, y in base)]
        yield sorted([*[(*s, False) for s in base], *new])


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<kind, start, end, added>>`` of every whole text, by kind as listed, then start.

    Offsets are code points, the end is exclusive.  NULL and empty texts have an empty array; repeated rows give a
    row each; other columns are left out.  No shuffle; time is linear in the text.
    """

    def make():
        base, table = base_finder(), tagger.symbol_table()

        def work(texts):
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "added": n} for k, a, b, n in spans] for spans in all_spans(texts, base, model, table)]
            return {"spans": (rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])))}

        return work

    return per_document(df, make, f"`{id_col}` {id_type(df, id_col)}, spans array<struct<kind:string,start:int,end:int,added:boolean>>", [text_col, id_col])


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with every span of ``text_col`` replaced by its kind in angle brackets; NULL stays NULL.

    Where spans of two kinds overlap, their union is replaced under the kind that starts first.
    """
    names = df.columns

    def run(batches):
        base, table = base_finder(), tagger.symbol_table()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(names.index(text_col)).to_pylist()
                out = []
                for t, spans in zip(texts, all_spans([t or "" for t in texts], base, model, table)):
                    done, parts = 0, []
                    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            parts += [t[done:a], f"<{KINDS[k].upper()}>"]
                        done = max(done, b)
                    out.append(t if t is None else "".join(parts) + t[done:])
                arrays = [pa.array(out, pa.string()) if n == text_col else batch.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, df.schema)
