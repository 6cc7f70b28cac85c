"""Secret scans: patterns of credentials, and random strings found by their token efficiency.

Ordinary words are few tokens under a BPE vocabulary, random strings are many.  A run of key characters whose
characters per token fall below a limit is reported as ``random`` unless it is a digest or a name of parts that are
short or above the limit each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.llm.bpe import vocabulary_path
from tidegrid.llm.common import id_type, per_document

# fixed values: the base patterns
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# what is no secret though it looks random: digests in hex (MD5, SHA-1, SHA-2), UUIDs, dates and plain numbers
KNOWN = r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_+=/-]+)"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
NAME = r"[/_-]*[A-Za-z]+(?:[/_-]+[A-Za-z]+)+[/_-]*"
SHORT = 3  # letters of a name's part that is not counted: x, id, src
KINDS = ("assign", "access", "hex", "random")


def token_counter(path: str):
    """Number of tokens of a string under a rank file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(coder.encode_ordinary(s))


def finder(path: str, most_chars_per_token: float):
    """Function from a text to its spans ``(start, kind number, end)`` in order."""
    assign, access, hexes = (re.compile(p, re.ASCII) for p in (ASSIGN, ACCESS, HEX))
    run, known, name = re.compile(RUN), re.compile(KNOWN), re.compile(NAME)
    count = token_counter(path)

    def dense(s: str) -> bool:
        return len(s) < most_chars_per_token * count(s)

    def named(s: str) -> bool:
        return bool(name.fullmatch(s)) and not any(len(p) > SHORT and dense(p) for p in re.split("[/_-]+", s))

    def find(text: str) -> list[tuple[int, int, int]]:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in access.finditer(text)] if "AKIA" in text else []
        spans += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        base = list(spans)
        for m in run.finditer(text):
            s, a, b = m[0], m.start(), m.end()
            if known.fullmatch(s) or any(x < b and a < y for x, _, y in base):
                continue
            if dense(s) and not named(s):
                spans.append((a, 3, b))
        return sorted(spans)

    return find


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most_chars_per_token: float = 2.0) -> DataFrame:
    """Secrets of every whole text: ``id_col, spans array<struct<kind, start, end>>`` by start, then kind.

    Base spans (kinds ``assign``, ``access``, ``hex``) are the leftmost non-overlapping matches of the fixed patterns;
    ``random`` spans are added where no base span lies.  Offsets are code points, the end is exclusive.  NULL and
    empty texts have an empty array; every row gives one row; other columns are left out.  No shuffle; runs of key
    characters are counted whole, and time is linear in the text but for the library's own merging of one run.
    """
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")

    def make():
        find = finder(path, most_chars_per_token)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

        def work(texts):
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in texts]
            return {"spans": (rows, pa.list_(kind))}

        return work

    return per_document(df, make, f"`{id_col}` {id_type(df, id_col)}, spans array<struct<kind:string,start:int,end:int>>", [text_col, id_col])
