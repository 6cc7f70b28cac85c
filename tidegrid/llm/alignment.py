"""Alignment of two tokenizers over the same bytes: a byte-level one (A) and a sentence-piece one (B).

Every token is a run of bytes of space + text.  One ``merge_asof`` in each direction, keyed by document, finds for each
token's start the other side's token that covers it; the union of both directions is all overlapping pairs.  Offsets at
which tokens of both sides end cut a text into groups.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.bpe import vocabulary_path
from tidegrid.llm.common import id_type
from tidegrid.llm.packed import pack, unpack
from tidegrid.session import cut_lineage

A_FILE, B_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SLICE = 2 << 20  # bytes of text aligned at once
MOST_WORDS = 250_000
# neither tokenizer has a token over such a space: a token holds spaces at its start only
BREAK = re.compile(r"(?<=\S) (?=\S)")


def _byte_ranks(path: str):
    """The byte-level tokenizer without special tokens: their texts are plain text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def _piece_bytes(piece: str) -> bytes:
    own = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(own[1], 16)]) if own else piece.replace("▁", " ").encode()


class Aligned:
    """Tokens of some documents one after another, and how they meet.

    ``a, b`` ids; ``doc_a, doc_b`` documents; ``group_a, group_b`` groups; ``link_a, link_b`` places of overlapping tokens.
    """

    def __init__(self, a, b, doc_a, doc_b, size_a, size_b):
        import pandas as pd

        self.a, self.b, self.doc_a, self.doc_b = a, b, doc_a, doc_b
        # offsets run on from document to document, so they ascend
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        left = pd.DataFrame({"doc": doc_a, "at": start_a, "place": np.arange(len(a))})
        right = pd.DataFrame({"doc": doc_b, "at": start_b, "place": np.arange(len(b))})
        over_a = pd.merge_asof(left[["doc", "at"]], right, on="at", by="doc")["place"].to_numpy().astype(np.int64)
        over_b = pd.merge_asof(right[["doc", "at"]], left, on="at", by="doc")["place"].to_numpy().astype(np.int64)
        opens_a, opens_b = start_b[over_a] == start_a, start_a[over_b] == start_b
        # tokens that start together are found from both sides
        late = np.flatnonzero(~opens_b)
        self.link_a = np.concatenate([np.arange(len(a)), over_b[late]])
        self.link_b = np.concatenate([over_a, late])
        self.group_a, self.group_b = np.cumsum(opens_a) - 1, np.cumsum(opens_b) - 1


class Aligner:
    """Both tokenizers, with the tokens of words already seen, up to a fixed number of them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.bytewise, ranks = _byte_ranks(a_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size_a[i] = len(token)
        self.bytes_b = [_piece_bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.differ: set[str] = set()  # words whose bytes B does not give back
        top = max(len(self.size_a), len(self.size_b))
        self.written = np.array([b"%d%c" % (i, sign) for sign in b",|;" for i in range(top)], object)
        self.top = top

    def learn(self, words: list[str]) -> None:
        """Tokens of new words: those without spaces at their ends as texts of many words, cut by bytes; the others one by one."""
        plain = [w for w in words if not (w[0].isspace() or w[-1].isspace())]
        alone = [w for w in words if w[0].isspace() or w[-1].isspace()]
        for at in range(0, len(plain), 2048):
            part = plain[at : at + 2048]
            text = " " + " ".join(part)
            a, b = np.array(self.bytewise.encode_ordinary(text), np.int32), self.pieces.encode(text[1:])
            if b"".join([self.bytes_b[i] for i in b]) != text.encode():
                alone += part
                continue
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            b = np.array(b, np.int32)
            self.known_a.update(zip(part, self._cut(a, self.size_a, ends)))
            self.known_b.update(zip(part, self._cut(b, self.size_b, ends)))
        for word in alone:
            a, b = self.bytewise.encode_ordinary(" " + word), self.pieces.encode(word)
            self.known_a[word], self.known_b[word] = np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()
            if b"".join([self.bytes_b[i] for i in b]) != b" " + word.encode():
                self.differ.add(word)

    @staticmethod
    def _cut(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Tokens up to each end, as 32-bit numbers."""
        data = ids.tobytes()
        cuts = ((np.searchsorted(np.cumsum(sizes[ids]), ends) + 1) * 4).tolist()
        return [data[x:y] for x, y in zip([0, *cuts], cuts)]

    def align(self, texts: list[str]) -> Aligned:
        rows = [BREAK.split(t) if t else [] for t in texts]
        words = {w for r in rows for w in r}
        new = words.difference(self.known_a)
        if len(self.known_a) + len(new) > MOST_WORDS:  # the words of one slice are always held
            self.known_a, self.known_b, self.differ, new = {}, {}, set(), words
        self.learn(list(new))
        if self.differ:
            rows = [r if self.differ.isdisjoint(r) else [] for r in rows]
        a, b = ([b"".join([known[w] for w in r]) for r in rows] for known in (self.known_a, self.known_b))
        number = np.arange(len(texts))
        doc_a, doc_b = (np.repeat(number, [len(x) // 4 for x in side]) for side in (a, b))
        a, b = (np.frombuffer(b"".join(side), np.int32) for side in (a, b))
        return Aligned(a, b, doc_a, doc_b, self.size_a[a], self.size_b[b])

    def groups(self, al: Aligned, n: int) -> list[bytes]:
        """Of each of ``n`` documents its groups as ``a1,a2|b1;a3|b2,b3``."""
        counts_a, counts_b = np.bincount(al.group_a), np.bincount(al.group_b)
        end_a, end_b = np.cumsum(counts_a), np.cumsum(counts_b)
        sign = np.zeros(len(al.a) + len(al.b), np.int64)
        at_a = np.arange(len(al.a)) + (end_b - counts_b)[al.group_a]
        at_b = np.arange(len(al.b)) + end_a[al.group_b]
        sign[at_a] = al.a
        sign[at_b] = al.b
        sign[at_a[end_a - 1]] += self.top
        sign[at_b[end_b - 1]] += 2 * self.top
        written = self.written[sign].tolist()
        ends = np.cumsum(np.bincount(al.doc_a, minlength=n) + np.bincount(al.doc_b, minlength=n)).tolist()
        return [b"".join(written[x:y])[:-1] for x, y in zip([0, *ends], ends)]


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)


_ALIGNERS: dict[tuple, Aligner] = {}  # a worker keeps its tokenizers and words from task to task


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _slices(batches) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, about ``SLICE`` bytes at a time; a longer text goes alone."""
    for whole in batches:
        ids, texts = whole.column("id"), whole.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0)
        start, size = 0, 0
        for i, n in enumerate(sizes.to_pylist()):
            if i > start and size + n > SLICE:
                yield ids.slice(start, i - start), [t or "" for t in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if whole.num_rows > start:
            yield ids.slice(start), [t or "" for t in texts.slice(start).to_pylist()]


def _input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, groups`` of every row, without a shuffle.

    ``groups`` is text, ``a1,a2|b1;a3|b2,b3``: in each group the ids of A, then those of B.  Texts that are NULL or empty,
    or whose bytes a tokenizer does not give back, have no tokens: zeros and ``""``.  Repeated rows give a row each; other
    columns are left out.
    """
    paths = _paths(a_path, b_path)

    def run(batches):
        for ids, texts in _slices(batches):
            aligner = _aligner(paths)
            al = aligner.align(texts)
            groups = [g.decode() for g in aligner.groups(al, len(texts))]
            columns = [ids, *[pa.array(c, pa.int64()) for c in _figures(al, len(texts))], pa.array(groups, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "groups"])

    return _input(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(df, id_col)}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string")


def _figures(al: Aligned, n: int) -> list[np.ndarray]:
    """Per document: tokens of A and of B, groups, links."""
    count = lambda docs: np.bincount(docs, minlength=n)
    opens = np.flatnonzero(np.diff(al.group_a, prepend=-1))
    return [count(al.doc_a), count(al.doc_b), count(al.doc_a[opens]), count(al.doc_a[al.link_a])]


BLOCKS = "block bigint, ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, pairs array<bigint>, docs array<bigint>, kinds binary, pair_at binary, times binary"


def link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A pair of ids counts the documents (rows) of the whole table in which tokens of these ids overlap.  ``count_sum`` adds
    the counts of all links of a document; ``n_best`` are the links whose count is the highest of their A id, ties
    included.  Documents without tokens (see ``align``) have zeros and ``""``; an empty table gives no rows.

    Each slice of documents sends its distinct pairs once and gets their counts back, so what is shuffled follows the
    distinct pairs of slices, and no key holds more than a row a slice.  An A id has no more pairs than B has ids, which
    bounds the window over it.
    """
    paths = _paths(a_path, b_path)
    kind = id_type(df, id_col)

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_slices(batches)):
            n = len(texts)
            aligner = _aligner(paths)
            al = aligner.align(texts)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in aligner.groups(al, n)]
            code, pairs = pd.factorize(al.a[al.link_a].astype(np.int64) << 32 | al.b[al.link_b])
            place, distinct = pd.factorize(al.doc_a[al.link_a] * max(len(pairs), 1) + code)
            order = np.argsort(distinct)
            times = np.bincount(place, minlength=len(distinct))[order]
            docs, at = np.divmod(distinct[order], max(len(pairs), 1))
            one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, t))
            row = [
                pa.array([part << 32 | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([ids])),
                *[one(c, pa.int64()) for c in _figures(al, n)],
                one(digests, pa.string()),
                one(pairs, pa.int64()),
                one(np.bincount(at, minlength=len(pairs)), pa.int64()),
                *[pa.array([pack(x)], pa.binary()) for x in (np.bincount(docs, minlength=n), at, times)],
            ]
            yield pa.RecordBatch.from_arrays(row, names=[c.split(" ")[0] for c in BLOCKS.split(", ")])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the blocks are read three times, and are all that has to be kept of the texts
    blocks = cut_lineage(_input(df, id_col, text_col).mapInArrow(run, BLOCKS.format(id=kind)).repartition(parts, "block"))
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(of_a))
    told = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("told"))
    full = blocks.drop("pairs", "docs").join(told, "block", "left").select("*", F.col("told.n").alias("n"), F.col("told.best").alias("best")).drop("told")

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = row["ids"].values
                kinds, at, times = (unpack(row[c].as_py()).astype(np.int64) for c in ("kinds", "pair_at", "times"))
                n, best = (np.array(row[c].values) if row[c].is_valid else np.zeros(0, np.int64) for c in ("n", "best"))
                owner = np.repeat(np.arange(len(ids)), kinds)
                # 128 bits are not needed: a sum of counts is below links x documents
                sums = np.zeros(len(ids), np.int64)
                np.add.at(sums, owner, times * n[at])
                tops = np.zeros(len(ids), np.int64)
                np.add.at(tops, owner, times * best[at].astype(np.int64))
                columns = [ids, *[row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(tops), pa.array(sums), row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return full.mapInArrow(finish, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
