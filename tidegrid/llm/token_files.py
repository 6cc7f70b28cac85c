"""Token-id files: fixed-size blocks of ids as compressed planes, with a chunk index.

Format ("planes 1").  A data set is a Parquet table of chunks, so that any file system Spark knows can hold it; a
shard is the chunks of one range of documents.  The ids of a shard's documents, each followed by the end id, form one
stream, cut every ``block`` ids.  A chunk holds its ids as unsigned 32-bit numbers, transposed into planes (plane k has
byte k of every id, or with ``unit="bit"`` bit k of every id, eight to a byte), each compressed with zstandard;
planes above the highest one in use are left out.  The columns around the planes are the chunk's index entry:

``shard, chunk``            place in the data set
``n_ids, first``            ids in the chunk; ids of the shard before it
``doc_ids, sizes, pieces``  the documents in the chunk, how many of its ids are theirs, and which piece of them it is
``last``                    whether the piece ends its document
``unit, planes``            kind of planes; the planes
"""

from __future__ import annotations

import gc
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.bpe import vocabulary_path
from tidegrid.llm.common import id_type, ordered_ranges

LEVEL = 1
MOST_WORDS = 400_000
SLICE = 1 << 23


def _slices(batch: pa.RecordBatch):
    """The batch in parts of about SLICE bytes of text: words are told apart once for each part."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if unit == "byte":
        return [pack(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range((top.bit_length() + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [pack(np.packbits(bits[:, k], bitorder="little").tobytes()) for k in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, unit: str = "byte") -> np.ndarray:
    """Inverse of ``to_planes``."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    raw = np.zeros((n, 4), np.uint8)
    if unit == "byte":
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(unpack(p), np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(unpack(p), np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


def _word_encoder(path: str):
    """Encodes texts with the tokenizers library, as 32-bit numbers; each distinct word once.

    A tokenizer that drops white space cuts there before it merges, so the ids of a text are those of its words in
    turn.  One that keeps spaces in its tokens (a probe tells) gets whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()

    ends_word = np.array([t.endswith("</w>") for t, _ in sorted(tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])])

    def single(words):
        """The same for words of letters, many in one text: each ends at its only token that ends a word."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            groups = [part[i : i + 64] for i in range(0, len(part), 64)]
            for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                cuts = (np.flatnonzero(ends_word[ids]) * 4 + 4).tolist()
                data = ids.tobytes()
                yield from [data[a:b] for a, b in zip([0, *cuts], cuts)] if len(cuts) == len(group) else plain(group)

    def plain(texts):
        for at in range(0, len(texts), 4096):
            yield from (array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False))

    probe = "one two"
    if list(plain([probe])) != [b"".join(plain(probe.split(" ")))]:
        return lambda texts: list(plain(texts))
    one_case = list(plain(["Two"])) == list(plain(["two"]))
    # a stop after a letter from A to Z is a piece of its own
    stops = all(list(plain([w + s])) == [b"".join(plain([w, s]))] for w in ("one", "ONE", "3a", "x-a") for s in ".,")
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    normalizer = tokenizer.normalizer

    def cut(texts):
        """Words of each text; white space is a cut."""
        if one_case:  # special tokens are the only strings in which case counts
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # A to Z only
        texts = pc.replace_substring(texts, "\n", " ")
        if stops:
            texts = pc.replace_substring_regex(texts, "([A-Za-z])([.,])( |$)", r"\1 \2\3")
        return pc.split_pattern(texts, " ")

    def own_stop(word):
        """Whether the stop after a letter is a piece of its own; it joins a mark that normalising takes off the letter."""
        return word.isascii() or normalizer is None or normalizer.normalize_str(word)[-2:-1].isalpha()

    def unknown(words):
        """Words in neither store; those of the older one go to the younger."""
        absent = set(words).difference(known)
        new = absent.difference(older)
        known.update((w, older[w]) for w in absent.difference(new))
        return new

    def learn(words):
        nonlocal known, older
        if len(known) > MOST_WORDS // 2:  # words that come again stay, others are forgotten
            known, older = {}, known
        words = unknown(words)
        stems = {w: w[:-1] for w in words if w[-1:] in (".", ",") and w[:-1].isalpha() and own_stop(w)}
        new = unknown([*words.difference(stems), *stems.values(), ".", ","]) if stems else words
        simple = [w for w in new if w.isalpha()]
        known.update(zip(simple, single(simple)))
        rest = [w for w in new if not w.isalpha()]
        known.update(zip(rest, plain(rest)))
        for w, stem in stems.items():
            known[w] = known[stem] + known[w[-1]]

    def by_word(texts):
        rows = cut(pa.array(texts, pa.large_string()))
        words = rows.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        learn(names)
        ids = pa.array(list(map(known.__getitem__, names)), pa.large_binary()).take(words.indices)
        _, places, data = ids.buffers()
        ends = np.frombuffer(places, np.int64)[rows.offsets.to_numpy()].tolist()
        data = b"" if data is None else data.to_pybytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    return by_word


_ENCODERS: dict[str, Callable] = {}  # a worker keeps its words from task to task


def _encoder(path: str) -> Callable:
    if path not in _ENCODERS:
        _ENCODERS[path] = _word_encoder(path)
    return _ENCODERS[path]


SCHEMA = "shard int, chunk int, n_ids int, first bigint, doc_ids array<{id}>, sizes array<int>, pieces array<int>, last array<boolean>, unit string, planes array<binary>"


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 1, block: int = 65536, unit: str = "byte") -> None:
    """Encode whole texts and write the ids in ascending order of ``id_col`` (ties by a hash of the text) to a new ``folder``.

    NULL and empty texts have only the end id; rows with a NULL id come first; repeated rows are written each.
    Documents are dealt to shards by ranges of (id, hash), so a shard is bounded whatever the ids are, and a shard
    is written by one task, chunk by chunk.  Only texts are shuffled, once.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    kind = id_type(df, id_col)

    def run(batches):
        from pyspark import TaskContext

        gc.disable()  # the store of words holds no cycles and is costly to walk
        encode, shard = _encoder(path), TaskContext.get().partitionId()
        chunk, first, held, docs = 0, 0, [], []  # docs: [id, size, piece, last] of the block in hand
        room = block

        def flush():
            nonlocal chunk, first, held, docs, room
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            row = [shard, chunk, len(ids), first, *([d[k] for d in docs] for k in range(4)), unit, to_planes(ids, unit)]
            chunk, first, held, docs, room = chunk + 1, first + len(ids), [], [], block
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        types = None
        for whole in batches:
            types = types or [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(whole.schema.field("id").type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.string(), pa.list_(pa.binary())]
            for batch in _slices(whole):
                rows = encode([t or "" for t in batch.column("text").to_pylist()])
                for doc, row in zip(batch.column("id").to_pylist(), rows):
                    ids = np.frombuffer(row, np.uint32)
                    ids = ids if end_id is None else np.append(ids, np.uint32(end_id))
                    piece = 0
                    while len(ids) > room:
                        held.append(ids[:room])
                        docs.append([doc, room, piece, False])
                        ids, piece = ids[room:], piece + 1
                        yield flush()
                    held.append(ids)
                    docs.append([doc, len(ids), piece, True])
                    room -= len(ids)
                    if room == 0:
                        yield flush()
        if docs:
            yield flush()

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Spark samples the keys on the driver to find the ranges, so a key must be small
    ordered_ranges(rows.withColumn("h", F.xxhash64("text")), "id", "h").drop("h").mapInArrow(run, SCHEMA.format(id=kind)).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a data set: ``doc_id, start`` (ids before it), ``n_tokens, ids`` (little-endian unsigned 32-bit).

    Chunks are decoded where they lie; only documents that go over a chunk's border are shuffled to be joined.
    """
    table = spark.read.parquet(folder)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, chunk, n, first, docs, sizes, pieces, last, unit, planes = (batch.column(k)[i].as_py() for k in range(10))
                data = from_planes(planes, n, unit).tobytes()
                ends = np.cumsum([0, *sizes])
                m = len(docs)
                cols = [pa.array([shard] * m, pa.int32()), pa.array([chunk - p for chunk, p in zip([chunk] * m, pieces)], pa.int32()), pa.array(docs, batch.schema.field("doc_ids").type.value_type)]
                cols += [pa.array(first + ends[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(pieces, pa.int32()), pa.array(last, pa.bool_()), pa.array([data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "opened", "doc_id", "start", "n", "piece", "last", "ids"])

    pieces = table.mapInArrow(run, f"shard int, opened int, doc_id {kind}, start bigint, n bigint, piece int, last boolean, ids binary")
    complete = F.col("last") & (F.col("piece") == 0)
    whole = pieces.filter(complete).select("shard", "doc_id", "start", F.col("n").alias("n_tokens"), "ids")
    # a document that goes over a border is the last one of the chunk where it opened
    split = (
        pieces.filter(~complete)
        .groupBy("shard", "opened")
        .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
        .select("shard", "doc_id", "start", "n_tokens", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row per shard
    before, at = [], 0
    for row in sorted(totals):
        before.append((row["shard"], at))
        at += row["n"]
    offsets = spark.createDataFrame(before, "shard int, before bigint")
    return whole.unionByName(split).join(F.broadcast(offsets), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
