"""Suffix-array dedup: bytes covered by a string that also starts elsewhere are cut out.

The suffixes of all documents are sorted by a distributed merge sort that knows common prefixes.  Only suffixes that
matter are sorted: of each 200-byte window the 50-byte gram with the lowest hash is its sample, equal windows have
equal samples, and grams that occur once are left out; samples in equal surroundings are repeated as a whole, and one of
them stands for all.  The others go to buckets by gram.  A task sorts its suffixes of a bucket
into a run and front-codes it (length of the prefix shared with the suffix before, then the rest).  A bucket's runs
are merged by a tree of losers over these lengths: two suffixes that share a known prefix with the last winner are
compared from there on, never again from the start.  The merged lengths are the suffix array's LCP table: windows that
start ``l`` bytes before their gram are equal where neighbours share ``200 - l`` bytes after it and the ``l`` before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import id_type
from tidegrid.llm.sampling_windows import MIX, SPREAD, rolled, samples, scrambled
from tidegrid.llm.substring_dedup import _sliced, stretches
from tidegrid.session import cut_lineage

SYMBOLS = scrambled(np.arange(1, 257, dtype=np.uint64))


def byte_symbols(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return raw, SYMBOLS[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([len(r) for r in raw], dtype=np.int64)


def shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that are known to share ``start`` bytes."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return start + len(x) - (differ.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Lengths shared with the string before, and the rests, of sorted strings."""
    lengths, rests, before = [], [], b""
    for s in strings:
        n = shared(before, s, 0)
        lengths.append(n)
        rests.append(s[n:])
        before = s
    return lengths, rests


def merge_runs(runs: list[tuple[list[int], list[bytes]]]):
    """Merge front-coded sorted runs: yields ``(run, place in it, string, length shared with the last one)``.

    A loser tree.  Every waiting string carries how much it shares with the last winner of the match it lost; a
    larger share wins a match without looking at the strings, equal shares are compared from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    text = [b""] * k  # current string of each run; None when the run is over
    place = [-1] * k
    lcp = [0] * k

    def advance(r):
        place[r] += 1
        if r >= len(runs) or place[r] >= len(runs[r][0]):
            text[r] = None
            return
        n = runs[r][0][place[r]]
        text[r] = text[r][:n] + runs[r][1][place[r]]
        lcp[r] = n  # what it shares with the string before it in its run, which was the last winner

    def play(a, b):
        """Winner and loser; the loser's share becomes the one with this winner."""
        if text[a] is None or text[b] is None:
            return (b, a) if text[a] is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = text[a], text[b]
        n = shared(x, y, lcp[a])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        w, o = (a, b) if first else (b, a)
        lcp[o] = n
        return w, o

    for r in range(k):
        advance(r)
    losers, front = [0] * k, list(range(k))
    level = k
    while level > 1:  # first round of matches
        level //= 2
        nxt = []
        for i in range(level):
            w, o = play(front[2 * i], front[2 * i + 1])
            losers[level + i] = o
            nxt.append(w)
        front = nxt
    winner = front[0]
    while text[winner] is not None:
        yield winner, place[winner], text[winner], lcp[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            w, o = play(winner, losers[node])
            losers[node], winner = o, w
            node //= 2


def _samples(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``gram, around, id, h, first, n, place``; ``around`` stands for all bytes of the sample's windows."""

    def run(batches):
        for batch in _sliced(batches):
            _, symbols, ends = byte_symbols(batch.column("text").to_pylist())
            g, text, first, n, place = samples(symbols, ends, window, gram)
            whole = rolled(symbols, window)
            at = first + np.concatenate([[0], ends[:-1]])[text] if len(text) else first
            around = scrambled(whole[at] * MIX + whole[at + n - 1] * SPREAD + n.astype(np.uint64)) if len(at) else g
            rows = pa.array(text, pa.int64())
            cols = [pa.array(g.view(np.int64)), pa.array(around.view(np.int64)), batch.column("id").take(rows), batch.column("h").take(rows), *(pa.array(v, pa.int32()) for v in (first, n, place))]
            yield pa.RecordBatch.from_arrays(cols, names=["gram", "around", "id", "h", "first", "n", "place"])

    return docs.mapInArrow(run, f"gram bigint, around bigint, id {id_type(docs, 'id')}, h int, first int, n int, place int")


RUN = "bucket int, lcp array<smallint>, rest array<binary>, before array<binary>, least array<smallint>, id array<{id}>, h array<int>, place array<int>"


def _runs(joined: DataFrame, window: int, buckets: int, most: int = 20000) -> DataFrame:
    """Sorted front-coded runs of the suffixes in ``few``, one row per task, bucket and at most ``most`` suffixes.

    ``least`` is how many bytes before its gram the last window of a suffix starts, ``before`` holds the bytes down
    to the first one.
    """
    kind = id_type(joined, "id")

    def run(batches):
        held, ids = [], None

        def flush():
            held.sort()
            at = 0
            while at < len(held):
                end = at
                while end < len(held) and held[end][0] == held[at][0]:
                    end += 1
                rows = held[at:end]
                lengths, rests = front_code([r[1] for r in rows])
                values = [held[at][0], lengths, rests, *([r[c] for r in rows] for c in (2, 3, 4, 5, 6))]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, ids)], names=names)
                at = end
            held.clear()

        names = [c.split(" ")[0] for c in RUN.split(", ")]
        for batch in _sliced(batches):
            ids = ids or [pa.int32(), pa.list_(pa.int16()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int16()), pa.list_(batch.schema.field("id").type), pa.list_(pa.int32()), pa.list_(pa.int32())]
            for doc, h, text, spots in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text", "few"))):
                raw = text.encode()
                for s in spots:
                    first, n, p = s["first"], s["n"], s["place"]
                    least = p - first - n + 1
                    held.append((s["gram"] % buckets, raw[p : p + window - least], raw[first:p], least, doc, h, p))
                if len(held) >= buckets * 400 or len(held) >= 200_000:
                    yield from flush()
        if held:
            yield from flush()

    return joined.filter(F.size("few") > 0).select("id", "h", "text", "few").mapInArrow(run, RUN.format(id=kind))


def repeated_levels(lcp: np.ndarray, before: list[bytes], least: np.ndarray, window: int) -> np.ndarray:
    """For sorted suffixes: whether the window ``l`` bytes before each one's gram occurs at two of them or more."""
    n = len(lcp)
    sizes = np.fromiter(map(len, before), np.int64, n)
    deep = int(sizes.max(initial=0))
    left = np.zeros((n, deep), np.uint8)
    for i, b in enumerate(before):
        left[i, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    found, key = np.zeros((n, deep + 1), bool), np.zeros(n, np.uint64)
    for back in range(deep + 1):
        if back:
            key = key * MIX + SYMBOLS[left[:, back - 1]]
        own = np.flatnonzero((least <= back) & (sizes >= back))
        if len(own) < 2:
            continue
        interval = np.cumsum(lcp < window - back).astype(np.uint64)
        k = scrambled(key[own] + interval[own] * SPREAD)
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        found[own[order[1:][same]], back] = True
        found[own[order[:-1][same]], back] = True
    return found


def _merged(runs: DataFrame, window: int, kind: str) -> DataFrame:
    """``id, h, first, n``: stretches of windows that the merged suffixes show to be repeated."""

    def merge(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        lcp, before, least, whose = [], [], [], []
        for r, at, _, n in merge_runs(list(zip(cols["lcp"], cols["rest"]))):
            lcp.append(n)
            before.append(cols["before"][r][at])
            least.append(cols["least"][r][at])
            whose.append((cols["id"][r][at], cols["h"][r][at], cols["place"][r][at]))
        found = repeated_levels(np.array(lcp), before, np.array(least), window)
        edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, a = np.nonzero(edges == 1)
        b = np.nonzero(edges == -1)[1]  # stretches of levels [a, b) of suffix i
        first = np.array([whose[j][2] for j in i], np.int64) - b + 1
        id_kind = table.schema.field("id").type.value_type
        arrays = [pa.array([whose[j][0] for j in i], id_kind), pa.array([whose[j][1] for j in i], pa.int32()), pa.array(first, pa.int32()), pa.array(b - a, pa.int32())]
        return pa.Table.from_arrays(arrays, names=["id", "h", "first", "n"])

    return runs.groupBy("bucket").applyInArrow(merge, f"id {kind}, h int, first int, n int")


def _windows(joined: DataFrame, window: int) -> DataFrame:
    """``node, check, id, h, first``: every window of the samples in ``many``, by hash."""

    def run(batches):
        for batch in _sliced(batches, 64):
            _, symbols, ends = byte_symbols(batch.column("text").to_pylist())
            starts = np.concatenate([[0], ends[:-1]])
            lists = batch.column("many")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            first, n = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            owner = np.repeat(owner, n)
            where, rows = starts[owner] + at, pa.array(owner)
            node, check = rolled(symbols, window)[where], rolled(symbols, window, SPREAD ^ MIX | np.uint64(1))[where]
            cols = [pa.array(node.view(np.int64)), pa.array((check >> np.uint64(33)).astype(np.int32)), batch.column("id").take(rows), batch.column("h").take(rows), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "check", "id", "h", "first"])

    picked = joined.filter(F.size("many") > 0).select("id", "h", "text", "many")
    return picked.mapInArrow(run, f"node bigint, check int, id {id_type(joined, 'id')}, h int, first int")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 50, group: int = 20_000, buckets: int | None = None) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept binary``: every whole text without its repeated bytes.

    A byte of a text in UTF-8 goes when a string of ``window`` bytes that covers it also starts anywhere else, in
    another document or in the same one; all places of it go.  Strings are judged on the input and never cross
    documents.  ``n_spans`` counts the maximal removed stretches; ``kept`` is the rest, which may cut characters.
    NULL and empty texts have no bytes.  Different texts with one id are different documents, and so are equal
    rows, which repeat each other.  Other columns are left out.

    Suffixes are compared byte by byte from their gram on, and by 64-bit hash before it; samples decided whole, by
    64 bits of gram and 64 of all their bytes.  ``group`` is how many
    samples a gram may have in a bucket; the windows of a gram with more are counted by hash, pre-aggregated.
    ``buckets`` bounds what one merge holds; by default it follows the number of partitions of the documents.
    """
    kind = id_type(df, id_col)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = docs.select("id", F.hash("text").alias("h"), "text")  # tells texts of one id apart
    buckets = buckets or max(16, 4 * docs.rdd.getNumPartitions())
    found = _samples(docs, window, gram)
    grams = found.groupBy("gram").count().filter("count > 1")
    joined = found.join(grams, "gram")
    # both uses of ``joined`` name all its columns, so that they share one exchange, and what is decided is kept by
    # document: samples are made twice, to count grams and to be judged.  Of samples with equal bytes around all are
    # cut (``whole``) and the first stands for all, if its gram has other surroundings too
    sample, own = F.struct("id", "h", "first", "place"), Window.partitionBy("gram")
    equal = Window.partitionBy("gram", "around")
    small = joined.filter(F.col("count") <= group)
    small = small.withColumns({"mixed": F.min("around").over(own) < F.max("around").over(own), "firsts": F.min(sample).over(equal), "copies": F.count("*").over(equal)})
    hot = joined.filter(F.col("count") > group).withColumn("n", F.when(F.col("around").isNotNull() & F.col("place").isNotNull(), F.col("n")))
    span, place = F.struct("first", "n"), F.struct("first", "n", "place", "gram")
    judged = small.select("id", "h", F.when(F.col("copies") > 1, span).alias("whole"), F.when(F.col("mixed") & (sample == F.col("firsts")), place).alias("few"))
    ranges = cut_lineage(
        judged.filter("whole IS NOT NULL OR few IS NOT NULL")
        .unionByName(hot.select("id", "h", span.alias("many")), allowMissingColumns=True)
        .groupBy("id", "h")
        .agg(*[F.collect_set(c).alias(c) for c in ("whole", "few", "many")])
        .withColumnsRenamed({"id": "rid", "h": "rh"})
    )
    same = F.col("id").eqNullSafe(F.col("rid")) & F.col("h").eqNullSafe(F.col("rh"))
    spots = docs.join(ranges.filter((F.size("few") > 0) | (F.size("many") > 0)).drop("whole"), same)
    few = _merged(_runs(spots, window, buckets), window, kind)
    many = _windows(spots, window)
    twice = many.groupBy("node", "check").count().filter("count > 1").drop("count")
    many = many.join(twice, ["node", "check"]).select("id", "h", "first", F.lit(1).alias("n"))
    alike = ranges.select(F.col("rid").alias("id"), F.col("rh").alias("h"), F.inline("whole"))
    cuts = alike.unionByName(few).unionByName(many)
    cuts = cuts.groupBy("id", "h").agg(F.collect_list(F.struct("first", "n")).alias("cuts")).withColumnsRenamed({"id": "rid", "h": "rh"})
    final = docs.join(cuts, same, "left").select("id", "text", "cuts")

    def run(batches):
        for batch in _sliced(batches):
            rows = []
            for t, c in zip(batch.column("text").to_pylist(), batch.column("cuts")):
                raw = t.encode()
                gone = np.zeros(len(raw), bool)
                if c.is_valid:
                    first, n = (c.values.field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
                    gone = stretches(len(raw), first, first + n + window - 1)
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            cols = [batch.column("id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return final.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)

