"""N-gram Jaccard join: groups of documents whose shingle sets are nearly alike.

Two sets that are alike enough share one of their first few shingles in any common order, so documents meet in
buckets by those ("prefix").  The order puts long shingles first, which are rare, and shingles found in very many
prefixes last.  Inside a bucket a signature tree prunes: leaves hold documents of similar size, every node the OR of
its documents' token bitmaps and its range of sizes, and a traversal of node pairs goes on only where the largest
overlap that bitmaps and sizes allow is enough.  What is left is compared exactly, shingle by shingle.

Copies are one set.  All texts are read once; later only those whose prefix holds a common shingle, and those that a
tree leaves.  A first round verifies as many likely pairs as link a bucket together; the traversal then looks only for
links between different components over short bitmaps.  Where these leave many pairs, the members go through trees
of exact sets, and only links that tie components leave the task: what is sent grows with the members, not their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import id_type
from tidegrid.llm.components import components
from tidegrid.llm.sampling_windows import MIX, SPREAD, scrambled
from tidegrid.llm.substring_dedup import _sliced
from tidegrid.session import cut_lineage

BITS = 512  # of a document's bitmap
LEAF = 16
WORDS = 1 << 20  # of bitmaps that a traversal compares at once
FEW = 1_000_000  # rows of a table that may be broadcast
ROWS = 20_000  # members a task compares at once
BLOCK = 20_000  # members of one shingle compared at once; more go by pairs of pieces
DENSE = 4  # pairs for each member of a unit that are sent as pairs
PIECE, HELD = 4_000, 4_000_000  # the same with whole sets: members, and shingles in all
NEXT = 6  # neighbours of a member in the first round
COMMON = 50_000  # at most so many shingles are set last


def shingles_of(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    """Distinct shingles of ``n`` words, A to Z in lower case; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class Sets:
    """Shingle sets of a batch of texts, as hashes laid end to end: per text distinct, in the common order."""

    def __init__(self, texts: list[str], n: int, common: np.ndarray):
        rows = [t.encode().lower().split() for t in texts]
        counts = np.array([len(r) for r in rows], np.int64)
        flat = np.array([w for r in rows for w in r], object)
        words = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(rows)), counts)
        h, length = words * MIX, sizes.copy()
        for j in range(1, min(n, len(h))):  # words after the end of a text count as nothing
            h[: len(h) - j] = np.where(text[j:] == text[: len(text) - j], h[: len(h) - j] * SPREAD + words[j:] * MIX, h[: len(h) - j])
            length[: len(h) - j] += np.where(text[j:] == text[: len(text) - j], sizes[j:], 0)
        first = np.cumsum(counts) - counts
        place = np.arange(len(h)) - first[text]
        full = (place <= counts[text] - n) | ((counts[text] < n) & (place == 0))
        h, length, text = scrambled(h[full]), length[full], text[full]
        late = np.isin(h, common)
        order = np.lexsort((h, -length, late, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.hashes, self.text = h[new], text[new]
        self.sizes = np.bincount(self.text, minlength=len(rows))
        self.starts = np.cumsum(self.sizes) - self.sizes
        key = np.zeros(len(rows), np.uint64)
        np.add.at(key, self.text, scrambled(self.hashes * SPREAD + np.uint64(3)))
        self.keys = scrambled(key + self.sizes.astype(np.uint64)).view(np.int64)  # the same for equal sets

    def prefix(self, percent: int) -> np.ndarray:
        """Places of the shingles of which similar sets share at least one."""
        own = np.arange(len(self.hashes)) - self.starts[self.text]
        n = self.sizes[self.text]
        return np.flatnonzero(own < n - (percent * n + 99) // 100 + 1)

    def bitmaps(self) -> list[bytes]:
        out = np.zeros((len(self.sizes), BITS), bool)
        out[self.text, (self.hashes >> np.uint64(17)) % np.uint64(BITS)] = True
        return [r.tobytes() for r in np.packbits(out, axis=1)]

    def wide_bitmaps(self) -> list[bytes | None]:
        """Bitmaps of 4 to 8 bits a shingle for the sets that fill the short ones."""
        out: list[bytes | None] = [None] * len(self.sizes)
        for i in np.flatnonzero(self.sizes > BITS).tolist():
            n = int(self.sizes[i])
            row = np.zeros(1 << (4 * n - 1).bit_length(), bool)
            row[(self.hashes[self.starts[i] : self.starts[i] + n] >> np.uint64(17)) % np.uint64(len(row))] = True
            out[i] = np.packbits(row).tobytes()
        return out


def wide_alike(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    """Whether two wide bitmaps of sets of ``nx`` and ``ny`` shingles allow them to be alike."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) != len(y):  # the longer one is folded
        x, y = (x[: len(x) // 2] | x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] | y[len(y) // 2 :])
    hidden = min(n - int(np.bitwise_count(v).sum()) for v, n in ((x, nx), (y, ny)))
    most = min(int(np.bitwise_count(x & y).sum()) + hidden, nx, ny)
    return (100 + percent) * most >= percent * (nx + ny)


def candidate_pairs(sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray, percent: int, units: np.ndarray | None = None) -> np.ndarray:
    """All pairs of ``candidate_chunks``."""
    return np.concatenate([np.zeros((0, 2), np.int64), *candidate_chunks(sizes, maps, groups, percent, units)])


def candidate_chunks(sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray, percent: int, units: np.ndarray | None = None, exact: bool = False) -> Iterator[np.ndarray]:
    """Pairs of members of one unit and different groups that can be alike, by dual traversal of signature trees.

    ``maps`` are bitmaps as rows of 64-bit words.  Every unit (all members if not given) has a tree of its own; the
    trees of a call are built and traversed level by level together.  Members are numbered in the order given.  Where
    the bitmaps are ``exact``, with a bit for every shingle that two members share, the pairs are alike.
    """
    units = np.zeros(len(sizes), np.int64) if units is None else units
    order = np.lexsort((sizes, units))
    sizes, maps, groups, unit = sizes[order], maps[order], groups[order], units[order]
    # levels of the trees, members first: OR of bitmaps, range of sizes, most members hidden behind one bit, group if one
    bits = np.bitwise_count(maps).sum(1).astype(np.int64)
    levels, children = [(maps, sizes, sizes, np.zeros_like(bits) if exact else sizes - bits, groups)], []
    trees = len(np.unique(unit))
    while len(unit) > trees:
        m, low, high, slack, g = levels[-1]
        opens = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        place = np.arange(len(unit)) - np.repeat(opens, np.diff(np.append(opens, len(unit))))
        cut = np.flatnonzero(place % LEAF == 0)
        one = np.where(np.minimum.reduceat(g, cut) == np.maximum.reduceat(g, cut), np.minimum.reduceat(g, cut), -1)
        children.append((cut, np.diff(np.append(cut, len(unit)))))
        levels.append((np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut), one))
        unit = unit[cut]
    if not children:
        return

    def possible(depth, x, y):
        m, low, high, slack, g = levels[depth]
        ok = ~((g[x] == g[y]) & (g[x] >= 0)) & (100 * np.minimum(high[x], high[y]) >= percent * np.maximum(low[x], low[y]))
        x, y = x[ok], y[ok]
        both = np.bitwise_count(m[x] & m[y]).sum(1).astype(np.int64)
        most = np.minimum(both + np.minimum(slack[x], slack[y]), np.minimum(high[x], high[y]))
        ok = (100 + percent) * most >= percent * (low[x] + low[y])
        return np.stack([x[ok], y[ok]], 1)

    top = np.arange(trees)
    pairs = possible(len(children), top, top)
    for depth in range(len(children) - 1, -1, -1):
        first, many = children[depth]
        found = [np.zeros((0, 2), np.int64)]
        step = max(1, WORDS // (LEAF * LEAF * maps.shape[1]))
        for at in range(0, len(pairs), step):  # children of both nodes
            x, y = pairs[at : at + step].T
            n = many[x] * many[y]
            which = np.repeat(np.arange(len(x)), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = first[x][which] + inside // many[y][which], first[y][which] + inside % many[y][which]
            ok = (i < j) if depth == 0 else (i <= j)
            if depth == 0:
                yield order[possible(depth, i[ok], j[ok])]
            else:
                found.append(possible(depth, i[ok], j[ok]))
        pairs = np.concatenate(found)


def _may_be_alike(x, y, sizes, maps, bits, percent: int) -> np.ndarray:
    """Whether sizes and bitmaps of members x and y allow them to be alike."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 15):
        i, j = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
        both = np.bitwise_count(maps[i] & maps[j]).sum(1).astype(np.int64)
        most = both + np.minimum(sizes[i] - bits[i], sizes[j] - bits[j])
        low = np.minimum(sizes[i], sizes[j])
        out[at : at + (1 << 15)] = ((100 + percent) * np.minimum(most, low) >= percent * (sizes[i] + sizes[j])) & (100 * low >= percent * np.maximum(sizes[i], sizes[j]))
    return out


def _spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs join two trees when taken in turn."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = []
    for i, j in zip(x.tolist(), y.tolist()):
        i, j = find(i), find(j)
        root[j] = i
        keep.append(i != j)
    return np.array(keep, bool)


def _arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def _likely_pairs(table: pa.Table, percent: int) -> pa.Table:
    """Pairs that can be alike of members and their next neighbours by size or the first of their unit, enough to link those."""
    k, n, unit = _arrays(table, "k", "n", "unit")
    order = np.lexsort((k, n, unit))
    k, n, unit = k[order], n[order], unit[order]
    maps = np.frombuffer(b"".join(table.column("bits").take(pa.array(order)).to_pylist()), np.uint64).reshape(len(k), -1)
    bits = np.bitwise_count(maps).sum(1).astype(np.int64)
    cut = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1 if len(unit) else 0, append=unit[-1] + 1 if len(unit) else 0))
    first = np.repeat(cut[:-1], np.diff(cut))
    xs, ys = [], []
    for step in range(NEXT + 1):
        i = np.flatnonzero(unit[:-step] == unit[step:]) if step else first
        j = i + step if step else np.arange(len(k))
        ok = k[i] != k[j]
        i, j = i[ok], j[ok]
        ok = _may_be_alike(i, j, n, maps, bits, percent)
        xs.append(i[ok])
        ys.append(j[ok])
    x, y = np.concatenate(xs), np.concatenate(ys)
    a, b = np.minimum(k[x], k[y]), np.maximum(k[x], k[y])
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    if len(pairs):
        names, ends = np.unique(pairs, return_inverse=True)
        ends = ends.reshape(pairs.shape)
        pairs = pairs[_spanning(ends[:, 0], ends[:, 1], len(names))]
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _met(table: pa.Table, percent: int) -> pa.Table:
    """What signature trees leave of the units: pairs ``k, other`` that can be alike and have different labels.

    Of a unit with more such pairs than DENSE for each member come rows ``unit, k, n, label`` of the members instead
    (``other`` is NULL).  Their ``unit`` is the smallest member that the pairs lead to, so that many shingles of a
    group of near copies give the same rows.
    """
    table = table.sort_by("k")
    k, n, label, unit = _arrays(table, "k", "n", "label", "unit")
    maps = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
    own = np.unique(unit, return_inverse=True)[1]
    most, found = DENSE * np.bincount(own), np.zeros(own.max() + 1 if len(own) else 0, np.int64)
    root, held = np.arange(len(n)), np.zeros((0, 2), np.int64)
    for pairs in candidate_chunks(n, maps, np.unique(label, return_inverse=True)[1], percent, unit):
        found += np.bincount(own[pairs[:, 0]], minlength=len(found))
        held = np.concatenate([held, pairs])
        held = held[(found <= most)[own[held[:, 0]]]]
        x, y = pairs.T
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
    ends = np.unique(np.sort(k[held], axis=1), axis=0)
    seen = (np.bincount(root, minlength=len(n))[root] > 1) & (found > most)[own]
    rows = np.unique(np.stack([k[root[seen]], k[seen], n[seen], label[seen]], 1), axis=0)
    first, none = [pa.array(rows[:, i], pa.int64()) for i in range(4)], pa.nulls(len(rows), pa.int64())
    second = [pa.nulls(len(ends), pa.int64()), pa.array(ends[:, 0], pa.int64()), *[pa.nulls(len(ends), pa.int64())] * 2]
    names = ["unit", "k", "n", "label", "other"]
    return pa.concat_tables([pa.table([*first, none], names=names), pa.table([*second, pa.array(ends[:, 1], pa.int64())], names=names)])


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links of members of one unit with different labels, enough to tie all labels that such links tie.

    The bitmaps of these trees have a bit for each shingle that two members of the unit share, so what the traversal
    leaves is alike.  Units go by the width of their bitmaps.
    """
    k, n, label, unit = _arrays(table, "k", "n", "label", "unit")
    names, group = np.unique(label, return_inverse=True)
    unit = np.unique(unit, return_inverse=True)[1]
    lists = table.column("hashes").combine_chunks()
    hashes, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(k)), counts)
    order = np.lexsort((hashes, unit[row]))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (unit[row[1:]] != unit[row[:-1]])
    which = np.cumsum(new) - 1
    shared = np.bincount(which)[which] > 1
    row, opens = row[shared], new[shared]
    number = np.cumsum(opens) - 1  # of a shared shingle; then its place among those of its unit
    own = np.bincount(unit[row[opens]], minlength=unit.max() + 1 if len(unit) else 0)
    place = number - (np.cumsum(own) - own)[unit[row]]
    words = 1 << np.ceil(np.log2(np.maximum(own / 64, 1))).astype(np.int64)

    root = np.arange(len(names))
    links = [np.zeros((0, 2), np.int64)]
    for width in np.unique(words[own > 0]).tolist():
        members = np.flatnonzero((words[unit] == width) & (own[unit] > 0))
        at = np.full(len(k), -1)
        at[members] = np.arange(len(members))
        mine = at[row] >= 0
        maps = np.zeros((len(members), width), np.uint64)
        np.bitwise_or.at(maps, (at[row[mine]], place[mine] >> 6), np.uint64(1) << (place[mine] & 63).astype(np.uint64))
        for pairs in candidate_chunks(n[members], maps, group[members], percent, unit[members], exact=True):
            pairs = members[pairs]
            x, y = root[group[pairs]].T
            pairs = pairs[x != y]
            keep = []
            for i, j in group[pairs].tolist():
                while root[i] != i:
                    i = root[i]
                while root[j] != j:
                    j = root[j]
                root[max(i, j)] = min(i, j)
                keep.append(i != j)
            links.append(pairs[np.array(keep, bool)])
            while (root[root] != root).any():
                root = root[root]
    ends = np.sort(k[np.concatenate(links)], axis=1)
    return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})


def _mapped(docs: DataFrame, n: int, common: np.ndarray, rows, schema: str) -> DataFrame:
    def run(batches):
        for batch in _sliced(batches):
            sets = Sets([t or "" for t in batch.column("text").to_pylist()], n, common)
            yield rows(batch, sets)

    return docs.mapInArrow(run, schema)


def _small(df: DataFrame) -> DataFrame:
    """The table marked for broadcast if its counted rows allow it; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= FEW else df


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are alike, compared shingle by shingle."""

    def run(batches):
        for batch in _sliced(batches, 64):
            known: dict[int, set] = {}
            ok = []
            for ka, kb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                x, y = (known.setdefault(k, s) if (s := known.get(k)) is not None else known.setdefault(k, shingles_of(t, n)) for k, t in ((ka, ta), (kb, tb)))
                ok.append(alike(len(x & y), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    sided = pairs.join(texts.withColumnsRenamed({"k": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"k": "b", "text": "text_b"}), "b")
    return sided.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, hot: int = 200) -> DataFrame:
    """``id_col, n_shingles, component_id``: the class of each document under links of similarity ``percent`` / 100.

    Two documents are linked when 100 * intersection >= percent * union of their sets of distinct ``n``-word shingles
    (letters A to Z in lower case; fewer words are one shingle).  ``component_id`` is the smallest id that links lead
    to.  NULL, empty and blank texts have no shingle and are alone.  Equal texts are in one class whatever their ids;
    a NULL id never names a class unless all its ids are NULL.  Every row gives one row; other columns are left out.

    ``hot`` is from how many prefixes on a shingle goes last in the order (more when over COMMON shingles would).
    """
    kind = id_type(df, id_col)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    none = np.zeros(0, np.uint64)

    def set_rows(batch, sets):
        at = sets.prefix(percent)
        ends = np.cumsum(np.bincount(sets.text[at], minlength=len(sets.sizes)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(sets.hashes[at].view(np.int64)))
        maps = [pa.array(m, pa.binary()) for m in (sets.bitmaps(), sets.wide_bitmaps())]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(sets.keys), pa.array(sets.sizes, pa.int64()), lists, *maps], names=["id", "h", "k", "n", "prefix", "bits", "wide"])

    # one pass over all texts; from here on copies are one set, whose row holds its prefix and bitmap
    every = cut_lineage(_mapped(docs, n, none, set_rows, f"id {kind}, h bigint, k bigint, n bigint, prefix array<bigint>, bits binary, wide binary"))
    keys = every.select("id", "k", "n")
    one = every.filter("n > 0").groupBy("k").agg(F.min(F.struct("id", "h")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", "wide")])
    one = cut_lineage(one.select("k", "n", F.col("rep.id").alias("rep"), F.col("rep.h").alias("rep_h"), "prefix", "bits", "wide"))
    bits = one.select("k", "bits")
    counts = one.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count()
    often = counts.filter(F.col("count") >= hot).orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    common = np.sort(np.array([r["shingle"] for r in often], np.int64).view(np.uint64))

    # putting the common shingles last changes no prefix without one of them; the others are made again
    def marked_rows(batches):
        for batch in batches:
            lists = batch.column("prefix")
            hits = np.cumsum(np.append(0, np.isin(lists.flatten().to_numpy().view(np.uint64), common)))
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            late = hits[ends[1:]] > hits[ends[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "rep_h", "k", "n", "prefix")), pa.array(late)], names=["rep", "rep_h", "k", "n", "prefix", "late"])

    def texts_of(wanted):
        """``k, text`` of the documents named by ``rep, rep_h``, once each."""
        named = docs.join(_small(wanted), F.col("id").eqNullSafe(F.col("rep")) & (F.coalesce("h", F.lit(0)) == F.coalesce("rep_h", F.lit(0))))
        return named.select("k", "text")

    def again_rows(batches):
        for batch in _sliced(batches):
            yield set_rows(batch, Sets([t or "" for t in batch.column("text").to_pylist()], n, common)).select(["k", "n", "prefix"])

    marked = one.select("rep", "rep_h", "k", "n", "prefix").mapInArrow(marked_rows, f"rep {kind}, rep_h bigint, k bigint, n bigint, prefix array<bigint>, late boolean")
    late = texts_of(marked.filter("late").select("rep", "rep_h", "k")).withColumns({"id": F.lit(None).cast(kind), "h": F.lit(0).cast("bigint")})
    again = late.mapInArrow(again_rows, "k bigint, n bigint, prefix array<bigint>").dropDuplicates(["k"])
    prefixes = marked.filter("not late").select("k", "n", "prefix").unionByName(cut_lineage(again))
    rows = prefixes.select(F.explode("prefix").alias("shingle"), "k", "n")

    # members: sets that share a shingle of their prefixes with another one of a size that allows a link
    shared = rows.groupBy("shingle").count().filter("count > 1")
    met = rows.join(shared.select("shingle"), "shingle")
    step = math.log(100 / percent) * 1.000001  # linked sets are in the same band or in neighbours
    band = F.floor(F.log("n") / step) if step else F.col("n")
    cells = met.withColumn("cell", F.explode(F.array(band, band + 1)))
    alive = cells.groupBy("shingle", "cell").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").select("shingle", "cell")
    members = cells.join(alive, ["shingle", "cell"]).groupBy("shingle", "k", "n").agg(F.lit(1).alias("one")).drop("one")
    members = cut_lineage(members)
    groups = max(64, members.count() // ROWS)

    def dealt(rows: DataFrame, key: str, block: int, held: int | None = None) -> DataFrame:
        """``unit`` of each row: its ``key``, or one for each pair of pieces of a key with over ``block`` members or ``held`` shingles."""
        least = F.count("*") / block
        least = least if held is None else F.greatest(least, F.sum("n") / held)
        large = rows.groupBy(key).agg(F.ceil(least).alias("pieces")).filter("pieces > 1")
        marked = rows.join(_small(large), key, "left").withColumn("piece", F.pmod(F.xxhash64("k"), "pieces"))
        marked = marked.withColumn("other", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))))
        unit = F.when(F.col("pieces").isNull(), F.col(key)).otherwise(F.xxhash64(key, F.least("piece", "other"), F.greatest("piece", "other")))
        return marked.select(unit.alias("unit"), "k", "n", "label")

    def by_units(rows: DataFrame, buckets: int):
        return rows.groupBy(F.pmod(F.xxhash64("unit"), F.lit(buckets)).alias("bucket"))

    def wide_rows(batches):
        for batch in batches:
            maps = zip(*(batch.column(c).to_pylist() for c in ("wide_a", "wide_b", "n_a", "n_b")))
            ok = [x is None or y is None or wide_alike(x, y, nx, ny, percent) for x, y, nx, ny in maps]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(found: DataFrame) -> DataFrame:
        """Links among the pairs; only texts in a pair that wide bitmaps allow are read."""
        met = one.join(_small(found.select(F.explode(F.array("a", "b")).alias("k")).distinct()), "k")
        sides = [met.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab"]
        found = cut_lineage(found.join(sides[0], "a").join(sides[1], "b").mapInArrow(wide_rows, "a bigint, b bigint"))
        ends = found.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(one.select("k", "rep", "rep_h"), "k")
        return cut_lineage(_verified(found, texts_of(ends).groupBy("k").agg(F.first("text").alias("text")), n, percent))

    # first round: of the likely links of a bucket's span one for each set
    large = members.groupBy("shingle").count().filter(F.col("count") > BLOCK).select("shingle", F.ceil(F.col("count") / BLOCK).alias("pieces"))
    pieces = members.join(_small(large), "shingle", "left")
    unit = F.when(F.col("pieces").isNull(), F.col("shingle")).otherwise(F.xxhash64("shingle", F.pmod(F.xxhash64("k"), "pieces")))
    near = by_units(pieces.select(unit.alias("unit"), "k", "n").join(bits, "k"), groups)
    tried = near.applyInArrow(lambda t: _likely_pairs(t, percent), "a bigint, b bigint").groupBy("b").agg(F.min("a").alias("a"))
    links = verified(cut_lineage(tried.select("a", "b")))
    label = components(links)

    # second: signature trees find the pairs of every shingle that can be alike and belong to two components; for
    # shingles with many, trees of the exact sets find the links, and only those that tie components leave the task
    grouped = members.join(label.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    mixed = grouped.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    open_rows = dealt(grouped.join(mixed, "shingle"), "shingle", BLOCK).join(bits, "k")
    met = cut_lineage(by_units(open_rows, groups).applyInArrow(lambda t: _met(t, percent), "unit bigint, k bigint, n bigint, label bigint, other bigint").distinct())
    dense = met.filter("other IS NULL").drop("other")
    if not dense.isEmpty():

        def hash_rows(batches):
            for batch in _sliced(batches):
                sets = Sets([t or "" for t in batch.column("text").to_pylist()], n, none)
                lists = pa.ListArray.from_arrays(pa.array(np.append(sets.starts, len(sets.hashes)), pa.int32()), pa.array(sets.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("k"), lists], names=["k", "hashes"])

        named = dense.select("k").distinct().join(one.select("k", "rep", "rep_h"), "k")
        hashes = texts_of(named).mapInArrow(hash_rows, "k bigint, hashes array<bigint>").dropDuplicates(["k"])
        units = cut_lineage(dealt(dense, "unit", PIECE, HELD))
        buckets = max(64, (units.agg(F.sum("n")).first()[0] or 0) // HELD)
        tied = by_units(units.join(hashes, "k"), buckets).applyInArrow(lambda t: _linked(t, percent), "a bigint, b bigint")
        links = links.unionByName(verified(cut_lineage(tied.distinct())))
        label = components(links)

    def apart(rows: DataFrame) -> DataFrame:
        """The pairs between two components ``x, y``."""
        a, b = (label.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        sided = rows.join(a, "a", "left").join(b, "b", "left")
        sided = sided.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")).filter("x != y")
        return sided.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    more = met.filter("other IS NOT NULL").select(F.col("k").alias("a"), F.col("other").alias("b"))
    if not more.isEmpty():  # one pair for each two components, then the pairs that are still between two
        tried = cut_lineage(apart(more).groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
        links = links.unionByName(verified(tried))
        label = components(links)
        left = cut_lineage(apart(more).select("a", "b").join(tried, ["a", "b"], "left_anti"))
        if not left.isEmpty():
            links = links.unionByName(verified(left))
            label = components(links)

    classed = keys.join(label.withColumnRenamed("node", "k"), "k", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("label", "k")))
    smallest = classed.filter("n > 0").groupBy("class").agg(F.min("id").alias("component"))
    return classed.join(smallest, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
