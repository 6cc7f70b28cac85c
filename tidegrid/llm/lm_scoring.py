"""Scores of whole texts under a probabilistic suffix tree over words.

A state of the tree is a context of up to ``depth`` preceding words.  Its next-symbol distribution is smoothed by that of
the longest kept suffix of the context, down to add-one counts of single tokens:

    P(x | s) = (count(s x) + strength * P(x | parent of s)) / (count(s) + strength)

A context is kept if its parent is, if it occurs ``least`` times and if it passes a divergence test: the sum over its
occurrences of log2 P(x | s) / P(x | parent), each taken without the occurrence itself, reaches ``bits``.  Of
three words or more it is only tried if it was also without its last word, as its count comes from there.  A token is
scored in the longest kept context before it.

Counts cover all training documents.  Documents are held as blocks of about ``BLOCK`` tokens; counts and gains of all
contexts are added up over all blocks by key (``packed``), level by level, and go back to the blocks that hold them, so
neither the driver nor a broadcast ever holds the tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import id_type
from tidegrid.llm.packed import ROWS, mix, of_kind, pack, pack_sorted, per_block, send, totals, unpack, unpack_sorted

BLOCK = 1 << 20
UNIT = 1 << 8  # gains are added as whole numbers of this fraction of a bit, so that their order does not count
COUNTS, GRAMS, GAINS = 0, 1, 2  # kinds of keys: tokens, contexts with their next token, contexts


def held_out(id_col: str = "doc_id") -> Column:
    """Documents not learnt from; a NULL id is learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 7 == 2, F.lit(False))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in turn, A to Z in lower case, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    owner = owner[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(owner, minlength=len(texts))


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in words), np.uint64, len(words))


END = np.uint64(0x5D1B9E0C2F4A7361)  # stands for the end of a text; words have hashes of their own


class Tokens:
    """The tokens of a block: ``vocabulary`` ascending hashes, ``at`` their places, one end token after each text."""

    def __init__(self, vocabulary: np.ndarray, at: np.ndarray, sizes: np.ndarray, learnt: np.ndarray):
        self.vocabulary, self.at, self.sizes = vocabulary, at, sizes
        self.first = np.cumsum(sizes) - sizes
        self.learnt = np.repeat(learnt, sizes)
        self.opens = np.zeros(len(at), bool)  # first tokens of texts
        self.opens[self.first] = True

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Sizes, vocabulary and tokens; frequent words get low numbers, which pack better."""
        often = np.bincount(self.at, minlength=len(self.vocabulary))
        order = np.argsort(-np.frexp(often.astype(float))[1], kind="stable")  # by powers of two, so that hashes still ascend in runs
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return pack(self.sizes), pack_sorted(self.vocabulary[order]), pack(number[self.at])

    @classmethod
    def unpacked(cls, sizes: bytes, vocabulary: bytes, places: bytes, learnt: np.ndarray) -> Tokens:
        hashes = unpack_sorted(vocabulary)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return cls(hashes[order], place[unpack(places).astype(np.int64)], unpack(sizes).astype(np.int64), learnt)

    @classmethod
    def of(cls, texts: list[pa.Array], learnt: np.ndarray) -> Tokens:
        parts = [split_words(t) for t in texts]
        counts = np.concatenate([n for _, n in parts])
        coded = pa.chunked_array([w for w, _ in parts], pa.string()).combine_chunks().dictionary_encode()
        hashes = _hashes(coded.dictionary)
        vocabulary, place = np.unique(np.append(hashes, END), return_inverse=True)
        sizes = counts + 1
        at = np.full(int(sizes.sum()), place[-1], np.int32)
        ends = np.zeros(len(at), bool)
        ends[np.cumsum(sizes) - 1] = True
        at[~ends] = place[:-1][coded.indices.to_numpy()]
        return cls(vocabulary, at, sizes, learnt)


def local_ids(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each element among the distinct ones, and the distinct ones."""
    import pandas as pd

    return pd.factorize(pairs)


class Level:
    """Contexts of one length in a block with their next tokens.

    ``where`` are the tokens that have such a context, ``context`` and ``gram`` the places of their context and of context
    plus token among ``keys`` of the level before and of this one (ascending).  Contexts are candidates only where their
    suffix is kept (``kept``, by token) and they occur ``least`` times.
    """

    counts: np.ndarray | None = None  # of all learnt documents

    def __init__(self, tokens: Tokens, before: Level | None = None, kept: np.ndarray | None = None, least: int = 0):
        if before is None:  # single tokens
            self.where = np.arange(len(tokens.at), dtype=np.int32)
            self.gram, self.keys = tokens.at, tokens.vocabulary
            return
        # the context of a token is what the token before it ends at the level before
        next_to = before.where + 1
        inside = next_to < len(tokens.at)
        inside[inside] = ~tokens.opens[next_to[inside]]
        if kept is not None:
            inside[inside] = kept[next_to[inside]]
        if before.counts is not None:
            inside &= before.counts[before.gram] >= least
        self.where, self.context = next_to[inside], before.gram[inside]
        number, pairs = local_ids(self.context.astype(np.int64) << 32 | tokens.at[self.where])
        keys = mix(before.keys[pairs >> 32], tokens.vocabulary[pairs & 0xFFFFFFFF])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.keys, self.gram = keys[order], place[number]

    def own(self, tokens: Tokens) -> np.ndarray:
        """Counts of the keys in the learnt documents of the block."""
        return np.bincount(self.gram[tokens.learnt[self.where]], minlength=len(self.keys))


class Tree:
    """What is known of a block's part of the tree after some rounds, and what the next round asks for.

    The first round brings the counts of single tokens and of contexts of one word; from then on the rounds bring in
    turn the gains of the contexts of a length, which decide what is kept, and the counts of those one word longer.
    """

    def __init__(self, tokens: Tokens, rounds: list, n: int, v: int, depth: int, least: int, strength: float, bits: float):
        base = Level(tokens)
        level = Level(tokens, base) if depth else None
        self.asks: list[tuple[int, np.ndarray, np.ndarray]] = []
        if not rounds:
            self.asks = [(COUNTS, base.keys, base.own(tokens))] + ([(GRAMS, level.keys, level.own(tokens))] if depth else [])
            return
        base.counts = self._counts(rounds[0], COUNTS, base)
        known = base.counts[base.gram]
        self.known = known > 0
        self.base = np.log2((known + 1.0) / (n + v + 1.0))
        self.best = self.base.copy()  # log2 P of each token in its longest kept context so far
        before = base
        for d in range(1, depth + 1):
            if 2 * d - 2 == len(rounds):
                self.asks = [(GRAMS, level.keys, level.own(tokens))]
                return
            level.counts = self._counts(rounds[2 * d - 2], GRAMS, level)
            often = before.counts[level.context] >= least
            where, context, gram = level.where[often], level.context[often], level.gram[often]
            total, c = before.counts[context], level.counts[gram]
            parent = np.exp2(self.best[where])
            used = np.zeros(len(before.keys), bool)
            used[context] = True
            if 2 * d - 1 == len(rounds):
                use = tokens.learnt[where]
                one = (c[use] - 1 + strength * parent[use]) / (total[use] - 1 + strength)
                bit = np.rint((np.log2(one) - self.best[where[use]]) * UNIT)
                gains = np.bincount(context[use], bit, len(before.keys)).astype(np.int64)
                self.asks = [(GAINS, before.keys[used], gains[used])]
                return
            stays = np.zeros(len(before.keys), bool)
            stays[used] = of_kind(rounds[2 * d - 1], GAINS) >= bits * UNIT
            on = stays[context]
            kept = np.zeros(len(tokens.at), bool)
            kept[where[on]] = True
            self.best[where[on]] = np.log2((c[on] + strength * parent[on]) / (total[on] + strength))
            if d < depth:
                before, level = level, Level(tokens, level, kept, least)

    @staticmethod
    def _counts(parts: list, kind: int, level: Level) -> np.ndarray:
        counts = of_kind(parts, kind)
        if len(counts) != len(level.keys):
            raise RuntimeError("a block was made anew with other rows: write the input to a table first")
        return counts


PAYLOAD = "block bigint, ids array<{id}>, held array<boolean>, sizes binary, vocabulary binary, places binary"


def _blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as packed blocks of ``PAYLOAD``."""
    kind = id_type(df, id_col)

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        texts, ids, held, size = [], [], [], 0

        def flush():
            nonlocal number, texts, ids, held, size
            out = np.concatenate([h.to_numpy(zero_copy_only=False) for h in held]).astype(bool)
            t = Tokens.of(texts, ~out)
            all_ids = pa.chunked_array(ids).combine_chunks()
            row = [
                pa.array([part << 32 | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                pa.array([out.tolist()], pa.list_(pa.bool_())),
                *[pa.array([x], pa.binary()) for x in t.packed()],
            ]
            number, texts, ids, held, size = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, names=[c.split(" ")[0] for c in PAYLOAD.split(", ")])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = pc.fill_null(batch.column("text"), "")
                # a block is closed by bytes, which bound its tokens
                texts.append(column)
                ids.append(batch.column("id"))
                held.append(batch.column("held"))
                size += pc.sum(pc.binary_length(column)).as_py() or 0
                if size >= 6 * BLOCK:
                    yield flush()
        if texts:
            yield flush()

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held"))
    return rows.mapInArrow(run, PAYLOAD.format(id=kind))


def _rows(batches, names: list[str]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield [batch.column(k)[i] for k in names]


def _tree(row, model: tuple) -> tuple[Tokens, Tree]:
    """Tokens and tree of a row of ``PAYLOAD`` with what came back to it."""
    ids, held, sizes, vocabulary, places, n, v, *rounds = row
    tokens = Tokens.unpacked(sizes.as_py(), vocabulary.as_py(), places.as_py(), ~np.array(held.as_py(), bool))
    return tokens, Tree(tokens, [r.as_py() for r in rounds], n.as_py() or 0, v.as_py() or 0, *model)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, least: int = 16, strength: float = 64.0, bits: float = 8.0) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``base_score`` is the log10 probability under add-one counts of single tokens, ``score`` that under the tree.  NULL and
    empty texts have the end token only; repeated rows count and are scored each; rows with a NULL id are learnt from;
    an empty table gives no rows; other columns are left out.  A text is never cut: one longer than a block is a block.

    The rows of ``df`` must come in the same order if a partition is computed again, as those of a table do; otherwise
    the run fails rather than give wrong counts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    wide = max(parts, size >> 25)
    split = max(wide - 1, 0).bit_length()
    payload = _blocks(df, id_col, text_col).repartition(parts, "block")
    model = (depth, least, strength, bits)
    names = ["ids", "held", "sizes", "vocabulary", "places", "n", "v"]

    def sender(rounds: int):
        columns = [*names, *[f"r{i}" for i in range(rounds)]]

        def run(batches):
            for block, *row in _rows(batches, ["block", *columns]):
                _, tree = _tree(row, model)
                out = [r for ask in tree.asks for r in send(block.as_py(), *ask, split)]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split(" ")[0] for c in ROWS.split(", ")])

        return run

    rounds = max(2 * depth, 1)

    def finish(batches):
        for row in _rows(batches, [*names, *[f"r{i}" for i in range(rounds)]]):
            tokens, tree = _tree(row, model)
            ids, held, n = row[0].values, row[1].as_py(), row[5].as_py() or 0
            per_text = lambda x: np.add.reduceat(x, tokens.first)
            data = [
                ids,
                pa.array(held, pa.bool_()),
                pa.array(tokens.sizes, pa.int64()),
                pa.array(per_text(tree.known.astype(np.int64)), pa.int64()),
                pa.array(np.full(len(ids), n), pa.int64()),
                pa.array(per_text(tree.base) * np.log10(2.0), pa.float64()),
                pa.array(per_text(tree.best) * np.log10(2.0), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(data, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = F.lit(None).cast("bigint")
    state = payload.withColumns({"n": none, "v": none})
    for i in range(rounds):
        back = totals(state.mapInArrow(sender(i), ROWS))
        if i == 0:
            ends = back.filter(F.col("kind") == COUNTS).agg(F.struct(F.sum("amount").alias("n"), F.sum("known").alias("v")).alias("e")).scalar()
            state = payload.withColumn("e", ends).select("*", "e.n", "e.v").drop("e")
        state = state.join(per_block(back, f"r{i}"), "block", "left")
    schema = f"`{id_col}` {id_type(df, id_col)}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return state.mapInArrow(finish, schema)
