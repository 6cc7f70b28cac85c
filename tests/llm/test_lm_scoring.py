"""Suffix-tree scores against a tree of dictionaries over all documents at once."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import lm_scoring, packed

END = object()


def plain(docs, depth=2, least=16, strength=64.0, bits=8.0):
    lower = {c: c + 32 for c in range(65, 91)}
    split = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), END]) for i, t in docs]
    learnt = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in split]
    counts = Counter()
    for (_, words), own in zip(split, learnt):
        for i in range(len(words)) if own else ():
            for d in range(depth + 1):
                if i >= d:
                    counts[tuple(words[i - d : i + 1])] += 1
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    kept, tried = {()}, {()}

    def state(words, i, most):
        """Longest kept context of a token."""
        d = 0
        while d < most and i > d and tuple(words[i - d - 1 : i]) in kept:
            d += 1
        return d

    def log2p(words, i, d):
        if d == 0:
            return math.log2((counts[(words[i],)] + 1) / (n + v + 1))
        s = tuple(words[i - d : i])
        parent = 2 ** log2p(words, i, d - 1)
        return math.log2((counts[(*s, words[i])] + strength * parent) / (counts[s] + strength))

    for d in range(1, depth + 1):
        gains = defaultdict(int)
        for (_, words), own in zip(split, learnt):
            for i in range(d, len(words)) if own else ():
                s = tuple(words[i - d : i])
                if counts[s] >= least and s[1:] in kept and s[:-1] in tried:
                    parent = log2p(words, i, d - 1)
                    one = (counts[(*s, words[i])] - 1 + strength * 2**parent) / (counts[s] - 1 + strength)
                    gains[s] += round((math.log2(one) - parent) * lm_scoring.UNIT)
        tried |= set(gains)
        kept |= {s for s, g in gains.items() if g >= bits * lm_scoring.UNIT}
    rows = []
    for (i, words), own in zip(split, learnt):
        base = sum(log2p(words, k, 0) for k in range(len(words)))
        best = sum(log2p(words, k, state(words, k, depth)) for k in range(len(words)))
        rows.append((i, not own, len(words), sum(counts[(w,)] > 0 for w in words), n, base * math.log10(2), best * math.log10(2)))
    return rows, kept


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[6], 6))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("model", [{}, {"depth": 3, "least": 3, "strength": 4.0, "bits": 1.0}, {"depth": 0}, {"depth": 1, "least": 1, "bits": -50.0}])
def test_documents(spark, monkeypatch, model):
    monkeypatch.setattr(lm_scoring, "BLOCK", 4096)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    want, kept = plain([(r.doc_id, r.text) for r in docs.collect()], **model)
    same(lm_scoring.score(docs, **model).collect(), want)
    assert len(kept) > 1 or model == {"depth": 0}


def test_odd_rows(spark):
    rows = [(None, "A b a B"), (1, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (2, " \t\n\x0b\x0c\r "), (3, "É é e\xa0e \x1c"), (4, "a b " * 40_000), (5, "x" * 300_000), (6, "a b a b")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, block int, held string")
    same(lm_scoring.score(df).collect(), plain(rows)[0])


def test_empty_and_unlearnt_tables(spark):
    schema = "doc_id long, text string"
    assert lm_scoring.score(spark.createDataFrame([], schema)).collect() == []
    away = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    same(lm_scoring.score(spark.createDataFrame([(away, "a b")], schema)).collect(), plain([(away, "a b")])[0])


def test_held_out_texts_gain(spark):
    rows = lm_scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(-(2**60), 2**60)))
def test_packing(numbers, signed):
    a, b = np.array(numbers, np.uint64), np.array(signed, np.int64)
    assert (packed.unpack(packed.pack(a)) == a).all()
    assert (packed.unpack_sorted(packed.pack_sorted(np.sort(a))) == np.sort(a)).all()
    assert (packed.unpack_signed(packed.pack_signed(b)) == b).all()
