"""Words encoded many at once: the same ids as one by one, one Python worker a task, a store without Python objects."""

import random

import pyarrow as pa

from tidegrid.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"


def test_many_words_equal_one_by_one():
    encoder = bpe.Encoder(bpe.vocabulary_path())
    v, rng = encoder.v, random.Random(3)
    tokens = [b for b in v.bytes if b and len(b) < 40]
    words = [b"".join(rng.choices(tokens, k=rng.randint(1, 5)))[:200] for _ in range(3000)]
    words += [bytes(rng.choices(range(256), k=rng.randint(1, 200))) for _ in range(200)] + [b"a" * n for n in range(1, 201)]
    merged = [v.merge(w) for w in words]
    assert bpe._lists(*v.merge_all(words)) == merged
    assert bpe._lists(*v.propose_all(words)) == [encoder.propose(w) for w in words]
    assert [list(memoryview(r).cast("i")) for r in encoder.words([*words, b"ab" * 500])] == [*merged, v.merge(b"ab" * 500)]


def test_store_holds_arrow_arrays():
    encoder = bpe.Encoder(bpe.vocabulary_path())
    encoder.texts([f"word{i} and w{'xyz'[i % 3]}" for i in range(500)])
    assert all(isinstance(a, pa.Array) for a in (*encoder.young, *encoder.old)) and len(encoder.young[0]) >= 500


def test_decoding_with_the_encoding(spark):
    docs = queries.documents(spark, FOLDER)
    hard = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é<|endoftext|> 日本 "), (-4, "a  b\n")], "doc_id bigint, text string")
    for df in (docs.select("doc_id", "text"), hard, hard.limit(0)):
        want = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.decode(bpe.encode(df)).collect())
        assert sorted((r.doc_id, r.ids, r.decoded) for r in bpe.encode(df, decoded=True).collect()) == want
    plan = queries.op3_bpe(spark, FOLDER)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
