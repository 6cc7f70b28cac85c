"""The pipeline's stages against plain loops, and on empty tables, clashing names and long texts."""

import corpus_pipeline
from tidegrid.llm import bpe, ngram_join, pii, queries

from test_dedup import classes, held, texts

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark):
    docs = queries.documents(spark, FOLDER)
    one = corpus_pipeline.identify_language(spark, docs, FOLDER).cache()
    assert one.columns == COLUMNS and one.count() >= 0.95 * docs.count()
    two = corpus_pipeline.drop_near_copies(spark, one, FOLDER).cache()
    assert two.columns == COLUMNS
    assert set(texts(two)) == {c for _, c in classes(texts(one), 5, 80).values()}
    three = corpus_pipeline.decontaminate(spark, two, FOLDER).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert three.columns == COLUMNS and set(texts(three)) == set(texts(two)) - {d for d, _ in held(texts(two), items)}
    four = corpus_pipeline.redact(spark, three, FOLDER).cache()
    assert four.columns == COLUMNS and set(texts(four)) == set(texts(three))
    find = pii.base_finder()
    assert not any(find(t) for t in texts(four).values())
    assert all(r.n_chars == len(r.text) for r in four.collect())
    five = corpus_pipeline.tokenize(spark, four, FOLDER)
    decoded = {r.doc_id: r.decoded for r in bpe.decode(five.select("doc_id", "ids")).collect()}
    assert decoded == texts(four)


def test_whole_run(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_copies", "decontaminate", "redact", "tokenize"]
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_near_copy_stage_keeps_one_of_equal_rows_and_blank_ones(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (None, "other words are here in this text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, df, FOLDER).collect()) == ["1", "3", "4", "None"]
    assert ngram_join.join(df).count() == 6


CLASHING = "doc_id bigint, text string, lang string, lang_pred string, score string, _text int, stays int, h string, c0 string, id string"


def test_stages_with_clashing_names_nulls_and_long_texts(spark):
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
    texts_in = [None, "", "one two three four five six seven", long, long + " tail", "mail me at someone@example.org today please friend"]
    rows = [(i, t, "en" if i % 2 else "de", "p", "s", i, -i, "h", "c", "d") for i, t in enumerate(texts_in)] + [(None,) * 10]
    docs = spark.createDataFrame(rows, CLASHING)
    kept = [corpus_pipeline.identify_language(spark, docs, FOLDER)]
    assert None not in texts(kept[0]).values() and "" not in texts(kept[0]).values()
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.decontaminate, corpus_pipeline.redact):
        kept.append(stage(spark, docs, FOLDER))
    assert all(k.columns == docs.columns for k in kept)
    assert sorted(str(r.doc_id) for r in kept[1].collect()) == ["0", "1", "2", "3", "5", "None"]
    assert {r.doc_id: r["_text"] for r in kept[1].collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 5: 5, None: None}
    assert kept[2].count() == 7 and kept[3].count() == 7
    redacted = {r.doc_id: r.text for r in kept[3].collect()}
    assert "<EMAIL>" in redacted[5] and redacted[0] is None
    assert corpus_pipeline.tokenize(spark, docs, FOLDER).count() == 7


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
