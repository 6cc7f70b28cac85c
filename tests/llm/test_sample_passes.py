"""How often the suffix dedup makes the samples of a text."""

from tidegrid.llm import suffix_dedup


def test_samples_are_made_twice_only(spark, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), suffix_dedup.samples

    def counted(symbols, ends, window, gram):
        made.add(len(ends))
        return real(symbols, ends, window, gram)

    monkeypatch.setattr(suffix_dedup, "samples", counted)
    passage = "".join(chr(97 + i * i % 23) + str(i * 7919) for i in range(90))
    texts = [passage + f"{i * 104729}" * 30 for i in range(12)] + [passage[:300], passage, passage, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for group in (3, 20_000):  # with and without the windows of a frequent gram
        made.value = 0
        rows = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs, group=group).collect()}
        assert rows[13] == rows[14] == len(passage) and rows[12] == 300 and rows[15] == 0
        assert made.value == 2 * len(texts)
