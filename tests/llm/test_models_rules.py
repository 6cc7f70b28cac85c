"""Language, quality and personal data: held-out accuracy, brute force and edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import langid, pii, quality, queries, tagger

FOLDER = "/root/testdata/sf0.001"
HARD = [None, "", " \n\t", "12 34 !!", "a\n\na\nb\na ", "x " * 9, "lala " * 20000, "l" * 50000, "é日本 😀", "same text", "same text"]
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(1000 + i, t, None, True) for i, t in enumerate(HARD)] + [(None, "no id here", "zz", False)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string, kept boolean")


def test_language_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in queries.documents(spark, FOLDER).collect()}
    rows = queries.op4_language(spark, FOLDER).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in apart) >= 0.95 * len(apart)


def test_language_edges(spark, hard):
    model = langid.fit(queries.documents(spark, FOLDER))
    got = langid.predict(hard, model).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002, 1003} and len(got) == len(HARD) + 1
    empty = langid.fit(hard.limit(0), label_col="lang_pred")
    assert {r.lang_pred for r in langid.predict(hard, empty).collect()} == {"und"}
    assert langid.predict(hard.limit(0), model).count() == 0


def test_leader_ignores_noise():
    rng = np.random.default_rng(0)
    rows = [(np.array([i % 2, 2 + rng.integers(50)]), np.array([1.0, 0.01])) for i in range(200)]
    w = langid.follow_the_leader(rows, np.arange(200) % 2, 2, l1=0.05)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[2:52] == 0).mean() > 0.9
    assert langid.calibrate(np.array([[9.0, 0], [9.0, 0], [9.0, 0]]), np.array([0, 0, 1])) > 1


def measures(text):
    w = W.findall(text or "")
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in (text or "").split("\n") if W.search(s)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, hard):
    docs = queries.documents(spark, FOLDER).select("doc_id", "text").unionByName(hard.select("doc_id", "text"))
    got = sorted(tuple(map(str, r)) for r in quality.measured(docs).drop("text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(tuple(map(str, (r.doc_id, *measures(r.text)))) for r in docs.collect())
    judged = quality.judge(docs)
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    rows = judged.collect()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert quality.judge(docs.limit(0)).count() == 0


def test_order_of_rules_does_not_change_the_verdict(spark):
    docs = queries.documents(spark, FOLDER)
    one = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    two = {r.doc_id: r.kept for r in quality.judge(docs, rules=quality.RULES[::-1]).collect()}
    assert one == two and 0.5 < sum(one.values()) / len(one) < 1


# fixed values: the contract's patterns, as they are
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 16 <= len(d) <= 19 and k == 2 and pii.luhn(d), 8 <= len(d) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


SPANS = ["a@b.c x..y@z.org@q.w.e @no.name a@b@c.de", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255", "4111 1111-1111 1111 4111111111111112 " + "4" * 40, "+1 (555) 010-9999. +12 +1234567890123456", "é@b.co ü.x@y.z-1.q."]


def test_base_spans_and_edges(spark, hard):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(SPANS)], "doc_id bigint, text string")
    docs = queries.documents(spark, FOLDER).select("doc_id", "text").withColumn("doc_id", queries.F.col("doc_id") + 10000).unionByName(hard.select("doc_id", "text")).unionByName(more)
    model = pii.fit(docs, sample_docs=50, pieces=640)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    text = dict(rows)
    for r in pii.find(docs, model).collect():
        base = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.spans if not s.added]
        assert base == base_spans(text[r.doc_id]), text[r.doc_id]
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[1000] is None and clean[1001] == "" and clean[0].startswith("<EMAIL> <EMAIL>")
    assert pii.find(docs.limit(0), model).count() == 0
    assert pii.find(docs, pii.fit(docs.limit(0), pieces=128)).count() == docs.count()


def test_query_digests(spark):
    text = {r.doc_id: r.text for r in queries.documents(spark, FOLDER).collect()}
    for r in queries.op6_pii(spark, FOLDER).collect():
        base = base_spans(text[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]


def test_tagger_learns_spans_the_patterns_miss(spark):
    model = pii.fit(queries.documents(spark, FOLDER))
    text = "the thonre " * 9 + "call (555) 123-4567 soon " + "and the thonre " * 9
    (spans,) = pii.all_spans([text], pii.base_finder(), model, tagger.symbol_table())
    assert [(pii.KINDS[k], text[a:b]) for k, a, b, _ in spans] == [("phone", "(555) 123-4567")]


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in tagger.start(5, 4, 3).items()}
    s, t = rng.integers(0, 99, (3, 7)), rng.integers(0, 5, (3, 7))
    _, g = tagger.gradients(p, s, t)
    for k in p:
        i = (int(s[0, 0]), 1) if k == "E" else tuple(rng.integers(0, d) for d in p[k].shape)
        at, losses = p[k][i], []
        for e in (1e-3, -1e-3):
            p[k][i] = at + e
            losses.append(tagger.gradients(p, s, t)[0])
        p[k][i] = at
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k][i]) < 1e-4
