"""Dedup, joins and decontamination against brute force, with edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import components, decontamination, ngram_join, queries, substring_dedup, suffix_dedup

FOLDER = "/root/testdata/sf0.001"


def words_of(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def made():
    """Texts with shared passages, copies, near copies, self repeats, and empty, NULL, long and odd ones."""
    passage, line = words_of(1, 60), words_of(2, 25)
    rows = [None, "", "  \n\t", "one two", "one two", "One TWO", "a" * 5000, "é" * 150, "x " * 300, " ".join(words_of(3, 20))]
    for i in range(30):
        own = words_of(100 + i, 80)
        rows.append(" ".join(own[:40] + passage[i % 7 : 55 + i % 5] + own[40:]))
        rows.append(" ".join(own[:10] + line + own[10:30] + line))
    base = words_of(5, 200)
    for i in range(12):
        changed = list(base)
        changed[(17 * i) % 200] = f"changed{i // 2}"
        rows.append(" ".join(changed))
    rows += [rows[-1], rows[-1], rows[12], " ".join(words_of(7, 3000)), " ".join(words_of(7, 3000)[500:2500])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, True, "q") for i, t in enumerate(made())]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean, h string").repartition(5)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def brute_bytes(of):
    count = Counter(b[i : i + 200] for t in of.values() for b in [t.encode()] for i in range(len(b) - 199))
    out = {}
    for k, t in of.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[k] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def brute_words(of):
    seen, out = set(), {}
    for k in sorted(of):
        w = of[k].encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        out[k] = (len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_byte_dedup(docs, group):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs, group=group).collect()}
    assert got == brute_bytes(texts(docs))
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [20_000, 1])
def test_word_dedup(docs, group):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs, group=group).collect()}
    assert got == brute_words(texts(docs))
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_repeated_rows_and_missing_ids(spark):
    t = " ".join(words_of(9, 70))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "short")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.dedup(df).collect()) == [("1", 70), ("1", 70), ("2", 0), ("None", 0)]
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(df).collect()) == [("1", len(t)), ("1", len(t)), ("2", 0), ("None", len(t))]
    assert sorted((str(r.doc_id), r.component_id) for r in ngram_join.join(df).collect()) == [("1", 1), ("1", 1), ("2", 2), ("None", 1)]


def test_dedup_queries(spark):
    of = texts(queries.documents(spark, FOLDER))
    want = brute_bytes(of)
    for r in queries.op2_suffixes(spark, FOLDER).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*want[r.doc_id][:3], hashlib.sha256(want[r.doc_id][3]).hexdigest())
    want = brute_words(of)
    for r in queries.op8_substrings(spark, FOLDER).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*want[r.doc_id][:2], hashlib.sha256(want[r.doc_id][2].encode()).hexdigest())


def test_merging_front_coded_runs():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(30))) for _ in range(7)]
    got, before = [], b""
    for _, _, text, n in suffix_dedup.merge_runs([suffix_dedup.front_code(r) for r in runs]):
        assert n == suffix_dedup.shared(before, text, 0)
        got.append(text)
        before = text
    assert got == sorted(sum(runs, []))
    assert list(suffix_dedup.merge_runs([])) == []


def classes(of, n, percent):
    sets = {k: ngram_join.shingles_of(t, n) for k, t in of.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and ngram_join.alike(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), percent):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n,percent,hot", [(3, 90, 200), (3, 90, 2), (5, 80, 3)])
def test_join_classes(docs, n, percent, hot):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, n=n, percent=percent, hot=hot).collect()}
    assert got == classes(texts(docs), n, percent)


def test_join_of_an_empty_table(docs):
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_join_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_join(spark, FOLDER).collect()}
    assert got == classes(texts(queries.documents(spark, FOLDER)), 3, 90)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    sets = [rng.choice(400, 120, replace=False) for _ in range(20)]
    sets += [np.append(rng.permutation(s)[: 120 - k], rng.choice(400, k)) for s in sets for k in (2, 6, 20)]
    sets = [np.unique(s) for s in sets]
    maps = np.zeros((len(sets), 2048), bool)
    for i, s in enumerate(sets):
        maps[i, s * 5 % 2048] = True
    words = np.packbits(maps, axis=1).view(np.uint64)
    groups = np.arange(len(sets))
    groups[5] = groups[4]
    got = {tuple(sorted(p)) for p in ngram_join.candidate_pairs(np.array([len(s) for s in sets]), words, groups, 90).tolist()}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both) and groups[a] != groups[b]:
                assert (b, a) in got
    assert len(got) < len(sets) ** 2 / 8


def test_trees_of_many_units():
    rng = np.random.default_rng(4)
    maps = np.packbits(rng.random((300, 512)) < 0.1, axis=1)
    maps[1::3] = maps[::3]
    words, units = maps.view(np.uint64), rng.integers(0, 9, 100).repeat(3)
    sizes = np.bitwise_count(words).sum(1).astype(np.int64)
    units[-1] = 99  # alone
    order = rng.permutation(300)
    words, units, sizes = words[order], units[order], sizes[order]
    got = {tuple(sorted(p)) for p in ngram_join.candidate_pairs(sizes, words, np.arange(300), 90, units).tolist()}
    want = set()
    for a in range(300):
        for b in range(a + 1, 300):
            both = int(np.bitwise_count(words[a] & words[b]).sum())
            if units[a] == units[b] and 190 * min(both, sizes[a], sizes[b]) >= 90 * (sizes[a] + sizes[b]) and 100 * min(sizes[a], sizes[b]) >= 90 * max(sizes[a], sizes[b]):
                want.add((a, b))
    assert got == want and len(want) >= 100


def test_wide_bitmaps_lose_no_pair():
    base = words_of(11, 3000, 10**6)
    rows = [base, base[:2800], base[:1600], ["changed"] * 1 + base[1:], words_of(12, 3000, 10**6), words_of(13, 600, 10**6), base[:100]]
    sets = ngram_join.Sets([" ".join(r) for r in rows], 3, np.zeros(0, np.uint64))
    maps = sets.wide_bitmaps()
    assert [m is None for m in maps] == [len(r) - 2 <= ngram_join.BITS for r in rows]
    for i, x in enumerate(maps):
        for j, y in enumerate(maps):
            if x is not None and y is not None:
                a, b = (ngram_join.shingles_of(" ".join(rows[k]), 3) for k in (i, j))
                assert ngram_join.wide_alike(x, y, len(a), len(b), 90) >= ngram_join.alike(len(a & b), len(a), len(b), 90)
    assert not ngram_join.wide_alike(maps[0], maps[4], 2998, 2998, 90)


def test_join_by_pieces_of_a_shingle(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, n=5, percent=80).collect()}
    assert got == classes(texts(docs), 5, 80)


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 30, "PIECE": 7, "DENSE": 0}, {"HELD": 2_000, "DENSE": 1}])
def test_join_of_a_template(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    pick, base = random.Random(3), words_of(31, 150, 10**6)
    rows = []
    for i in range(140):
        row = list(base)
        for at in pick.sample(range(150), pick.randrange(1, 7)):
            row[at] = f"w{pick.randrange(10**6)}"
        rows.append((i, " ".join(row)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = classes(dict(rows), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()} == want
    assert 3 < len({c for _, c in want.values()}) < 120


def test_links_of_units_by_exact_sets():
    rng = np.random.default_rng(6)
    sets, units = [], []
    for unit, pool in ((5, 130), (9, 3000), (-4, 60)):
        base = rng.choice(pool, 50, replace=False)
        for k in range(40):
            sets.append(np.unique(np.append(base[k % 5 :], rng.choice(10**6, int(rng.integers(0, 6))))))
            units.append(unit)
    keys = rng.permutation(len(sets))
    table = pa.table({"k": keys, "n": [len(x) for x in sets], "label": keys, "unit": units, "hashes": [x.tolist() for x in sets]})
    got = list(zip(*ngram_join._linked(table, 90).to_pydict().values()))
    links = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if units[i] == units[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                links.add(tuple(sorted((int(keys[i]), int(keys[j])))))

    def tied(pairs):
        root = {int(k): int(k) for k in keys}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in pairs:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return {n: find(n) for n in root}

    assert set(got) <= links and len(got) < len(sets) < len(links) and tied(got) == tied(links)


def test_join_of_repeated_long_rows(spark):
    long = " ".join(words_of(21, 20_000, 10**6))
    near = " ".join(words_of(21, 20_000, 10**6)[:-50])
    rows = [(1, long, 0, 0)] * 4 + [(1, near, 0, 0), (2, near, 0, 0), (None, near, 0, 0), (None, None, 0, 0), (3, "few words", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rep int, k int")  # clashing names
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    assert got == sorted([("1", 19_998, 1)] * 4 + [("1", 19_948, 1), ("2", 19_948, 1), ("None", 19_948, 1), ("None", 0, None), ("3", 1, 3)])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(50)}}


@pytest.mark.parametrize("block", [1 << 20, 40, 7])
def test_components_of_random_links_in_blocks(spark, block):
    pick = random.Random(block)
    links = [(pick.randrange(-90, 90), pick.randrange(-90, 90)) for _ in range(100)]
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {n: find(n) for a, b in links if a != b for n in (a, b)}
    df = spark.createDataFrame([*links, *links[:20], (5, None), (None, None)], "a bigint, b bigint")
    assert {r.node: r.label for r in components.components(df, block=block).collect()} == want
    assert components.components(df.limit(0), block=block).count() == 0


def held(of, items):
    shingles = lambda t: [tuple(w[i : i + 5]) for w in [(t or "").lower().encode().split()] for i in range(len(w) - 4)]
    own, known = defaultdict(list), set()
    for k, t in items:
        if s := shingles(t):
            own[len(s)].append((k, Counter(s)))
            known |= set(s)
    out = {}
    for d, t in of.items():
        s = shingles(t)
        for n, of_size in own.items():
            for a in range(len(s) - n + 1):
                if known.isdisjoint(s[a : a + n]):
                    continue
                c = Counter(s[a : a + n])
                for k, q in of_size:
                    both = sum((c & q).values())
                    if 100 * both >= 80 * (2 * n - both):
                        count, best = out.get((d, k), (0, 0))
                        out[d, k] = count + 1, max(best, round(both / (2 * n - both), 9))
    return out


def test_decontamination(spark, docs):
    items = [(0, " ".join(words_of(1, 60)[8:50])), (1, "one two"), (2, None), (3, " ".join(words_of(2, 25)).upper()), (4, "x " * 30), (5, " ".join(words_of(1, 60)[8:50])), (6, "")]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id bigint, text string, doc_id string")
    found = decontamination.find(docs, table)
    got = {(r.doc_id, r.item_id): (r.n_windows, round(r.similarity, 9)) for r in found.collect()}
    assert got == held(texts(docs), items) and len(got) > 60
    clean = {r.doc_id for r in decontamination.remove(docs, found).collect()}
    assert clean == set(texts(docs)) - {d for d, _ in got}
    assert decontamination.find(docs, table.limit(0)).count() == 0 == decontamination.find(docs.limit(0), table).count()
    assert not any(w in found._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


def test_decontamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): (r.n_windows, round(r.similarity, 9)) for r in queries.op1_decontamination(spark, FOLDER).collect()}
    assert got == held(texts(queries.documents(spark, FOLDER)), items)


def test_fingerprints_near_each_other(spark):
    rng = random.Random(3)
    rows = [([rng.getrandbits(63) for _ in range(34)],) for _ in range(5)]
    got = spark.createDataFrame(rows, "s array<bigint>").select("s", decontamination.simhash(F.col("s")).alias("p")).collect()
    for r in got:
        want = sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in r.s) > 0)
        assert r.p & (1 << 64) - 1 == want


def test_samples_whose_surroundings_share_half_a_hash(spark):
    """Pairs found by search: one gram, different surroundings, hashes of these with equal upper 32 bits."""
    words = [(i, f"{'a ' * 14}x{i} {' '.join(f'm938_{j}' for j in range(5))} y{i}{' b' * 14}") for i in (27466, 105093)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(spark.createDataFrame(words, "doc_id bigint, text string")).collect()}
    assert got == brute_words(dict(words)) and {r[1] for r in got.values()} == {0}
    raw = [(i, f"{i:07d}".rjust(150, "a") + "02037" * 10 + "b" * 150) for i in (39210, 48767)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(spark.createDataFrame(raw, "doc_id bigint, text string")).collect()}
    assert got == brute_bytes(dict(raw)) and {r[1] for r in got.values()} == {200}


@pytest.mark.parametrize("text", ["hello", "hello world", "one two three", "one two three four", ""])
def test_join_of_one_short_document(spark, text):
    of = {7: text}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(list(of.items()), "doc_id bigint, text string"), n=5, percent=80).collect()}
    assert got == classes(of, 5, 80)
    alone = ngram_join.Sets([text], 5, np.zeros(0, np.uint64))
    beside = ngram_join.Sets([text, "some other words stand in the same slice"], 5, np.zeros(0, np.uint64))
    assert alone.keys[0] == beside.keys[0]


def held_whole(of, items):
    """``held``, and documents shorter than an item compared with it as a whole."""
    shingles = lambda t: Counter(tuple(w[i : i + 5]) for w in [(t or "").lower().encode().split()] for i in range(len(w) - 4))
    out = held(of, items)
    for d, t in of.items():
        for k, q in items:
            own, item = shingles(t), shingles(q)
            both = sum((own & item).values())
            if 0 < own.total() < item.total() and 100 * both >= 80 * (own.total() + item.total() - both):
                out[d, k] = 1, round(both / (own.total() + item.total() - both), 9)
    return out


def test_decontamination_of_documents_shorter_than_an_item(spark):
    long, small = words_of(21, 39), words_of(22, 9)
    items = [(0, " ".join(long)), (1, " ".join(small)), (2, "x " * 40), (3, " ".join(long).upper()), (4, " ".join(long[:36]))]
    rows = [" ".join(w) for n in (38, 37, 33, 32, 31, 20, 5, 4) for w in (long[:n], long[-n:], long[:n] + ["other"], [*long[: n // 2], "other", *long[n // 2 : n]])]
    rows += [" ".join(small[:8]), " ".join(small[1:]), " ".join(small[:7]), "x " * 39, "x " * 36, "x " * 35, "x " * 20, " ".join(long), " ".join(["a", "b", *long[:38]]), " ".join(long[:38]).title(), ""]
    table = [(i, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame([*table, *table[:9]], "doc_id bigint, text string").repartition(3)
    found = decontamination.find(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): (r.n_windows, round(r.similarity, 9)) for r in found.collect()}
    want = held_whole(dict(table), items)
    assert got == want and (0, 0) in want and want[0, 0] == (1, round(34 / 35, 9)) and len(want) > len(held(dict(table), items)) + 20
    assert {r.doc_id for r in decontamination.remove(docs, found).collect()} == set(dict(table)) - {d for d, _ in want}
