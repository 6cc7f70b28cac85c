"""Alignment of two tokenizers against the libraries and a plain loop over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tidegrid.llm import alignment
from tidegrid.llm.bpe import byte_letters, vocabulary_path

ODD = [
    *(" a", "a  b", "  ", "x\n\ny  ", "▁", "a ▁b", "<|endoftext|> <s></s> <unk>", "ẛ̣ ﬁ", "it's  don't\t'll"),
    *("\x1c a \x1d\x85b \xa0c", None, "", "💥🏳️‍🌈 ü", "x" * 5000 + " " * 300 + "y", "123 45,6.7 \x00 z", "same same", "same same"),
    "word " * 20_000,
]


def plain(docs):
    """The contract's columns, one document after another."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    letters = byte_letters()
    bytes_a = {i: bytes(letters[c] for c in k) for k, i in t.get_vocab(with_added_tokens=False).items() if all(c in letters for c in k)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.B_FILE))

    def ranges(tokens):
        at, out = 0, []
        for x in tokens:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    counts, held = Counter(), []
    for doc, text in docs:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            ta, tb = [bytes_a[i] for i in a], [alignment._piece_bytes(pieces.id_to_piece(i)) for i in b]
            if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
                a, b = [], []
        if a:
            ra, rb = ranges(ta), ranges(tb)
            j = 0
            for i, (start, end) in enumerate(ra):
                while rb[j][1] <= start:
                    j += 1
                k = j
                while k < len(rb) and rb[k][0] < end:
                    links.append((a[i], b[k]))
                    k += 1
            i = j = 0
            for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
                x, y = i, j
                while i < len(ra) and ra[i][1] <= cut:
                    i += 1
                while j < len(rb) and rb[j][1] <= cut:
                    j += 1
                groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        counts.update(set(links))
        held.append((doc, a, b, ";".join(groups), len(groups), links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [
        (doc, len(a), len(b), n, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if a else "", g)
        for doc, a, b, g, n, links in held
    ]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_a string, pairs int").repartition(3, "doc_id")


def test_odd_texts_and_clashing_names(table):
    want = plain(list(enumerate(ODD)))
    assert sorted(map(tuple, alignment.link_counts(table).collect())) == [w[:8] for w in want]
    assert sorted(map(tuple, alignment.align(table).collect())) == [(*w[:5], w[8]) for w in want]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(w[:8] for w in plain([(r.doc_id, r.text) for r in docs.collect()]))
    assert sorted(map(tuple, alignment.link_counts(docs).collect())) == want


def test_small_store_gives_the_same(monkeypatch):
    paths = alignment._paths(None, None)
    texts = [t or "" for t in ODD[:-1]] * 2
    whole, small = alignment.Aligner(*paths), alignment.Aligner(*paths)
    want = whole.groups(whole.align(texts), len(texts))
    monkeypatch.setattr(alignment, "MOST_WORDS", 3)
    got = [g for at in range(0, len(texts), 5) for g in small.groups(small.align(texts[at : at + 5]), len(texts[at : at + 5]))]
    assert got == want


def test_empty_and_tokenless_tables(spark):
    schema = "doc_id long, text string"
    assert alignment.link_counts(spark.createDataFrame([], schema)).collect() == []
    got = alignment.link_counts(spark.createDataFrame([(1, None), (None, ""), (1, "▁")], schema)).collect()
    assert sorted(((r.doc_id is None, r.doc_id), *r[1:]) for r in got) == [((False, 1), 0, 0, 0, 0, 0, 0, "")] * 2 + [((True, None), 0, 0, 0, 0, 0, 0, "")]
