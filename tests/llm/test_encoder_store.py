"""The store of the byte-level encoder: words that come again stay, and neither its size nor the cuts change an id."""

import random

import tokenizers

from tidegrid.llm import bpe


def test_words_that_come_again_are_encoded_once(monkeypatch):
    proposed, real = [], bpe.Encoder.propose
    monkeypatch.setattr(bpe.Encoder, "MOST_WORDS", 20)
    monkeypatch.setattr(bpe.Encoder, "propose", lambda self, word: proposed.append(word) or real(self, word))
    encoder = bpe.Encoder(bpe.vocabulary_path())
    for i in range(60):
        encoder.texts([f"now always {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}x once{'y' * i}z"])
    assert proposed.count(b" always") == 1


def test_ids_do_not_depend_on_store_and_cuts(monkeypatch):
    rng = random.Random(8)
    parts = ["one", "Two.", "é.", "3a,", "don't", "", "", "\n", "\t", "a\nb", "\n\nc", " d", " ", "\x1c", "日本", "<|endoftext|>", "x<|endoftext|>y", "a" * 300]
    texts = ["", " ", "  ", "\n", " a", "a ", " \n a", "  a  b  ", " ", *[" ".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(500)]]
    path = bpe.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most, size in ((2, 300), (600_000, 1 << 22)):
        monkeypatch.setattr(bpe.Encoder, "MOST_WORDS", most)
        monkeypatch.setattr(bpe, "SLICE", size)
        encoder = bpe.Encoder(path)
        parted = list(bpe._parts(texts))
        assert [t for p in parted for t in p] == texts and (len(parted) > 5) == (size == 300)
        assert [list(memoryview(r).cast("i")) for p in parted for r in encoder.texts(p)] == want
