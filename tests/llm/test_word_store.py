"""The store of encoded words: words that come again stay in it, and its size and the slices change no id."""

import random

import pyarrow as pa
import tokenizers

from tidegrid.llm import bpe, token_files


class Counting:
    """A tokenizer that notes the texts it is given."""

    given: list = []

    def __init__(self, inner):
        self.inner = inner

    @classmethod
    def from_file(cls, path):
        return cls(REAL.from_file(path))

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.inner.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.inner, name)


REAL = tokenizers.Tokenizer


def test_words_that_come_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(token_files, "MOST_WORDS", 20)
    encode = token_files._word_encoder(bpe.vocabulary_path("word_bpe_49k.json"))
    Counting.given.clear()
    for i in range(60):
        encode([f"always. {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}x once{'y' * i}z"])
    assert sum("always" in t for t in Counting.given) == 1


def test_ids_do_not_depend_on_store_and_slices(monkeypatch):
    rng = random.Random(5)
    parts = ["one", "Two.", "é.", "é́.", "3a,", "x.y.", "a..", "<|endoftext|>", "<|startoftext|>.", "İ.", "don't.", "\n", "\t", "", "ﬁ,", "日本.", "a" * 90 + "."]
    texts = ["", "a.", ".", ",", " a. b, c.", *[" ".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]]
    path = bpe.vocabulary_path("word_bpe_49k.json")
    library = REAL.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (2, 400_000):
        monkeypatch.setattr(token_files, "MOST_WORDS", most)
        monkeypatch.setattr(token_files, "SLICE", 500)
        encode = token_files._word_encoder(path)
        slices = list(token_files._slices(pa.RecordBatch.from_arrays([pa.array([None, *texts])], names=["text"])))
        assert len(slices) > 3 and sum(s.num_rows for s in slices) == len(texts) + 1
        got = [r for s in slices for r in encode([t or "" for t in s.column("text").to_pylist()])]
        assert [list(memoryview(r).cast("I")) for r in got] == [[], *want]
