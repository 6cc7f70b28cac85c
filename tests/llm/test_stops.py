"""A stop after any letter: the tokenizer may put a mark between the two."""

import sys
import unicodedata

import numpy as np

from tidegrid.llm.bpe import vocabulary_path
from tidegrid.llm.token_files import _word_encoder


def test_every_letter_before_a_stop():
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    texts = [chr(c) + stop for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L" for stop in ".,"]
    encode = _word_encoder(path)
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert [np.frombuffer(x, np.uint32).tolist() for x in encode(part)] == want
