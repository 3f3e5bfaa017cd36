"""The encoder of token_ids.py: awkward characters, an encoder that forgets, and what known words cost."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harrow.llm import token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
#: ASCII with its control characters, the letters of Latin-1 and the two signs among them.
COMMON = [chr(i) for i in (*range(128), *range(0xC0, 0x100))]
AWKWARD = [
    "漢", "é", " ", " ", "²", "ª", "😀", "\u0085", "İ", "ſ", "K", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "don't",
    "12345", "d" * 8, "e" * 9, "b" * 16, "b" * 16 + "c", "b" * 17, "!\0", "!", "\n", "\t",
]


@pytest.mark.parametrize("remembered", [1, 40, token_ids.REMEMBERED])
def test_awkward_texts_whatever_is_remembered(monkeypatch, remembered):
    monkeypatch.setattr(token_ids, "REMEMBERED", remembered)
    library, encoder, deal = Tokenizer.from_file(PATH), token_ids.Encoder(PATH), random.Random(7)
    kinds = [COMMON, [c for c in COMMON if c not in "×÷'"], [*"abcÀé Ö'1!.\0 "], [*COMMON, *AWKWARD * 3]]
    for _ in range(150):
        texts = ["".join(deal.choices(deal.choice(kinds), k=deal.choice([0, 1, 2, 9, 60, 300]))) for _ in range(deal.choice([1, 2, 20]))]
        texts += [None, ""] * deal.randrange(2)
        flat, first = encoder.encode(texts)
        assert len(first) == len(texts) + 1 and first[-1] == len(flat)
        for i, t in enumerate(texts):
            assert flat[first[i] : first[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, token_ids.END_ID]


def test_known_words_cost_little(rows):
    """A sixteenth of the library's time at most: about a tenth with a dictionary of hashes, a twenty-fifth with a table."""
    texts = [t or "" for _, t in rows]
    library, encoder = Tokenizer.from_file(PATH), token_ids.Encoder(PATH)
    encoder.encode(texts)

    def least(call, times):
        took = []
        for _ in range(times):
            began = time.process_time()
            call()
            took.append(time.process_time() - began)
        return min(took)

    assert 16 * least(lambda: encoder.encode(texts), 7) < least(lambda: library.encode_batch_fast(texts, add_special_tokens=False), 3)
