import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from frameloom.llm import subwords, token_count

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"ab ▁\n\t é'sñ0.1_-<|>", "the", " and", "日", "́", " ", "  ", "<s>", "<|endoftext|>", "\U0001f642", "İ", "Σ"]


def odd_texts(n: int = 4000) -> list[str]:
    rng = random.Random(7)
    return ["", " ", "\n", "a ", " a", "x" * 5000, "the " * 3000, *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n))]


def test_counts_equal_the_library():
    counter, model = token_count.counter(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert counter.splits and counter.line_splits and len(counter.proved) > 10_000
    assert [(t, counter.count(t)) for t in odd_texts()] == [(t, len(model.encode(t))) for t in odd_texts()]


def test_word_ids_equal_the_library():
    bpe, library = subwords.WordBpe(WORD), Tokenizer.from_file(WORD)
    texts = odd_texts()
    assert bpe.by_word
    want = [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.ids(texts) == want


@pytest.mark.parametrize("path", [PIECE, WORD])
def test_table(odd, none, path):
    rows = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_count.token_counts(odd.withColumn("n_tokens", odd.n_chars), path).collect()}
    assert rows[1, 0] == rows[2, 0] == 0
    assert token_count.token_counts(odd, path).count() == odd.count()
    assert token_count.token_counts(none, path).count() == 0
