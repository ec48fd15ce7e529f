"""Parts that texts are cut into before byte-level encoding: whole, independent of each other, and few."""

import random

import pytest

from gridlight.llm import bpe


@pytest.fixture(scope="module", params=[bpe.file_spec, bpe.rank_spec])
def encoder(request):
    return bpe.Encoder(request.param())


def test_odd_texts_as_in_one_call(encoder):
    pick = random.Random(6)
    characters = [*"aZé÷×ɏɐɵ.'!\n\n  \t09ßñ,，日́#{~|\x00\r\u0085", "Th", ". ", "<|endoftext|>", "👩‍👧"]
    texts = ["".join(pick.choices(characters, k=pick.randint(0, 14))) for _ in range(5000)] + ["", "\n", " ", "a\n", "\nb", "\n\n", "", "a  b\n\nc "]
    assert [*encoder.encode_all(texts)] == [encoder.whole(t) for t in texts]


def test_parts_give_back_the_texts():
    texts = ["One.\nTwo, three's 4th!", "", "\n", "été×x", "a\n\nb c"]
    parts, counts = bpe.parts_of(texts)
    parts = parts.to_pylist()
    assert parts == ["One", ".", "\n", "Two", ",", " three's", " 4th!", "\n", "été×x", "a\n\nb", " c"]
    assert counts.tolist() == [7, 0, 1, 1, 2]


def test_words_are_encoded_once_whatever_follows_them():
    encoder = bpe.Encoder(bpe.file_spec())
    words, marks = ["th" + "on" * k for k in range(1, 30)], [".", ",", "!", ".\n", ";", "###", "$$$", "..."]
    encoder.encode("".join(f" {w}{m}" for w in words for m in marks))
    assert len(encoder.known) <= len(words) + len(marks) + 2
