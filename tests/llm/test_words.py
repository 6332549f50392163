"""Texts looked up word by word have the ids of the whole text; others are told apart."""

import pytest

from helicase.llm.tokens import Encoder

EVEN = ["a", "a b", "a\nb c", "one. two,\nthree", "été x\ny"]
UNEVEN = [" a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "a\x0bb", "a\x1cb", "a b", "a\r\nb", "\n", " "]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(vocabulary):
    enc = Encoder(vocabulary)
    texts = [*EVEN, *UNEVEN, "", "x\0y"]
    assert [len(x) // 4 for x in enc.encode(texts)] == [len(enc.tok.encode(x, add_special_tokens=False).ids) for x in texts]
    assert enc.encode(texts) == [enc._whole(x) if x else b"" for x in texts]
    assert all(enc._words(x) for x in EVEN) and not any(enc._words(x) for x in UNEVEN)


def test_lines_are_looked_up_in_one_list():
    enc = Encoder("byte_bpe_50k.json")
    assert enc._words("a b\nc") == ["a", " b", "\n", "c"]
