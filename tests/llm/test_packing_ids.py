"""Ids of the packing's texts are those of the tokenizer on the whole text."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rankwell.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b\t c", " a  b  c d", "it's we'll, 'tis don't. x' y",
    "pasé, à-la (carte)... <|endoftext|> end<|endoftext|>, x_y_ _z, a×b, ²³, 12,5. 中文， oḱ, näive\U0001f600!",
    "a\x1cb \x85c d e\x00f, \x7f.", "!!! ?. ,a ,,", "ǅungla. ŉa, ɐb.",
]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_of_odd_texts(whole):
    rng = random.Random(5)
    signs = " \n\t  aZéǅ'.,_-7²́中<|"
    texts = TEXTS + ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    ids_of = packing._Ids(PATH)
    for _ in range(2):  # new, then remembered
        assert [a.tolist() for a in ids_of(pa.array(texts, pa.string()))] == [whole(t) for t in texts]


def test_a_word_is_encoded_once_for_all_marks_behind_it():
    ids_of = packing._Ids(PATH)
    ids_of(pa.array(["an oak, an oak. an oak!? an oak$$$"]))
    assert ids_of.memo[" oak,"] == ids_of.memo[" oak"] + ids_of.memo[","]


@pytest.mark.parametrize("texts", [[], [None], ["", None, " "]])
def test_ids_of_nothing(whole, texts):
    assert [a.tolist() for a in packing._Ids(PATH)(pa.array(texts, pa.string()))] == [whole(t) for t in texts]
