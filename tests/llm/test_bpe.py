"""The encoder against its library, on adversarial texts and on the lexicon's own words."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.load(PATH)
HARD = ["", " ", "Of%%% athe*** erntwh.%%%", "don't I'LL we've 12three", "a<|endoftext|>b <|startoftext|>", "Ünïcödé é é ﬁ Σίσυφος İstanbul ǅ", "中文 テスト x　y\x1cz\x85w", "x" * 300, "#$%" * 100, "😀👍🏽 ok", "́á", "<|endof", "'s't're"]


def check(text: str) -> None:
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == want
    assert OURS.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbet 's\n.,é<|>endoftext")), max_size=60))
def test_any(text):
    check(text)


def test_lexicon_is_a_minimal_perfect_hash():
    some = [w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "été"]]
    words = dict(zip(some, OURS.words(some), strict=True))
    lexicon = bpe.Lexicon.map(bpe.Lexicon.build(words).dump())
    ranks = lexicon.rank([*sorted(words), b"to", b"topss", b"", b"x"])
    assert ranks.tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert lexicon.outputs(np.arange(len(words))) == [words[w] for w in sorted(words)]
    assert lexicon.states < sum(map(len, words))
    assert bpe.Lexicon.map(bpe.Lexicon.build({}).dump()).rank([b"a"]).tolist() == [-1]


def test_long_pieces_merge_alike():
    for piece in ("x" * 65, "thequickbrownfox" * 20, "aab" * 200):
        check(piece)


def test_many_words_merge_as_one_by_one():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß.,-'", k=rng.randint(1, 20))).encode() for _ in range(3000)]
    together = OURS.words(words)
    assert together == [x for w in words for x in OURS.words([w])]
    assert [np.frombuffer(x, "<u4").tolist() for x in together] == [LIBRARY.encode(w.decode(), add_special_tokens=False).ids for w in words]
