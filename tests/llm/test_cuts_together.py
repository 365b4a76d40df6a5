"""Stretches of text go through the tokenizer file's rules together."""

import pytest

from featlens.llm import wordbpe
from featlens.llm.queries import WORD_ENDS, vocabulary


@pytest.fixture(scope="module")
def v():
    return wordbpe.parsed(wordbpe.load(vocabulary(WORD_ENDS)))


def test_stretches_are_cut_as_one_by_one(v, monkeypatch):
    odd = ["", "a", "It's", "Don'T,", "x1y22", "...!?", "''s", "Été", "é", "́e", "a b", " ", "　x", "\x0b", "a\x0cb", "İI", "ΣΣ",
           "中文", "\U0001f600x", "‍z", "\x00", "ﬁn", "ͅ", "가", "<|endoftext|>"]
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(wordbpe, "TOGETHER", size)
        assert v.cuts(odd) == [v.cut(s) for s in odd]
    assert v.cuts([]) == []


def test_plain_stretches_go_through_the_rules_together(v, monkeypatch):
    texts = ["Some plain words, cut together: café 4you", None, ""]
    whole = [x.tolist() for x in wordbpe.Encoder(v).encode(texts)]
    monkeypatch.setattr(wordbpe.Vocabulary, "cut", lambda *a: pytest.fail("cut alone"))
    assert [x.tolist() for x in wordbpe.Encoder(v).encode(texts)] == whole and whole[0] and not whole[1] + whole[2]
