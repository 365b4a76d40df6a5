"""op4: a worker's tokenizer is loaded once, ordinary pieces follow one another, ids are the library's."""

import random

import pytest

from featlens.llm import tokenids
from featlens.llm.queries import TOKENIZER, vocabulary

PARTS = ["a", "b", "Z", "1", "23", "'s", "'", ".", " ", "  ", "\n", " \n", "\t", "᠎", "　", "\xa0", "\x85", "\x1c", "é", "漢", "😀",
         "<|endoftext|>", "<|end", "\0", "\r\n", "Ġ", "Ċ", "the", " the", " word"]


@pytest.mark.parametrize("marks", [True, False])
def test_ids_equal_the_library(marks):
    rng, parts = random.Random(5), [p for p in PARTS if marks or "<" not in p]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    tok = tokenids.Tokenizer(vocabulary(TOKENIZER))
    got = [x for i in range(0, len(texts), 300) for x in tok.encode(texts[i:i + 300])]
    assert [x.tolist() for x in got] == [tok.t.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_stay_from_task_to_task_but_not_after_an_error():
    path = vocabulary(TOKENIZER)
    tok = tokenids.kept(path)
    first = tok.encode(["some words here"])[0].tolist()
    handed, batch = [], tok.batch
    tok.batch = lambda texts, **k: handed.extend(texts) or batch(texts, **k)
    again = tokenids.kept(path)
    assert again is tok and again.encode(["some words here", "some words more"])[0].tolist() == first and handed == [" more"]

    def fails(texts, **k):
        raise MemoryError
    tok.batch = fails
    with pytest.raises(MemoryError):
        tok.encode(["words never seen"])
    tok.batch = batch
    assert tok.encode(["words never seen"])[0].tolist() == tok.t.encode("words never seen", add_special_tokens=False).ids
