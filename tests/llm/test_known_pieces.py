"""What a task remembers of the pieces it has encoded."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clampspark.llm import repair
from clampspark.llm.queries import vocab
from clampspark.llm.text import load_tokenizer


class Counted:
    """A tokenizer that counts what it is asked for."""

    def __init__(self, path):
        self.tok, self.asked = load_tokenizer(path), []
        self.model = self

    def tokenize(self, piece):
        self.asked.append(piece)
        return self.tok.model.tokenize(piece)

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tok.encode_batch_fast(texts, **options)


def test_pieces_that_come_again_are_not_encoded_again(monkeypatch):
    """Beyond the room for pieces, only those that came once are forgotten; ids stay those of the library."""
    tok = Counted(vocab("byte_bpe_50k.json"))
    monkeypatch.setattr(repair, "load_tokenizer", lambda path: tok)
    monkeypatch.setattr(repair, "KNOWN_PIECES", 2000)
    rng = random.Random(5)

    def word(letters):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(4, 24)))

    common = list(dict.fromkeys(word("abcdefgh") for _ in range(300)))
    encode, rare = repair.encoder("any"), 0
    for i in range(20):
        once = list({word("qrstuvwx") for _ in range(200)})
        rare += len(once)
        text = "x " + " ".join(rng.sample(common, len(common)) + once) + " 中文" + str(i) * 3
        ids, lens = encode(pa.array([text, ""], pa.large_string()))
        assert ids.tolist() == tok.tok.encode(text, add_special_tokens=False).ids and lens.tolist() == [len(ids), 0]
    assert len(tok.asked) < rare + 2 * len(common) + 200


@pytest.mark.parametrize("letters", [b"\0a", b"abcdefgh", bytes(range(256))])
def test_known_tells_pieces_exactly(letters):
    rng = random.Random(len(letters))
    known, want, number = repair.Known(), {}, 0
    for _ in range(12):
        some = list({bytes(rng.choice(letters) for _ in range(rng.randrange(1, rng.choice([4, 10, 40])))) for _ in range(300)})
        values = pa.array(some, pa.large_binary())
        assert known.find(values).tolist() == [want.get(x, -1) for x in some]
        new = [x for x in some if x not in want]
        known.add(pa.array(new, pa.large_binary()))
        want.update(zip(new, range(len(known) - len(new), len(known))))
        number += 1
        if number % 4 == 0:
            stay = np.array([rng.random() < 0.5 for _ in range(len(known))], bool)
            known.keep(stay)
            want = {x: i for i, x in enumerate(x for x in want if stay[want[x]])}
        assert len(known) == len(want)
    known.keep(np.zeros(len(known), bool))
    assert len(known) == 0 and known.find(pa.array([b"a"], pa.large_binary())).tolist() == [-1]


def test_byte_strings():
    from clampspark.llm.text import byte_strings
    some = pa.array([b"a", b"", b"\0b", b"ccc"], pa.large_binary())
    assert byte_strings(some) == some.to_pylist() and byte_strings(some.slice(1, 2)) == [b"", b"\0b"] and byte_strings(some[:0]) == []
