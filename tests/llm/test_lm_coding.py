"""The language model's words and ids are made for many texts at once, and are those of one at a time."""

import re

import numpy as np
import pyarrow as pa
import pytest

from lexivec.llm import attention, lm

ODD = ["", " ", "a", " Ab  aB\t", "\x0b\x0c\r\n", "it's 12 3", "q\x1cz \x85 \xa0 　x  ", "é É", "日本 日本語", "x" * 2500 + " y", "a b c " * 400, "e.g. ... !!"]


@pytest.fixture(scope="module")
def coding():
    tokenizers = pytest.importorskip("public_tokenizers")
    return lm.Coding(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def split(text: str) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_words_of_many_texts_are_those_of_each(kind):
    for texts in (ODD, ODD[::-1], [""], ["a"], []):
        whole = pa.array([b"before", *(t.encode() for t in texts)], kind)
        numbers, words, lengths = lm.taken(whole.slice(1))
        got = [[words[k] for k in some] for some in np.split(numbers, np.cumsum(lengths)[:-1])] if texts else []
        assert got == [[*split(t), lm.END] for t in texts] and len(set(words)) == len(words)


def test_stretches_hold_every_row_once(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([b"x" * (k % 7) * 10 for k in range(50)])], names=["k", "text"])
    for texts, size in ((500, 1 << 20), (3, 1 << 20), (500, 45), (4, 1)):
        monkeypatch.setattr(lm, "TAKEN_TEXTS", texts)
        monkeypatch.setattr(lm, "TAKEN_BYTES", size)
        parts = list(lm.stretches(batch, 1))
        assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(50)) and max(p.num_rows for p in parts) <= texts
        assert all(sum(map(len, p.column(1).to_pylist()[:-1])) < size for p in parts)


def test_ids_of_many_words_are_those_of_each(coding):
    words = list(dict.fromkeys(w for t in ODD for w in [*split(t), lm.END]))
    own, one = lm.Pieces(coding), lm.Pieces(coding)
    for some in (words, words[::-1], [w for w in words if w.isascii()], [lm.END], []):
        ids, sizes = own.encoded(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [one.encoded([w])[0].tolist() for w in some] or not some
        assert len(ids) == sizes.sum() and len(sizes) == len(some)


def test_words_are_encoded_by_few_calls(coding):
    own, calls = lm.Pieces(coding), []

    class Counted:
        def encode_ordinary(self, text, encode=own.encoding.encode_ordinary):
            calls.append(text)
            return encode(text)

    own.encoding = Counted()
    own.add([f"w{k}x".encode() for k in range(5000)])
    assert len(own) == 5000 and len(calls) <= 3


def test_a_net_forgets_what_it_did_before():
    shape, rng = attention.Shape(dim=4, fan=(3, 2, 3), window=5, fresh=3), np.random.default_rng(4)
    flat = shape.start(np.arange(shape.ids))
    used, made = attention.Net(shape, flat), lambda n: (*(rng.integers(0, shape.ids, (n, 5)).astype(np.int16) for _ in range(2)), rng.random((n, 5)) < 0.7)
    for n in (1, 200, 3, 130, 70):
        x, y, live = made(n)
        loss, g = used.gradient(x, y, live)
        kept, scores = g.copy(), used.scores(x, y, live)
        held = scores.copy()
        used.gradient(*made(90))
        other = attention.Net(shape, flat)
        want, h = other.gradient(x, y, live)
        assert loss == want and np.array_equal(g, h) and np.array_equal(g, kept)
        assert np.array_equal(scores, held) and np.array_equal(scores, other.scores(x, y, live))
    none = np.zeros((2, 5), bool)
    assert used.gradient(x[:2], y[:2], none)[0] == 0 and not used.gradient(x[:2], y[:2], none)[1].any() and len(used.scores(x[:2], y[:2], none)) == 0
