"""The language model: its gradient, its probabilities, and whole scores by brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexivec.llm import attention, lm

TINY = attention.Shape(dim=4, fan=(3, 2, 3), window=5, fresh=3)


@pytest.fixture(scope="module")
def coding():
    tokenizers = pytest.importorskip("public_tokenizers")
    return lm.Coding(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(0)
    flat = TINY.start(np.arange(TINY.ids))
    net = attention.Net(TINY, flat)
    x, y, live = rng.integers(0, TINY.ids, (7, 5)).astype(np.int16), rng.integers(0, TINY.ids, (7, 5)).astype(np.int16), rng.random((7, 5)) < 0.8
    loss, g = net.gradient(x, y, live)
    assert loss == pytest.approx(-net.scores(x, y, live).sum(), rel=1e-5)
    for k in rng.choice(TINY.size, 80, replace=False):
        own, both = flat[k], []
        for d in (1e-2, -1e-2):
            flat[k] = own + np.float32(d)
            both.append(-float(net.scores(x, y, live).astype(float).sum()))
        flat[k] = own
        assert g[k] == pytest.approx((both[0] - both[1]) / 2e-2, rel=2e-2, abs=2e-2)


def test_scores_are_probabilities_of_what_comes_before():
    rng = np.random.default_rng(1)
    flat = TINY.start(np.ones(TINY.ids))
    flat += rng.normal(0, 1, len(flat)).astype(np.float32)
    net = attention.Net(TINY, flat)
    x = np.repeat(rng.integers(0, TINY.ids, (1, 5)).astype(np.int16), TINY.ids, axis=0)
    every = np.repeat(np.arange(TINY.ids, dtype=np.int16)[:, None], 5, axis=1)
    p = np.exp(net.scores(x, every, np.ones(x.shape, bool)).astype(float)).reshape(TINY.ids, 5)
    assert p.sum(axis=0) == pytest.approx(np.ones(5), abs=1e-4)
    later = x.copy()
    later[:, 3:] = (later[:, 3:] + 1) % TINY.ids
    q = np.exp(net.scores(later, every, np.ones(x.shape, bool)).astype(float)).reshape(TINY.ids, 5)
    assert q[:, :3] == pytest.approx(p[:, :3]) and np.abs(q[:, 3:] - p[:, 3:]).max() > 1e-3
    # weights far out give numbers still
    flat *= 1000
    assert np.isfinite(net.scores(x, every, np.ones(x.shape, bool))).all()


@pytest.mark.parametrize("fresh", [1, 3, 5])
def test_windows_score_each_id_once_with_its_context(fresh):
    lengths = np.array([1, 5, 6, 7, 12, 2, 40])
    ids = np.arange(lengths.sum(), dtype=np.int16)
    start, first, end = attention.windows(lengths, 5, fresh)
    _, y, live = attention.Windows(ids, ids, 5).take(start, first, end)
    assert sorted(y[live].tolist()) == ids.tolist()
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    for row, on, s in zip(y, live, start, strict=True):
        for k in np.flatnonzero(on):
            place = row[k] - begin[row[k]]
            assert k >= min(place, 5 - fresh) and s >= begin[row[k]]


def brute(rows, coding, flat):
    """(base values, score) of each row: words counted in plain Python, windows one by one."""
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for (_, t), out in zip(rows, held, strict=True) if not out for w in [*split(t), b""])
    total, different, shape = sum(counts.values()), len(counts), coding.shape
    own, net, result = lm.Pieces(coding), attention.Net(shape, flat), []
    for (i, t), out in zip(rows, held, strict=True):
        tokens = [*split(t), b""]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (different + 1))) for w in tokens)
        own.forget()
        ids = np.concatenate([_ids(own, w) for w in tokens])
        before = np.concatenate(([shape.ids - 1], ids[:-1])).astype(np.int16)
        score, at = 0.0, 0
        while at < len(ids):
            from_ = 0 if at == 0 else at - (shape.window - shape.fresh)
            to = min(from_ + shape.window, len(ids))
            x, y = np.zeros((1, shape.window), np.int16), np.zeros((1, shape.window), np.int16)
            x[0, : to - from_], y[0, : to - from_] = before[from_:to], ids[from_:to]
            live = np.zeros((1, shape.window), bool)
            live[0, at - from_ : to - from_] = True
            score += float(net.scores(x, y, live).astype(float).sum())
            at = to
        result.append((i, out, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score / np.log(10)))
    return result


def _ids(own, word):
    k = own[word]
    ids, starts, sizes = own.table()
    return ids[starts[k] : starts[k] + sizes[k]]


ROWS = [(k, " ".join(f"W{(k * j) % 23}" for j in range(k * 3))) for k in range(40)]
ROWS += [(None, "no id, no id"), (50, None), (51, ""), (52, " \t\n\x0b\x0c\r "), (3, ROWS[3][1]), (3, ROWS[3][1]), (53, "é ÀB \x85\xa0 \x1c x" * 30), (54, "long" * 3000), (55, "word " * 20_000)]


def made(spark, rows):
    return spark.createDataFrame([(i, t, 1, b"x", 0.5, True, 7) for i, t in rows], "doc_id long, text string, part int, word binary, score double, held boolean, id int")


def test_whole_scores_by_brute_force(spark, coding, monkeypatch):
    flat = coding.shape.start(np.ones(coding.shape.ids))
    flat += np.random.default_rng(2).normal(0, 0.3, len(flat)).astype(np.float32)
    monkeypatch.setattr(lm, "fit", lambda *_: flat)
    want = sorted(brute(ROWS, coding, flat), key=str)
    for words, tokens, step in ((400_000, 6_000_000, 50_000), (20, 500, 100)):
        monkeypatch.setattr(lm, "PART_WORDS", words)
        monkeypatch.setattr(lm, "PART_TOKENS", tokens)
        monkeypatch.setattr(lm, "STEP_WORDS", step)
        got = sorted((tuple(r) for r in lm.score(made(spark, ROWS).repartition(3), coding).select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
        assert sorted(r[:5] for r in got if r[0] is not None) == sorted(r[:5] for r in want if r[0] is not None) and len(got) == len(want)
        key = lambda r: (str(r[0]), r[2])
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-4)


def test_edge_tables(spark, coding):
    assert lm.score(made(spark, []), coding).count() == 0
    # the crc32 of "1" modulo 5 is 1 for some ids: all documents held out
    out = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 1][:3]
    got = lm.score(made(spark, [(k, "a b") for k in out]), coding).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and r.score < 0 for r in got) and len(got) == 3


def test_the_model_learns_from_all_training_documents(spark, coding):
    rng = np.random.default_rng(3)
    parts = ["ther", "ing", "stone", "quar", "bel", "mont"]
    texts = [(k, " ".join("".join(rng.choice(parts, 3)) for _ in range(120))) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = lm.score(docs, coding).collect()
    held = [r for r in got if r.held_out]
    start = attention.Net(coding.shape, coding.shape.start(np.ones(coding.shape.ids)))
    own = lm.Pieces(coding)
    numbers = [np.array([own[w] for w in [*t.encode().split(), b""]]) for k, t in texts if zlib.crc32(str(k).encode()) % 5 == 1]
    ids, lengths = lm.spread(own.table(), numbers)
    look = attention.Windows(ids, lm._before(ids, lengths, coding.shape.ids - 1), coding.shape.window)
    before = float(start.scores(*look.take(*attention.windows(lengths, coding.shape.window, coding.shape.fresh))).astype(float).sum()) / np.log(10)
    assert sum(r.score for r in held) > 0.6 * before and len(held) > 50
    # every training document is in one wave and one only
    since, slices = 0, []
    for upto, _ in lm.WAVES:
        slices += range(since, upto)
        since = upto
    assert slices == list(range(16))
