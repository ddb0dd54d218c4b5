"""A small causal self-attention model of subword ids, in NumPy: its steps and its scores.

One layer: the input of a place is the id before it and the place's number in the window;
each place attends to itself and those before it, and from what it has then the next id is
told by a choice of a class of ids and one of an id in it, each a softmax, so that a score
is a logarithm of a probability over all ids.

Long sequences are cut into windows. In training they follow each other; in scoring they
overlap, and a window scores only the ids that the one before didn't reach, so each id is
scored once and has a context of at least window - fresh ids where there are so many.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import prod

import numpy as np

#: What exp() is taken of is held between this and its negative, for a choice and for its alternatives alike.
_TOP = np.float32(30)
#: Windows that are taken at once up to the choices and back from them, so that what they need stays near the processor.
ATTEND_WINDOWS = 64
#: Weights that are stepped at once, likewise.
ADAM_BLOCK = 16384


@dataclass(frozen=True)
class Shape:
    """Ids are 0 to ids - 1; the last one is the end of a text, which also stands before its beginning."""

    dim: int = 16
    fan: tuple[int, ...] = (16, 16, 16)
    window: int = 32
    fresh: int = 24

    @property
    def ids(self) -> int:
        return prod(self.fan)

    @cached_property
    def layout(self) -> list[tuple[str, tuple[int, ...]]]:
        d = self.dim
        choices = [(prod(self.fan[:k]), n) for k, n in enumerate(self.fan)]
        out = [("embed", (self.ids, d)), ("place", (self.window, d)), ("qkv", (d, 3 * d)), ("out", (d, d))]
        # the last column of a choice is what it has without a context
        return out + [(f"u{k}", (*c, d + 1)) for k, c in enumerate(choices)]

    @property
    def size(self) -> int:
        return sum(prod(s) for _, s in self.layout)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.layout:
            n = prod(shape)
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, counts: np.ndarray, seed: int = 7) -> np.ndarray:
        """The weights before training: the choices without a context give each id its share of ``counts`` (by id, one added), the rest is small and random."""
        rng = np.random.default_rng(seed)
        flat = np.zeros(self.size, np.float32)
        own = self.views(flat)
        for name in ("embed", "place", "qkv", "out"):
            own[name][:] = rng.normal(0, 0.3 if name == "embed" else 0.1, own[name].shape)
        for k in range(len(self.fan)):
            u = own[f"u{k}"]
            n = (counts + 1.0).reshape(*u.shape[:2], -1).sum(axis=2)
            u[:, :, self.dim] = np.log(n / n.sum(axis=1, keepdims=True))
        return flat


def windows(lengths: np.ndarray, size: int, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, first, end) of the windows of sequences that follow each other: they hold start .. start + size - 1, end at most, and are to tell start + first and all after it."""
    n = np.where(lengths <= size, lengths > 0, 1 + -(-(lengths - size) // fresh))
    of = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(lengths) - lengths
    start = begin[of] + k * fresh
    return start, np.where(k > 0, size - fresh, 0), np.minimum(start + size, begin[of] + lengths[of])


class Net:
    """A model with its weights, which are used as they are at each call."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.w = shape.views(flat)
        self.causal = np.tril(np.ones((shape.window, shape.window), np.float32))
        levels = [self.w[f"u{k}"] for k in range(len(shape.fan))]
        self.choices = [(list(u), list(u.transpose(0, 2, 1))) for u in levels]
        self.picks = [np.arange(shape.ids) // prod(shape.fan[k + 1 :]) % n for k, n in enumerate(shape.fan)]
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that the next call with this name writes over; new memory for each step costs more than its arithmetic."""
        n, held = prod(shape), self.rooms.get(name)
        if held is None or held.size < n:
            held = self.rooms[name] = np.empty(n, np.float32)
        return held[:n].reshape(shape)

    def attend(self, x: np.ndarray, h: np.ndarray, name: str = "") -> tuple:
        """Write to h [n, window, dim + 1] what each place of windows of ids x [n, window] has after attention, and a 1; what the way back needs, until the next call with this name."""
        w, (n, size), d = self.w, x.shape, self.shape.dim
        own, qkv = self.room(f"own{name}", n, size, d), self.room(f"qkv{name}", n, size, 3 * d + 1)
        np.take(w["embed"], x, axis=0, out=own, mode="clip")
        own += w["place"]
        np.matmul(own.reshape(-1, d), w["qkv"], out=qkv.reshape(-1, 3 * d + 1)[:, : 3 * d])
        qkv[:, :, 3 * d] = 1  # stands behind the values, so it adds up the weights
        q, k, v = qkv[:, :, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
        s = np.matmul(q, k.transpose(0, 2, 1), out=self.room(f"s{name}", n, size, size))
        _bound(s)
        np.exp(s, out=s)
        s *= self.causal
        sums = np.matmul(s, v, out=self.room("sums", n, size, d + 1))
        r = np.divide(1, sums[:, :, d:], out=self.room(f"r{name}", n, size, 1))
        c = np.multiply(sums[:, :, :d], r, out=self.room(f"c{name}", n, size, d))
        np.add(np.dot(c.reshape(-1, d), w["out"], self.room("turned", n * size, d)).reshape(n, size, d), own, out=h[:, :, :d])
        h[:, :, d] = 1
        return own, q, k, v, s, c, r

    def choose(self, h: np.ndarray, at: np.ndarray, ids: np.ndarray, out: dict | None = None):
        """The logarithms of the probabilities of ids after the rows ``at`` of h [places, dim + 1].

        With ``out``: in another order, with the gradient of -their sum by h; that by the choices' weights goes to ``out``.
        """
        width, fan, n = h.shape[1], self.shape.fan, len(ids)
        order = np.argsort(ids, kind="stable")
        code, at = ids[order].astype(np.int64), at[order]
        own = np.take(h, at, axis=0, out=self.room("told", n, width), mode="clip")
        total, rows, often = np.zeros(n, np.float32), np.arange(n), np.bincount(code, minlength=self.shape.ids)
        back, more = (self.room("back", n + 1, width), self.room("more", n, width)) if out is not None else (None, None)
        for level, size in enumerate(fan):
            straight, turned = self.choices[level]
            ends = np.cumsum(often.reshape(len(straight), -1).sum(axis=1))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            ends = ends[some].tolist()
            spans = list(zip(some.tolist(), [0, *ends[:-1]], ends, strict=True)) if n else []
            pick = rows * size
            pick += self.picks[level][code]
            p = self.room(f"p{level}", n, size)
            for g, i, j in spans:
                np.dot(own[i:j], turned[g], p[i:j])
            _bound(p)
            each = p.reshape(-1)
            total += each[pick]
            np.exp(p, out=p)
            sums = p @ np.ones(size, np.float32)
            total -= np.log(sums)
            if out is not None:
                p *= (1 / sums)[:, None]
                each[pick] -= 1
                du, to = list(out[f"u{level}"]), more if level else back
                for g, i, j in spans:
                    q = p[i:j]
                    np.dot(q.T, own[i:j], du[g])
                    np.dot(q, straight[g], to[i:j])
                if level:
                    back[:n] += more
        if out is not None:
            back[n] = 0
            where = np.full(len(h), n)
            where[at] = rows
            return total, np.take(back, where, axis=0, out=self.room("two", *h.shape), mode="clip")
        told = np.empty_like(total)
        told[order] = total
        return told

    def gradient(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, np.ndarray]:
        """(-sum of log probabilities of the ids y at live places of windows x, its gradient)."""
        w, d, (n, size) = self.w, self.shape.dim, x.shape
        blocks = [slice(k, min(k + ATTEND_WINDOWS, n)) for k in range(0, n, ATTEND_WINDOWS)]
        h = self.room("h", n, size, d + 1)
        held = [self.attend(x[b], h[b], str(k)) for k, b in enumerate(blocks)]
        flat = np.zeros_like(self.flat)
        out = self.shape.views(flat)
        p, two = self.choose(h.reshape(-1, d + 1), np.flatnonzero(live), y[live], out)
        for b, (own, q, k, v, s, c, r) in zip(blocks, held, strict=True):
            m, some = len(own), two[b.start * size : b.stop * size, :d]
            out["out"] += np.dot(c.reshape(-1, d).T, some)
            dc = np.dot(some, w["out"].T, self.room("turned", m * size, d)).reshape(m, size, d)
            # the last column, against the ones behind the values, takes the mean off
            wide = self.room("wide", m, size, d + 1)
            dv = np.multiply(dc, r, out=wide[:, :, :d])
            np.negative(np.einsum("nsd,nsd->ns", dv, c), out=wide[:, :, d])
            ds = np.matmul(wide, v.transpose(0, 2, 1), out=self.room("ds", m, size, size))
            ds *= s
            dqkv = self.room("dqkv", m, size, 3 * d)
            np.matmul(ds, k, out=dqkv[:, :, :d])
            np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, d : 2 * d])
            np.matmul(s.transpose(0, 2, 1), dv, out=dqkv[:, :, 2 * d :])
            dqkv = dqkv.reshape(-1, 3 * d)
            out["qkv"] += np.dot(own.reshape(-1, d).T, dqkv)
            some += np.dot(dqkv, w["qkv"].T, self.room("turned", m * size, d))
        out["place"][:] = (np.ones(n, np.float32) @ two.reshape(n, -1)).reshape(size, d + 1)[:, :d]
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        two = np.take(two, order, axis=0, out=self.room("sorted", n * size, d + 1), mode="clip")
        out["embed"][ids[first]] = np.add.reduceat(two, first, axis=0)[:, :d]
        return -float(p.sum(dtype=np.float64)), flat

    def scores(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The natural logarithms of the probabilities of the ids y at live places of windows x, in their order."""
        h = self.room("h", *x.shape, self.shape.dim + 1)
        for k in range(0, len(x), ATTEND_WINDOWS):
            self.attend(x[k : k + ATTEND_WINDOWS], h[k : k + ATTEND_WINDOWS])
        return self.choose(h.reshape(-1, self.shape.dim + 1), np.flatnonzero(live), y[live])


def _bound(a: np.ndarray) -> None:
    if a.size and (a.max() > _TOP or a.min() < -_TOP):
        np.clip(a, -_TOP, _TOP, out=a)


class Adam:
    """Steps by running means of gradients and of their squares."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.rate, self.n = np.zeros(size, np.float32), np.zeros(size, np.float32), rate, 0

    def step(self, flat: np.ndarray, g: np.ndarray, rate: float | None = None) -> None:
        self.n += 1
        scale = np.float32((self.rate if rate is None else rate) * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n))
        for k in range(0, len(flat), ADAM_BLOCK):
            m, v, own = (a[k : k + ADAM_BLOCK] for a in (self.m, self.v, g))
            t = own - m
            t *= np.float32(0.1)
            m += t
            np.multiply(own, own, out=t)
            t -= v
            t *= np.float32(0.01)
            v += t
            np.sqrt(v, out=t)
            t += np.float32(1e-7)
            np.divide(m, t, out=t)
            t *= scale
            flat[k : k + ADAM_BLOCK] -= t


class Windows:
    """Windows over ids and the ids before each."""

    def __init__(self, ids: np.ndarray, before: np.ndarray, size: int):
        self.place = np.arange(size)
        wide = lambda a: np.lib.stride_tricks.sliding_window_view(np.concatenate((a, np.zeros(size, a.dtype))), size)
        self.ids, self.before = wide(ids), wide(before)

    def take(self, start: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, live) of windows; places after the end have what follows there and aren't live."""
        live = (self.place < (end - start)[:, None]) & (self.place >= first[:, None])
        return self.before[start], self.ids[start], live
