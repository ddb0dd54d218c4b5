"""Hashes of tokens, character n-grams and word n-grams over whole Arrow batches (NumPy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Fixed values of the hashes.
FNV_START, FNV_PRIME, NGRAM_MULTIPLIER = 2166136261, 16777619, 116049371


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings or binaries without nulls, which may be a slice."""
    if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type):
        width = np.int64
    else:
        width = np.int32
    if not len(strings):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, width)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _fold(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One step: bytes are sign-extended to 32 bits."""
    return (h ^ b.view(np.int8).astype(np.int32).view(np.uint32)) * np.uint32(FNV_PRIME)


def fnv1a(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The hash of each string, all strings a byte further at each step, the longest first."""
    starts, lengths = offsets[:-1], np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, sorted_lengths = starts[order], lengths[order]
    h = np.full(len(lengths), FNV_START, np.uint32)
    k = len(lengths)
    for at in range(int(sorted_lengths[0]) if k else 0):
        k = int(np.searchsorted(-sorted_lengths[:k], -at, "left"))
        h[:k] = _fold(h[:k], data[starts[:k] + at])
    out = np.empty_like(h)
    out[order] = h
    return out.astype(np.int64)


def hash_strings(strings: pa.Array) -> pa.Array:
    """int64 hashes of strings or binaries; null stays null. Each different string is hashed once."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    coded = strings.dictionary_encode()
    h = fnv1a(*utf8(coded.dictionary))
    return pa.array(h).take(coded.indices) if len(h) else pa.nulls(len(strings), pa.int64())


def marked(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of <string> for each string."""
    offsets, data = utf8(strings)
    lengths = np.diff(offsets)
    new = np.concatenate(([0], np.cumsum(lengths + 2)))
    out = np.empty(new[-1], np.uint8)
    out[new[:-1]], out[new[1:] - 1] = ord("<"), ord(">")
    inside = np.ones(len(out), bool)
    inside[new[:-1]] = inside[new[1:] - 1] = False
    out[inside] = data[offsets[0] : offsets[-1]]
    return new, out


def char_ngrams(strings: pa.Array, minn: int, maxn: int) -> tuple[np.ndarray, np.ndarray]:
    """(string's index, hash) of the n-grams of minn to maxn code points of <string>, by place and then length; single marks are left out."""
    offsets, data = marked(strings)
    first = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
    ends = np.append(first[1:], len(data))
    of = np.searchsorted(offsets, first, "right") - 1
    # places of a string's first and last code point
    begins = np.searchsorted(first, offsets[:-1])[of]
    last = (np.append(np.searchsorted(first, offsets[:-1]), len(first))[of + 1]) - 1
    place = np.arange(len(first))
    h, live = np.full(len(first), FNV_START, np.uint32), np.ones(len(first), bool)
    hashes, good = np.zeros((len(first), max(maxn, 0)), np.int64), np.zeros((len(first), max(maxn, 0)), bool)
    for n in range(1, maxn + 1):
        live &= place + n - 1 <= last
        at = np.flatnonzero(live)
        s, e = first[at + n - 1], ends[at + n - 1]
        for k in range(4):
            more = s + k < e
            h[at[more]] = _fold(h[at[more]], data[s[more] + k])
        hashes[:, n - 1] = h
        good[:, n - 1] = live & (n >= minn)
        if n == 1:
            good[:, 0] &= (place != begins) & (place != last)
    return np.broadcast_to(of[:, None], good.shape)[good], hashes[good]


def ngram_lists(strings: pa.Array, minn: int, maxn: int, bucket: int) -> pa.Array:
    """The bucket ids of the n-grams of each string, as lists; each different string is taken apart once."""
    coded = strings.dictionary_encode()
    of, h = char_ngrams(coded.dictionary, minn, maxn)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(coded.dictionary)))))
    return to_lists(offsets, h % bucket).take(coded.indices)


def word_ngrams(offsets: np.ndarray, hashes: np.ndarray, n: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bucket ids) of the spans of 2 to n tokens of each line, by first token and then length.

    Hashes are read as signed 32-bit numbers and rolled into unsigned 64 bits.
    """
    wide = hashes.astype(np.uint32).view(np.int32).astype(np.int64).view(np.uint64)
    size, times = len(wide), max(n - 1, 0)
    ids, good = np.zeros((size, times), np.int64), np.zeros((size, times), bool)
    end = np.repeat(offsets[1:], np.diff(offsets))
    h = wide.copy()
    for k in range(1, n):
        live = np.arange(size) + k < end
        at = np.flatnonzero(live)
        h[at] = h[at] * np.uint64(NGRAM_MULTIPLIER) + wide[at + k]
        ids[at, k - 1] = (h[at] % np.uint64(bucket)).astype(np.int64)
        good[:, k - 1] = live
    counts = np.concatenate(([0], np.cumsum(good.sum(axis=1))))
    return counts[offsets], ids[good]


def list_parts(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of an array of lists, which may be a slice; null lists count as empty."""
    if lists.null_count:
        lists = lists.fill_null(pa.scalar([], lists.type))
    at = np.asarray(lists.offsets, np.int64)
    return at - at[0], lists.values.slice(int(at[0]), int(at[-1] - at[0]))


def to_lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 for all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the lists of all parts put together line by line."""
    sizes = [np.diff(o) for o, _ in parts]
    offsets = np.concatenate(([0], np.cumsum(sum(sizes))))
    out, at = np.empty(offsets[-1], np.int64), offsets[:-1].copy()
    for (o, v), n in zip(parts, sizes, strict=True):
        out[ranges(at, n)] = v[o[0] : o[-1]]
        at += n
    return offsets, out


def kept(offsets: np.ndarray, values: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists without the values that aren't good."""
    return np.concatenate(([0], np.cumsum(good)))[offsets], values[good]
