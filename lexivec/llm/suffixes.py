"""Removal of repeated byte strings by a distributed, prefix-aware merge sort of suffixes.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a
smaller id. Only suffixes at anchors are sorted: in every window of SPAN bytes the anchor
is the place of the smallest hash of GRAM bytes, so equal windows have equal anchors, and
consecutive windows share theirs. Steps, all over parts of the documents of bounded size:

1. Each part sends the hashes of its anchors' first GRAM bytes; those that no other
   document has are dropped, as their suffixes are told apart by these bytes already.
2. Each part sorts the suffixes of the other anchors (up to the end of the anchor's last
   window, followed by what stands before the anchor, backwards), keeps equal ones once
   with their smallest document, and sends them as front-coded sorted runs: the length of
   the prefix shared with the one before, and the rest.
3. Runs are combined by loser trees that carry the shared prefix lengths; prefixes known
   to be equal are never compared again. Equal windows are runs of neighbours in merged
   order whose common prefixes are long enough, so they are read off these lengths, and
   the smallest document of each is found.
4. Each part gets its runs' verdicts back and cuts its documents.

First bytes that are found in very many contexts (a phrase of a third of the documents)
would all be settled by one task. Their anchors send each window as a suffix of its own,
dealt to the buckets by its bytes: equal windows still meet, different ones needn't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, GRAM = 50, 16
#: Bytes of documents in a part, on average; a part is one task's work and memory.
PART_BYTES = 8 << 20
#: Different contexts of an anchor's first bytes, counted in each part and summed, beyond which its windows are dealt one by one.
HOT_CONTEXTS = 8192
#: Bytes looked at together when anchors are sought.
BLOCK = 1 << 17
_LAST = 2**63 - 1  # the place of a null id: after all others
_ONE = [bytes((k,)) for k in range(SPAN)]
_AT = np.uint64(18)  # low bits that hold a position in a block

_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    h, n = _TABLE[data], 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(_MULTIPLIER, n, 2**64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of documents laid end to end: arrays place, first window, last window, hash, hash of the context.

    An anchor whose windows lie on both sides of a block's border is given twice.
    """
    place, first, last, hashes, contexts = [], [], [], [], []
    for a in range(0, len(data) - SPAN + 1, BLOCK - SPAN + 1):
        block = data[a : a + BLOCK]
        if len(block) < SPAN:
            break
        h = gram_hashes(block)
        low = (h >> _AT << _AT) | np.arange(len(h), dtype=np.uint64)
        width, n = SPAN - GRAM + 1, 1
        while 2 * n <= width:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        low = np.minimum(low[: len(block) - SPAN + 1], low[width - n : width - n + len(block) - SPAN + 1])
        start = np.arange(len(low)) + a
        inside = start + SPAN <= ends[np.searchsorted(ends, start, "right").clip(max=len(ends) - 1)]
        start, at = start[inside], (low[inside] & np.uint64((1 << int(_AT)) - 1)).astype(np.int64)
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
        place.append(at[new] + a)
        first.append(start[new])
        last.append(start[np.append(new[1:], len(at)) - 1])
        hashes.append(h[at[new]])
        contexts.append(h[first[-1] - a] * np.uint64(_MULTIPLIER) ^ h[last[-1] - a + SPAN - GRAM])
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(place, np.int64), cat(first, np.int64), cat(last, np.int64), cat(hashes, np.uint64), cat(contexts, np.uint64)


class Part:
    """The documents of one part, laid end to end, and their anchors."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = np.array([_LAST if x is None else x for x in ids], np.int64)
        self.data = b"".join(texts)
        self.ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        self.place, self.first, self.last, self.hash, self.context = anchors(np.frombuffer(self.data, np.uint8), self.ends)
        self.doc = np.searchsorted(self.ends, self.first, "right")
        # anchors are the smallest hashes of their windows; mixed anew they spread evenly over buckets
        self.short = self.hash * np.uint64(_MULTIPLIER) >> np.uint64(16)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different hashes (48 bits, sorted), whether several ids of this part have each, and in how many contexts (as a power of two)."""
        order = np.lexsort((self.context, self.short))
        own, ids, context = self.short[order], self.ids[self.doc[order]], self.context[order]
        if not len(own):
            return own, np.empty(0, bool), np.empty(0, np.uint8)
        new = np.concatenate(([True], own[1:] != own[:-1]))
        starts = np.flatnonzero(new)
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        different = np.add.reduceat((new | np.concatenate(([True], context[1:] != context[:-1]))).astype(np.int64), starts)
        return own[starts], several, np.log2(different).astype(np.uint8)

    def shared(self, bits: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of the anchors whose hash other documents have: document, first window, suffix, bucket. Hot ones give each window alone."""
        own, at = np.unique(self.short, return_inverse=True)
        edges = bucket_edges(own, buckets)
        kept, hot = np.zeros(len(own), bool), np.zeros(len(own), bool)
        for b, s, e in zip(range(buckets), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b in bits:
                told, n = np.frombuffer(bits[b], np.uint8), (e - s + 7) // 8
                kept[s:e] = np.unpackbits(told[:n], count=e - s)
                if len(told) > n:
                    hot[s:e] = np.unpackbits(told[n:], count=e - s)
        hit = np.flatnonzero(kept[at])
        alone = np.flatnonzero(hot[at])
        hit = hit[~hot[at[hit]]] if len(alone) else hit
        doc, first, place, last = self.doc[hit], self.first[hit], self.place[hit], self.last[hit]
        suffixes = self._suffixes(place, first, last)
        bucket = np.searchsorted(edges[1:], at[hit], "right")
        if len(alone):
            times = self.last[alone] - self.first[alone] + 1
            window = np.repeat(self.first[alone] - np.cumsum(times) + times, times) + np.arange(times.sum())
            more = self._suffixes(np.repeat(self.place[alone], times), window, window)
            doc, first = np.concatenate((doc, np.repeat(self.doc[alone], times))), np.concatenate((first, window))
            bucket = np.concatenate((bucket, np.array([zlib.crc32(x) for x in more], np.int64) % buckets))
            suffixes += more
        return doc, first, suffixes, bucket

    def _suffixes(self, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """What stands from each place to the end of the last window, then what stands before it from the first on, backwards, and its length."""
        data = self.data
        return [data[p:z] + data[f:p][::-1] + _ONE[p - f] for p, f, z in zip(place.tolist(), first.tolist(), (last + SPAN).tolist(), strict=True)]


def bucket_edges(own: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the buckets of 48-bit hashes begins in a sorted array, and its length."""
    limits = np.array([(b << 48) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(own, limits), [len(own)]))


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Of sorted suffixes: shared prefix lengths, lengths of the rests, the rests."""
    if not suffixes:
        return b"", b"", b""
    lengths = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    width = int(lengths.max()) + 1  # a column more, which always differs
    rows = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in suffixes]), np.uint8).reshape(-1, width)
    differ = rows[1:] != rows[:-1]
    differ[:, -1] = True
    shared = np.concatenate(([0], np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1]))))
    return shared.astype(np.uint8).tobytes(), (lengths - shared).astype(np.uint8).tobytes(), b"".join([x[k:] for x, k in zip(suffixes, shared.tolist(), strict=True)])


def front_decode(shared: bytes, lengths: bytes, rests: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for k, n in zip(shared, lengths, strict=True):
        before = before[:k] + rests[at : at + n]
        at += n
        out.append(before)
    return out


def merge(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(suffix, prefix shared with the one before, run, position) of sorted runs, in order.

    A loser tree; with each string it keeps the length of the prefix shared with the last
    winner. Of two strings the one that shares more with it is smaller; only if they share
    the same are they compared, from there on, and the loser keeps the length found.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at, losers = [0] * k, [0] * k
    strings = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (k - len(runs))
    shared = [0 if r[0] else -1 for r in runs] + [-1] * (k - len(runs))  # -1: the run is at its end, it shares less than any

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        n, m = shared[a], shared[b]
        if n != m or n < 0:
            return (a, b) if n >= m else (b, a)
        x, y = strings[a], strings[b]
        c = shared_prefix(x, y, n)
        if x[c : c + 1] <= y[c : c + 1]:  # empty at a string's end, which is smallest
            shared[b] = c
            return a, b
        shared[a] = c
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    best = build(1)
    while (n := shared[best]) >= 0:
        run, place = best, at[best]
        yield strings[run], n, run, place
        suffixes, prefixes = runs[run]
        at[run] = place = place + 1
        if place < len(suffixes):
            strings[run], shared[run] = suffixes[place], prefixes[place]
        else:
            shared[run] = -1
        n = shared[run]
        node = (run + k) // 2
        while node:
            other = losers[node]
            m = shared[other]
            if m > n:
                losers[node], best, n = best, other, m
            elif m == n and n >= 0:
                best, losers[node] = play(best, other)
            node //= 2


def classes(shared: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the runs of neighbours that share at least so many bytes with the one before."""
    return np.cumsum(shared < least)


def backwards(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, prefix shared with the one before, length) of what stands before the anchors, read backwards, in sorted order."""
    size = -(-SPAN // 8) * 8
    lengths = np.fromiter((x[-1] for x in suffixes), np.int64, len(suffixes))
    rows = np.frombuffer(b"".join([x[-1 - x[-1] : -1].ljust(size, b"\0") for x in suffixes]), np.uint8).reshape(-1, size)
    order = np.lexsort(rows.view(">u8").astype(np.uint64).T[::-1])
    own = rows[order]
    differ = own[1:] != own[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return order, np.concatenate(([-1], shared)), lengths


def verdicts(runs: list[tuple[list[bytes], bytes, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run (sizes, documents): the smallest document of each window of each of its suffixes, the first window first; one number if all are equal.

    A window that begins o bytes before its anchor is the first SPAN - o bytes of the
    suffix and the o bytes before it. Two of them are equal if in merged order all
    neighbours between them share SPAN - o bytes or more, and if the same holds for o
    bytes in the order of what stands before the anchors. So repeats are read off the
    common prefixes of neighbours, which merging gives.
    """
    strings, shared, at = [], [], []
    for s, n, r, k in merge([x[:2] for x in runs]):
        strings.append(s)
        shared.append(n)
        at.append((r, k))
    empty = (np.empty(0, np.uint8), np.empty(0, np.int64))
    if not strings:
        return [empty for _ in runs]
    common = np.array(shared, np.int64)
    common[0] = -1
    run, place = np.array(at, np.int64).T
    order, before, left = backwards(strings)
    firsts = np.cumsum([0, *(len(r[0]) for r in runs)])
    doc = np.concatenate([r[2] for r in runs])[firsts[run] + place]
    right = np.fromiter(map(len, strings), np.int64, len(strings)) - 1 - left
    least = SPAN - right  # the last window begins so many bytes before the anchor
    sizes = left - least + 1
    starts = np.cumsum(sizes) - sizes
    found = np.empty(int(sizes.sum()), np.int64)
    back = np.empty(len(strings), np.int64)
    for o in range(int(left.max()) + 1):
        due = np.flatnonzero((least <= o) & (o <= left))
        if not len(due):
            continue
        back[order] = classes(before, o)
        key = classes(common, SPAN - o)[due] * (len(strings) + 1) + back[due]
        by = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        lowest = np.minimum.reduceat(doc[due[by]], np.flatnonzero(new))
        found[starts[due[by]] + left[due[by]] - o] = lowest[np.cumsum(new) - 1]
    one = np.minimum.reduceat(found, starts) == np.maximum.reduceat(found, starts)
    kept = np.where(one, 1, sizes)
    # back to the order of each run
    of = np.argsort(firsts[run] + place)
    steps = np.repeat(starts[of], kept[of]) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept[of]) - kept[of], kept[of])
    values, sized = found[steps], kept[of].astype(np.uint8)
    ends = np.concatenate(([0], np.cumsum(kept[of])))[firsts]
    return [(sized[firsts[k] : firsts[k + 1]], values[ends[k] : ends[k + 1]]) for k in range(len(runs))]


def _pack(*arrays: bytes) -> bytes:
    return zlib.compress(b"".join(len(a).to_bytes(4, "little") + a for a in arrays), 1)


def _unpack(data: bytes) -> list[bytes]:
    data, out, at = zlib.decompress(data), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


_SENT = "part long, bucket long, kind int, data binary"
_SENT_ARROW = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_OUT = "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_BITS, _RUN, _VERDICT = 0, 1, 2


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT_ARROW, strict=True)], schema=_SENT_ARROW)


def _ordered(docs: pa.Table) -> pa.Table:
    """A part's documents in an order of their own, as shuffles give rows in any; blocks, and so suffixes, depend on it."""
    return docs.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])


def _part(docs: pa.Table) -> Part:
    return Part(docs["id"].to_pylist(), docs["text"].to_pylist())


def _runs(suffixes: list[bytes], bucket: np.ndarray) -> tuple[list[bytes], dict[int, np.ndarray], np.ndarray]:
    """(different suffixes, of each bucket their positions there in sorted order, of each suffix its position there)."""
    index: dict[bytes, int] = {}
    at = np.array([index.setdefault(x, len(index)) for x in suffixes], np.int64)
    keys = list(index)
    of = np.zeros(len(keys), np.int64)
    of[at] = bucket
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1]))) if len(keys) else []
    runs = {}
    for own in np.split(order, starts[1:]) if len(keys) else []:
        runs[int(of[own[0]])] = np.array(sorted(own.tolist(), key=keys.__getitem__), np.int64)
    return keys, runs, at


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(id, n_bytes, spans, kept) for each row of docs: removed byte runs and the bytes that are left.

    Null text counts as empty. Rows of the same id are one document: they take nothing
    from each other. Null ids come after all ids and take nothing from each other. Texts
    under SPAN bytes are kept whole. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // part_bytes))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", F.length("text")), F.lit(parts)).cast("long"))

    def hashes(docs: pa.Table) -> pa.Table:
        part, number = _part(docs), docs["part"][0].as_py()
        own, several, contexts = part.hashes()
        edges = bucket_edges(own, parts)
        six = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :6])
        return _sent([(number, b, _BITS, _pack_raw(six[s:e].tobytes(), (several[s:e].astype(np.uint8) << 7 | contexts[s:e]).tobytes())) for b, (s, e) in enumerate(zip(edges, edges[1:], strict=False)) if e > s])

    def repeated(sent: pa.Table) -> pa.Table:
        packs = [_unpack_raw(x) for x in sent["data"].to_pylist()]
        sizes = [len(a) // 6 for a, _ in packs]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(a for a, _ in packs), np.uint8).reshape(-1, 6)
        marks = np.frombuffer(b"".join(m for _, m in packs), np.uint8)
        _, of, counts = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        many = counts > 1
        many[of[marks > 127]] = True
        # each part's count is at least half of the true one
        crowded = np.bincount(of, np.exp2(marks & 127, dtype=np.float32)) > hot_contexts
        hit, hot, out, at = many[of], (many & crowded)[of], [], 0
        for part, n in zip(sent["part"].to_pylist(), sizes, strict=True):
            if hit[at : at + n].any():
                more = np.packbits(hot[at : at + n]).tobytes() if hot[at : at + n].any() else b""
                out.append((part, sent["bucket"][0].as_py(), _BITS, np.packbits(hit[at : at + n]).tobytes() + more))
            at += n
        return _sent(out)

    def bits_of(sent: pa.Table) -> dict[int, bytes]:
        return {b: d for b, k, d in zip(sent["bucket"].to_pylist(), sent["kind"].to_pylist(), sent["data"].to_pylist(), strict=True) if k == _BITS}

    def runs(docs: pa.Table, sent: pa.Table) -> pa.Table:
        if not docs.num_rows or not sent.num_rows:
            return _sent([])
        part, number = _part(_ordered(docs)), docs["part"][0].as_py()
        doc, _, suffixes, bucket = part.shared(bits_of(sent), parts)
        keys, runs, at = _runs(suffixes, bucket)
        smallest = np.full(len(keys), _LAST, "<i8")
        np.minimum.at(smallest, at, part.ids[doc])
        return _sent([(number, b, _RUN, _pack(*front_code([keys[k] for k in own.tolist()]), smallest[own].tobytes())) for b, own in runs.items()])

    def merged(sent: pa.Table) -> pa.Table:
        read = [_unpack(x) for x in sent["data"].to_pylist()]
        found = verdicts([(front_decode(*x[:3]), x[0], np.frombuffer(x[3], "<i8")) for x in read])
        bucket = sent["bucket"][0].as_py()
        return _sent([(part, bucket, _VERDICT, _pack(sizes.tobytes(), told.astype("<i8").tobytes())) for part, (sizes, told) in zip(sent["part"].to_pylist(), found, strict=True)])

    def removed(docs: pa.Table, sent: pa.Table) -> pa.Table:
        docs = _ordered(docs) if docs.num_rows else docs
        spans: dict[int, np.ndarray] = {}
        texts = docs["text"].to_pylist()
        if docs.num_rows and sent.num_rows:
            part = _part(docs)
            doc, first, suffixes, bucket = part.shared(bits_of(sent), parts)
            keys, runs, at = _runs(suffixes, bucket)
            size, start, values, filled = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [np.empty(0, "<i8")], 0
            for b, k, data in zip(sent["bucket"].to_pylist(), sent["kind"].to_pylist(), sent["data"].to_pylist(), strict=True):
                if k == _VERDICT:
                    sizes, told = (np.frombuffer(x, t) for x, t in zip(_unpack(data), ("<u1", "<i8"), strict=True))
                    own = runs[b]
                    if len(own) != len(sizes) or sizes.sum(dtype=np.int64) != len(told):
                        raise ValueError("verdicts don't fit the runs")
                    size[own] = sizes
                    start[own] = filled + np.cumsum(sizes, dtype=np.int64) - sizes
                    values.append(told)
                    filled += len(told)
            if (size == 0).any():
                raise ValueError("runs without verdicts")
            least, ids = np.concatenate(values), part.ids[doc]
            # of suffixes with one verdict all windows go or none; of others each on its own
            one = np.flatnonzero(size[at] == 1)
            one = one[least[start[at[one]]] < ids[one]]
            length = np.fromiter(map(len, keys), np.int64, len(keys))
            each = np.flatnonzero(size[at] > 1)
            times = size[at[each]]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            gone = least[np.repeat(start[at[each]], times) + step] < np.repeat(ids[each], times)
            window = (np.repeat(first[each], times) + step)[gone]
            change = np.zeros(len(part.data) + 1, np.int32)
            np.add.at(change, np.concatenate((first[one], window)), 1)
            np.add.at(change, np.concatenate((first[one] + length[at[one]] - 1, window + SPAN)), -1)
            gone = np.concatenate(([0], np.cumsum(change[:-1]) > 0, [0])).astype(np.int8)
            starts = np.concatenate(([0], part.ends)).tolist()
            for d in range(len(texts)):
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone[starts[d] + 1 : starts[d + 1] + 1], [0]))))
                if len(turn):
                    spans[d] = turn.reshape(-1, 2)
        cut, kept = [], []
        for d, t in enumerate(texts):
            own = spans[d].tolist() if d in spans else []
            cut.append([{"start": s, "end": e} for s, e in own])
            marks = [0, *(x for pair in own for x in pair), len(t)]
            kept.append(b"".join(t[s:e] for s, e in zip(marks[::2], marks[1::2], strict=True)) if own else t)
        return pa.Table.from_arrays([docs["id"].cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(cut, _SPANS), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    by_part = dealt.groupBy("part")
    bits = by_part.applyInArrow(hashes, _SENT).groupBy("bucket").applyInArrow(repeated, _SENT)
    verdict = by_part.cogroup(bits.groupBy("part")).applyInArrow(runs, _SENT).groupBy("bucket").applyInArrow(merged, _SENT)
    return by_part.cogroup(bits.unionByName(verdict).groupBy("part")).applyInArrow(removed, _OUT)


def _pack_raw(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _unpack_raw(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:4], "little")
    return data[4 : 4 + n], data[4 + n :]
