"""SimHash near-duplicates of lower similarity, by the same anchors on wide fingerprints.

The 64-bit fingerprints of ``simhash`` link at three bits or fewer, which is a similarity
of about 0.97; to take texts of similarity 0.8 a fingerprint needs more bits and must
allow more differences. Here it has 256 bits, of the set of a text's shingles: a shingle
counts once, however often it is repeated. Texts of Jaccard similarity 0.8 on their
shingles differ in about 39 bits, give or take 6.

1. Candidates. A block is 7 bits of the fingerprint and two minima of the shingles (the
   smallest in two orders drawn by hashing). Bits are covered by the Hamming code [7, 4]
   (covering radius 1, threshold 1: a fingerprint is replicated to the one or four anchors
   within distance 2, and is at home at the nearest); minima must be equal. Two texts meet
   if in one of the blocks the bits differ in at most one place and the minima agree. The
   blocks are as many as it takes for texts of similarity 0.8 to meet with a chance over
   0.995. Minima are as selective as a table of any size needs, so neither the blocks nor
   the rows of a text depend on its size. Those that meet and differ in at most MAX_BITS
   are put in one loose group; a pair that meets at many anchors is told of at the first
   block only.
2. Proof. Each loose group's shingles are brought together once, and only pairs whose
   sets of shingles have a Jaccard similarity of LIKENESS or more are linked. Texts of
   equal fingerprints are proved like others; only texts of the same set are one from the
   start. So what is linked depends on the two texts alone, not on the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, text_bytes
from .components import connected_components
from .simhash import ANCHOR_CHUNK, HOT_BROADCAST

WORDS, BITS, LIKENESS = 5, 256, 0.8
#: Bits in which pairs of similarity 0.8 differ, on average, and the most in which the proof looks at a pair (over five spreads above; unrelated texts differ in about 128).
USUAL_BITS, MAX_BITS = 39, 72
#: Chance that a pair of similarity LIKENESS doesn't meet at any anchor.
MISS = 0.005
#: Bits and minima of a block.
WIDTH, MINIMA = 7, 2
#: Members of a loose group whose shingles one task holds; more are split into pairs of chunks.
PROOF_CHUNK = 1024
#: Texts to be proved up to this many (50 bytes each) are told to all tasks; more are found by a shuffle.
PROOF_BROADCAST = 200_000
_F = ("f0", "f1", "f2", "f3")
#: What texts of the same set of shingles, and no others, have in common.
_SAME = ("same", *_F)


def _shingle_spans(text: bytes, words: int) -> tuple[bytes, list[tuple[int, int]]]:
    joined = b" ".join(text.lower().split())
    if not joined:
        return joined, []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    if len(starts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    return joined, list(zip(starts.tolist(), ends.tolist(), strict=True))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the lower-cased text's different shingles; a shorter text is one shingle."""
    joined, spans = _shingle_spans(text, words)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in spans), np.uint64, len(spans)))


def _mixed(h: np.ndarray) -> np.ndarray:
    for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(k)) * np.uint64(m)
    return h ^ h >> np.uint64(31)


def fingerprint(own: np.ndarray) -> bytes:
    """256 bits, each set if it is in over half of the hashes of a set of shingles; all 0 without any."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(own), 2048):
        part = own[k : k + 2048, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.unpackbits(_mixed(part).view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(own)).tobytes()


def meeting_chance(width: int = WIDTH, differences: int = USUAL_BITS) -> float:
    """Chance that a block of ``width`` bits differs in at most one, for fingerprints with so many differences."""
    same = BITS - differences
    return (comb(same, width) + differences * comb(same, width - 1)) / comb(BITS, width)


BLOCKS = ceil(log(MISS) / log(1 - LIKENESS**MINIMA * meeting_chance()))
#: An odd number for each minimum of each block; a shingle's place in the order is its product.
_ORDERS = np.random.default_rng(1).integers(1, 2**63, (BLOCKS, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(own: np.ndarray) -> np.ndarray:
    """A 32-bit number for each block, equal if the block's minima of a set of shingles are; 0 without shingles."""
    if not len(own):
        return np.zeros(BLOCKS, np.uint32)
    least = np.array([[(own * k).min() for k in of] for of in _ORDERS])
    key = np.zeros(BLOCKS, np.uint64)
    for k in range(MINIMA):
        key = _mixed(key + least[:, k])
    return (key >> np.uint64(32)).astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray, least: float = LIKENESS) -> bool:
    """Whether two sorted sets of shingles have a Jaccard similarity of at least ``least``; two empty ones have."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= least * (small + large - common) - 1e-9


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, said, same, f0, f1, f2, f3, minima) for each row; said is a hash of the text, same one of its set of shingles; null text counts as empty."""

    def run(texts: list) -> list[pa.Array]:
        sets = [shingles(x, words) for x in texts]
        own = np.frombuffer(b"".join(map(fingerprint, sets)), "<i8").reshape(-1, 4)
        same = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        return [pa.array(same), *(pa.array(np.ascontiguousarray(own[:, k])) for k in range(4)), pa.array([minima(x).tobytes() for x in sets], pa.binary())]

    key = F.struct(F.col(id_col).cast("long").alias("id"), said(text_col).alias("said"))
    made = per_text(docs.select(key.alias("key"), text_bytes(text_col).alias("text")), run, "key struct<id:bigint,said:bigint>, same long, " + ", ".join(f"{x} long" for x in _F) + ", minima binary")
    return made.select("key.id", "key.said", *_SAME, "minima")


def said(text_col: str):
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _near_codewords() -> np.ndarray:
    """For each 7-bit word its nearest codeword and then those at distance 2 (-1: none)."""
    words = np.arange(1 << WIDTH)
    syndrome = np.zeros(1 << WIDTH, np.int64)
    for i in range(WIDTH):
        syndrome ^= (words >> i & 1) * (i + 1)
    out = np.full((1 << WIDTH, 1 + WIDTH // 2), -1, np.int64)
    out[:, 0] = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    for s in range(1, WIDTH + 1):
        pairs = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, WIDTH + 1) if i < i ^ s]
        own = words[syndrome == s]
        out[own, 1:] = own[:, None] ^ np.array(pairs)
    return out


_NEAR = _near_codewords()
#: The places of each block's bits.
_PLACES = [np.arange(b * WIDTH, (b + 1) * WIDTH) for b in range(BLOCKS)]


def block_anchors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks of WIDTH bits: (index, anchor, is home) of all anchors within distance 2."""
    near = _NEAR[blocks]
    at, col = np.nonzero(near >= 0)
    return at, near[at, col], col == 0


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, BITS // 8), axis=1)


_MEMBER = "anchor long, node long, " + ", ".join(f"{x} long" for x in _F) + ", minima binary"
#: An anchor's key ends with its block's number, in so many bits.
_BLOCK_BITS = 8


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, node, f0..f3, minima) of (node, f0..f3, minima); node is doubled, and odd where it is at home."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            node = part.column(0).to_numpy(zero_copy_only=False)
            fps = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1)
            bits, own = _bits(fps), part.column(5)
            keys = _keys(own)
            for b, places in enumerate(_PLACES):
                at, anchor, home = block_anchors(bits[:, places].astype(np.int64) @ (1 << np.arange(WIDTH)))
                key = _mixed(keys[at, b].astype(np.uint64) << np.uint64(WIDTH) | anchor.astype(np.uint64)) >> np.uint64(_BLOCK_BITS) << np.uint64(_BLOCK_BITS) | np.uint64(b)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[at] * 2 + home), *(pa.array(fps[at, k]) for k in range(4)), own.take(pa.array(at))], names=["anchor", "node", *_F, "minima"])


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BLOCKS)


def anchor_links(fps: np.ndarray, homes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Index pairs that join what each home is within ``most`` bits of; no more than members less one.

    In a large group most members soon are in one chain; its homes are then compared only
    with the members outside it.
    """
    n = len(fps)
    label, out, step = np.arange(n), [], max(1, min(64, (1 << 18) // n))
    everyone = np.arange(n)

    def look(hs: np.ndarray, scope: np.ndarray) -> None:
        if not len(hs) or not len(scope):
            return
        near = np.bitwise_count(fps[hs][:, None] ^ fps[scope][None]).sum(axis=2, dtype=np.int32) <= most
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            h, hit = hs[r], scope[near[r]]
            hit = hit[label[hit] != label[h]]
            if len(hit):
                found, first = np.unique(label[hit], return_index=True)
                out.extend((h, j) for j in hit[first].tolist())
                label[np.isin(label, found)] = label[h]

    for k in range(0, len(homes), step):
        hs = homes[k : k + step]
        if n > 4096:
            inside = label == np.bincount(label).argmax()
            look(hs[inside[hs]], everyone[~inside])
            look(hs[~inside[hs]], everyone)
        else:
            look(hs, everyone)
    return out


def _by_key(found, names: list[str]):
    """A function of batches sorted by their first column: found(key's rows as arrays) for each key, keys that go on in the next batch whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> pa.RecordBatch:
            keys = table.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            a, b = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                if e - s > 1:
                    for x, y in found(table.slice(s, e - s)):
                        a.append(x)
                        b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (kept and kept[-1].column(0)[0].as_py() != keys[0]):
                whole = [*kept, batch.slice(0, last)] if last else kept
                yield emit(pa.Table.from_batches(whole).combine_chunks())
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield emit(pa.Table.from_batches(kept).combine_chunks())

    return run


def met_before(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, block: int) -> np.ndarray:
    """For pairs of fingerprints and minima whether they meet at a block before the given one."""
    found = np.zeros(len(x), bool)
    if block and len(x):
        differ = _bits(x ^ y)
        for b in range(block):
            found |= (mx[:, b] == my[:, b]) & (differ[:, _PLACES[b]].sum(axis=1) <= 1)
    return found


def _meet(near: int):
    """Links of an anchor's members, as _by_key wants it: a chain through all that are near, without the pairs that met at a block before.

    Such pairs are near there too, so they are connected by the links of the blocks before
    (by induction), and a tight group gives few links a member, not one for each anchor of
    each block.
    Members are taken in an order that is the same at all anchors, so that chains have
    many pairs in common.
    """

    def found(rows: pa.Table) -> list[tuple[int, int]]:
        node = rows.column(1).to_numpy()
        order = np.argsort((node >> 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        node = node[order]
        homes = np.flatnonzero(node & 1)
        if not len(homes):
            return []
        fps = np.stack([rows.column(k).to_numpy()[order] for k in range(2, 6)], axis=1).view(np.uint64)
        pairs = np.array(anchor_links(fps, homes, near), np.int64).reshape(-1, 2)
        if not len(pairs):
            return []
        keys = _keys(rows.column(6))[order]
        block = rows.column(0)[0].as_py() & ((1 << _BLOCK_BITS) - 1)
        a, b = pairs[:, 0], pairs[:, 1]
        return (node >> 1)[pairs[~met_before(fps[a], fps[b], keys[a], keys[b], block)]].tolist()

    return _by_key(found, ["a", "b"])


def candidates(distinct: DataFrame, near: int = MAX_BITS, chunk: int = ANCHOR_CHUNK) -> DataFrame:
    """Links (a, b) of (node, f0..f3, minima), one row a set of shingles, that chain together what meets at an anchor within ``near`` bits.

    Anchors of over ``chunk`` members are split into pairs of chunks.
    """
    members = distinct.select("node", *_F, "minima").mapInArrow(_replicate, _MEMBER)
    hot = cut(members.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > chunk)) if distinct.count() > chunk else None
    n_hot = hot.limit(HOT_BROADCAST + 1).count() if hot is not None else 0
    if n_hot:
        every = members.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "anchor", "left")
        block = F.col("anchor").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))
        split = _pairs_of_chunks(every.where("n is not null").withColumn("block", block), "anchor", F.shiftright("node", 1), chunk)
        of_block = F.shiftleft(F.shiftrightunsigned("anchor", _BLOCK_BITS), _BLOCK_BITS).bitwiseOR(F.col("block"))
        split = split.select(of_block.alias("anchor"), "node", *_F, "minima")
        members = every.where("n is null").drop("n").unionByName(split)
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return members.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_meet(near), "a long, b long")


def _pairs_of_chunks(rows: DataFrame, key: str, dealt_by, chunk: int) -> DataFrame:
    """rows (key, n, ..) of groups of n members with ``dealt``: dealt to ceil(n / chunk) chunks, and a copy to each pair of chunks as a group of its own."""
    return (
        rows.withColumn("_parts", F.ceil(F.col("n") / F.lit(chunk)).cast("int"))
        .withColumn("_own", F.pmod(F.xxhash64(dealt_by), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn(key, F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")))
        .withColumnRenamed("_own", "dealt")
        .drop("_parts", "_other")
    )


def proved(fps: np.ndarray, sets: list[np.ndarray], most: int = MAX_BITS, least: float = LIKENESS) -> list[tuple[int, int]]:
    """Index pairs that join what is connected by pairs of similarity ``least`` within ``most`` bits; members less one at most.

    Each member reached is compared with all not yet reached, so no pair that could join
    two chains is left out, and of a tight group each member is compared about once.
    """
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            h = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[h]).sum(axis=1) <= most
            hit = np.zeros(len(left), bool)
            for k in np.flatnonzero(near).tolist():
                hit[k] = alike(sets[h], sets[left[k]], least)
            front += left[hit].tolist()
            out += [(h, int(j)) for j in left[hit]]
            left = left[~hit]
    return out


def _firsts(fps: np.ndarray, sets: list[np.ndarray], most: int, least: float) -> np.ndarray:
    """For each member the first one of its chain."""
    first = np.arange(len(fps))
    for i, j in proved(fps, sets, most, least):
        first[j] = first[i]  # i was reached before j
    return first


def _prove(most: int, least: float):
    """Links of a group, as _by_key wants it. All members get a link to the first of their chain.

    Members of two chunks are linked within their chunk where that is a group of its own;
    here only the firsts of the chunks' chains are, so a tight group of any size gives
    about a link a member and one more a pair of chunks.
    """

    def found(rows: pa.Table) -> list[tuple[int, int]]:
        node, dealt = rows.column(1).to_numpy(), rows.column(7).to_numpy()
        fps = np.stack([rows.column(k).to_numpy() for k in range(2, 6)], axis=1).view(np.uint64)
        sets = [np.frombuffer(x, "<u8") for x in rows.column(6).to_pylist()]
        first = _firsts(fps, sets, most, least)
        if (dealt == dealt[0]).all():
            return [(node[j], node[i]) for j, i in enumerate(first) if i != j]
        heads: set[int] = set()
        for k in np.unique(dealt):
            own = np.flatnonzero(dealt == k)
            heads.update(own[_firsts(fps[own], [sets[x] for x in own], most, least)].tolist())
        return [(node[j], node[first[j]]) for j in sorted(heads) if first[j] != j]

    return _by_key(found, ["node", "label"])


def chains(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int, least: float = LIKENESS, chunk: int = PROOF_CHUNK) -> DataFrame:
    """(node, label) of nodes that are connected to others by pairs of texts of a similarity of ``least`` or more; label is one of the nodes.

    distinct: (node, id, said, f0..f3, minima), one row a set of shingles with the row of
    docs that stands for it. A loose group of up to ``chunk`` members is settled by one
    task; larger ones are settled by pairs of chunks, and what these have linked is then
    connected.
    """
    spark = docs.sparkSession
    loose = cut(connected_components(candidates(distinct)))
    sizes = loose.groupBy("label").agg(F.count("*").alias("n"))
    asked = cut(distinct.join(loose.join(sizes, "label"), "node").select("node", "label", "n", "id", "said", *_F))
    n_asked, n_most = asked.agg(F.count("*"), F.max("n")).first()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), said(text_col).alias("said"), text_bytes(text_col).alias("text"))
    # repeated rows: one stands for its set
    met = rows.join(F.broadcast(asked) if n_asked <= PROOF_BROADCAST else asked, ["id", "said"])

    def sets(texts: list) -> list[pa.Array]:
        return [pa.array([shingles(x, words).tobytes() for x in texts], pa.binary())]

    fields = ", ".join(f"{x}:bigint" for x in ("label", "n", "node", *_F))
    made = per_text(met.select(F.struct("label", "n", "node", *_F).alias("key"), "text"), sets, f"key struct<{fields}>, shingles binary").select("key.*", "shingles")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def settled(groups: DataFrame) -> DataFrame:
        dealt = groups.select("label", "node", *_F, "shingles", "dealt").repartition(parts, "label").sortWithinPartitions("label", "node")
        return dealt.mapInArrow(_prove(MAX_BITS, least), "node long, label long")

    if (n_most or 0) <= chunk:
        few = cut(settled(made.withColumn("dealt", F.lit(0))).distinct())
        return few.unionByName(few.select(F.col("label").alias("node"), "label")).distinct()
    made = cut(made)
    few = cut(settled(made.where(F.col("n") <= chunk).withColumn("dealt", F.lit(0))).distinct())
    split = _pairs_of_chunks(made.where(F.col("n") > chunk), "label", F.col("node"), chunk)
    many = connected_components(settled(split).select(F.col("node").alias("a"), F.col("label").alias("b")))
    return few.unionByName(few.select(F.col("label").alias("node"), "label")).distinct().unionByName(many)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LIKENESS) -> DataFrame:
    """(id, said): rows that are near copies, directly or by a chain, of a row with a smaller id; said is said() of the text.

    Texts without words have the same, empty set and are copies of each other. Rows without
    an id are left out.
    """
    each = cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words))
    first = F.min(F.struct("id", "said")).alias("first")
    # numbered in the task that makes the row, and then written, so the numbers stay
    distinct = cut(each.groupBy(*_SAME).agg(first, F.first("minima").alias("minima")).select(F.monotonically_increasing_id().alias("node"), "first.id", "first.said", *_SAME, "minima"))
    labels = chains(docs, distinct, id_col, text_col, words, least)
    joined = cut(distinct.join(labels, "node").select("node", "label", F.col("id").alias("first")))
    smallest = joined.groupBy("label").agg(F.min("first").alias("smallest"))
    moved = joined.join(smallest, "label").select("node", "smallest")
    # a table of its own, so that both sides of the last join are plain shuffles and AQE can split a hot set
    of = cut(distinct.join(moved, "node", "left").select(*_SAME, F.coalesce("smallest", "id").alias("component")))
    return each.select("id", "said", *_SAME).join(of, list(_SAME)).where("id <> component").select("id", "said").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs without near copies of a document with a smaller id; rows without an id are kept, as are rows that repeat a kept id."""
    gone = copies(docs, id_col, text_col, words).select(F.col("id").alias("_copy"), F.col("said").alias("_said"))
    return docs.join(gone, (docs[id_col] == gone["_copy"]) & (said(text_col) == gone["_said"]), "left_anti")
