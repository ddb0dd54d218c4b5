"""SimHash near-duplicates, found by anchor points of a covering code.

A fingerprint has 64 bits, in two halves of 32. Two fingerprints that differ in at most
three bits differ in at most one bit in one of the halves. The anchors of a half are the
codewords of the Hamming code [31, 26] with the last bit kept as it is: every half is
within covering radius 1 of an anchor, its home. A half that differs in one bit from
another is within 1 + 1 of the other's home, so each fingerprint is replicated to all
anchors within distance 2 (1 + 15 of the code and 1 with the last bit turned, or 2 for a
codeword) and only fingerprints at the same anchor are compared. There are 2 ** 27 anchors
a half, so unrelated fingerprints rarely meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, text_bytes
from .components import connected_components

SEED = 42
MAX_DISTANCE = 3
#: Members of an anchor that one task compares; more are split into pairs of chunks.
ANCHOR_CHUNK = 65_536
#: Hot anchors up to this many are broadcast (16 bytes each); more are joined by shuffle.
HOT_BROADCAST = 100_000


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a lower-cased text's shingles, as an unsigned number.

    A text of fewer words than a shingle is one shingle; one without words has fingerprint 0.
    """
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    if len(starts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) for each row of docs, fp a signed 64-bit number; null text counts as empty."""

    def run(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64))]

    return per_text(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")), run, "id long, fp long")


#: For each syndrome, the pairs of bits of a 31-bit word whose turning clears it.
_PAIRS = np.zeros((32, 15), np.uint32)
for _s in range(1, 32):
    _PAIRS[_s] = [1 << (i - 1) | 1 << ((i ^ _s) - 1) for i in range(1, 32) if i < i ^ _s]


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within distance 2 of each 32-bit word: (index of the word, anchor)."""
    syndrome = np.zeros(len(half), np.uint32)
    for i in range(31):
        syndrome ^= (half >> np.uint32(i) & np.uint32(1)) * np.uint32(i + 1)
    off = syndrome > 0
    home = np.where(off, half ^ (np.uint32(1) << np.where(off, syndrome - 1, 0).astype(np.uint32)), half).astype(np.uint32)
    every = np.arange(len(half))
    far = half[off, None] ^ _PAIRS[syndrome[off]]
    return np.concatenate((every, every, np.repeat(every[off], 15))), np.concatenate((home, home ^ np.uint32(1 << 31), far.ravel()))


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 8192):
            fps = batch.slice(start, 8192).column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                at, anchor = anchors_of((fps >> np.uint64(32 * side)).astype(np.uint32))
                key = anchor.astype(np.int64) | np.int64(side) << np.int64(32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at].view(np.int64))], names=["anchor", "fp"])


def chains(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is connected among members, each to the first of its chain.

    Members reached are not compared again, so a tight group of n costs about n
    comparisons of arrays that soon are short, and gives n - 1 links.
    """
    out, left = [], members
    while len(left) > 1:
        head, left = left[0], left[1:]
        front = [head]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= distance
            if near.any():
                front += list(left[near])
                out += [(head, x) for x in left[near]]
                left = left[~near]
    return out


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))

        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            two = starts[sizes == 2]
            a, b = fps[two], fps[two + 1]
            close = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            more = []
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                more += chains(np.sort(fps[s : s + n]).view(np.uint64), distance)
            rest = np.array(more, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a[close], rest[:, 0]))), pa.array(np.concatenate((b[close], rest[:, 1])))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((kept[0], batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((kept[1], batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            kept = (keys[last:], fps[last:])
            if last:
                yield found(keys[:last], fps[:last])
        if len(kept[0]):
            yield found(*kept)

    return run


def links(fps: DataFrame, distance: int = MAX_DISTANCE, chunk: int = ANCHOR_CHUNK) -> DataFrame:
    """Links (a, b) that connect all fingerprints reachable by steps of at most three bits.

    fps: one row for each different fingerprint (column ``fp``). Anchors with more than
    ``chunk`` members are split: members are dealt to chunks by hash and every pair of
    chunks is compared on its own, so a task holds at most about two chunks and no pair
    is lost.
    """
    if distance > MAX_DISTANCE:
        raise ValueError("the anchors cover distances up to 3")
    members = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    hot = cut(members.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > chunk))
    n_hot = hot.limit(HOT_BROADCAST + 1).count()
    if n_hot:
        few = F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot
        every = members.join(few, "anchor", "left")
        parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        split = (
            every.where("n is not null")
            .withColumn("parts", parts)
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("anchor"), "fp")
        )
        members = every.where("n is null").select("anchor", "fp").unionByName(split)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return members.repartition(parts, "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row for each row of docs: id, fp, component (the smallest id reachable).

    Null text counts as empty; texts without words have fingerprint 0 and are linked like
    any other. A null id takes part but is never the component, unless all ids of the
    component are null. Repeated rows and ids give a row each. Only equal fingerprints
    are grouped before links are sought, so thousands of copies count once.
    """
    each = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(each.groupBy("fp").agg(F.min("id").alias("first")))
    labels = connected_components(links(distinct, distance)).withColumnsRenamed({"node": "fp"})
    joined = cut(distinct.join(labels, "fp").select("fp", "label", "first"))
    smallest = joined.groupBy("label").agg(F.min("first").alias("smallest"))
    moved = joined.join(smallest, "label").select("fp", "smallest")
    # a table of its own, so that both sides of the last join are plain shuffles and AQE can split a hot fingerprint
    of = cut(distinct.join(moved, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component")))
    return each.join(of, "fp").select("id", "fp", "component")
