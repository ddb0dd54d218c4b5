"""Training by local gradient descent in parts, averaged after each wave.

Lines are dealt to parts of at most about PART_TOKENS tokens (and at least ``thread``
parts), and parts are run in waves of as many as the cluster runs at once, or in
MOST_WAVES larger ones. In a wave every part gets the rows of the two matrices that its lines can touch by a join (never a whole
matrix through the driver), runs its gradient steps, and gives the rows back; rows that
several parts changed are averaged. One part is plain sequential descent; more parts need
more epochs for the same loss.

Everything a wave needs is written by waves beforehand, in the shared folder: its lines,
the rows its parts touch, the subwords of its words, the paths of its targets, and
negatives drawn for it, anew for each epoch, from the distribution of all words. As it is
known which wave touches a row next, the weights are a log: a wave reads the rows that are
filed under it, and files each, changed, under the wave that touches it next. So a wave
reads its own lines and rows, no weights are read or written that aren't touched, and the
last filing of each row is its value whenever training ends.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rng
from ..errors import Aborted, InvalidArgument, LexivecError, NaNEncountered
from ..functions import hashing as H
from ..functions import text as T
from ..params import LossKind, ModelKind, Params
from ..storage import cut, fresh_dir
from . import features, kernels, vocabulary
from .scoring import Model
from .vocabulary import Vocabulary

INPUT, OUTPUT, LOSS, WORD, PATH, DRAW = range(6)
_ROWS = "mat int, row long, vec array<float>"
#: Rows of a block: its first row, and those of its rows that are meant, with their vectors one after the other.
_BLOCKS = "mat int, row long, ids array<bigint>, vec array<float>"
_VEC = pa.list_(pa.float32())
#: Tokens of a part's lines, on average; more make more parts.
PART_TOKENS = 1_000_000
#: Waves of an epoch. Up to so many, a wave has as many parts as run at once; larger inputs have more parts in a wave, so that what a wave costs besides its rows doesn't grow with the input.
MOST_WAVES = 10
#: Negatives drawn for each part and epoch, with repeats, for each of its tokens, but at least and at most so many; steps draw from these.
NEGATIVE_DRAWS, LEAST_DRAWS, MOST_DRAWS = 1.0, 1 << 12, 1 << 21
#: Ids of the distribution of negatives that are drawn from together.
DRAW_BLOCK = 1 << 14
#: Numbers of a block of rows of a matrix; weights are filed, sent and averaged by blocks, as a row of its own costs Spark more than its numbers do.
BLOCK_NUMBERS = 1 << 15
#: Words of a line for word vectors whose steps are summed up.
CENTRES = 32


def initial_rows(rows: DataFrame, n_rows: int, dim: int, seed: int, exact: bool = False) -> DataFrame:
    """(mat, row, vec) of input rows (row) at their start: uniform in +-1/dim; as they are drawn, in doubles, if ``exact``.

    The matrix of n_rows * dim numbers is cut into ten blocks, the last the longest; block
    b has the draws of seed b + seed. The generator jumps to any draw, so each row is
    made on its own, wherever it is needed.
    """
    kind, vecs, schema = (np.float64, pa.list_(pa.float64()), _ROWS.replace("float", "double")) if exact else (np.float32, _VEC, _ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).cast(pa.int64())
            flat = initial_values(rows.to_numpy(zero_copy_only=False), n_rows, dim, seed).astype(kind)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat)).cast(vecs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), INPUT, np.int32)), rows, vec], names=["mat", "row", "vec"])

    return rows.select(F.col("row").cast("long").alias("row")).mapInArrow(run, schema)


def initial_values(rows: np.ndarray, n_rows: int, dim: int, seed: int) -> np.ndarray:
    """The numbers of initial_rows, row after row, as they are drawn."""
    block = n_rows * dim // 10
    at = (rows[:, None] * dim + np.arange(dim)).ravel()
    b = np.minimum(at // block, 9) if block else np.full(len(at), 9)
    return (rng.uniform_at(b + seed, at - b * block + 1) * 2 - 1) / dim


def block_rows(dim: int) -> int:
    return max(1, BLOCK_NUMBERS // dim)


def in_blocks(ids: np.ndarray, size: int, *columns: np.ndarray) -> list[pa.Array]:
    """Sorted ids by blocks: [first row of each block, its ids, its part of each column that has as many rows]."""
    block = ids // size
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(ids) else np.zeros(0, np.int64)
    offsets = np.append(starts, len(ids))
    lists = [H.to_lists(offsets * (c.size // len(ids) if len(ids) else 1), c.ravel()) for c in columns]
    return [pa.array(block[starts] * size), H.to_lists(offsets, ids), *lists]


def block_of(row: str, size: int):
    return (F.floor(F.col(row) / size) * size).cast("long")


def pack(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """(*by, row, ids) by blocks of rows (*by, row), each row once."""
    return rows.groupBy(*by, block_of("row", size).alias("_b")).agg(F.array_sort(F.collect_set(F.col("row").cast("long"))).alias("ids")).withColumnRenamed("_b", "row")


def unpacked(blocks: DataFrame, dim: int) -> DataFrame:
    """(mat, row, vec, *rest) of (mat, row, ids, vec, *rest), a row for each of the ids."""
    rest = [c for c in blocks.columns if c not in ("mat", "row", "ids", "vec")]
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ids = H.list_parts(batch.column("ids"))
            _, flat = H.list_parts(batch.column("vec"))
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets)))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * dim + 1, dim, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("mat").take(of), ids, vec, *(batch.column(c).take(of) for c in rest)], names=["mat", "row", "vec", *rest])

    return blocks.mapInArrow(run, ", ".join([_ROWS, *(f"{c} {kinds[c]}" for c in rest)]))


def huffman_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent of each node, -1 for the root; whether it is the right child) for counts that fall; inner nodes follow the leaves.

    Leaves from the rarest on and inner nodes in order of making are two sorted queues;
    the two smallest heads are joined, an inner node first where counts are equal.
    """
    n = len(counts)
    size = max(2 * n - 1, 0)
    parent, right = np.full(size, -1, np.int64), np.zeros(size, bool)
    weight = np.zeros(size, np.int64)
    weight[:n] = counts
    leaf, inner = n - 1, n
    for made in range(n, size):
        pair = []
        for _ in range(2):
            if leaf >= 0 and (inner >= made or weight[leaf] < weight[inner]):
                pair.append(leaf)
                leaf -= 1
            else:
                pair.append(inner)
                inner += 1
        weight[made] = weight[pair[0]] + weight[pair[1]]
        parent[pair] = made
        right[pair[1]] = True
    return parent, right


def _path(parent: np.ndarray, right: np.ndarray, leaf: int) -> tuple[list[int], list[bool]]:
    n, path, code, node = (len(parent) + 1) // 2, [], [], leaf
    while parent[node] >= 0:
        path.append(int(parent[node]) - n)
        code.append(bool(right[node]))
        node = parent[node]
    return path, code


def huffman_paths(counts: list[int]) -> list[tuple[list[int], list[bool]]]:
    """For each label, counts falling, the inner nodes from leaf to root and whether each step came from the right."""
    parent, right = huffman_tree(np.array(counts, np.int64))
    return [_path(parent, right, k) for k in range(len(counts))]


def path_table(spark: SparkSession, counts: np.ndarray) -> DataFrame:
    """(label_id, path, code) for counts that fall. The tree, 9 bytes a node, is made on the driver, as it is a chain of choices; paths are walked in tasks."""
    held = spark.sparkContext.broadcast(huffman_tree(np.asarray(counts, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_path(*held.value, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([c for _, c in made], pa.list_(pa.bool_()))], names=["label_id", "path", "code"])

    return spark.range(len(counts)).mapInArrow(run, "label_id int, path array<int>, code array<boolean>")


def learning_rate(lr: float, epoch: int, epochs: int, share):
    """Falls in a line from lr to 0; share (a number or an array): of the epoch that is done."""
    return np.maximum(0.0, lr * (1.0 - (epoch + share) / max(epochs, 1)))


def word_lines(docs: DataFrame, v: Vocabulary, text_col: str) -> DataFrame:
    """(ids array<bigint>): known words, the end of line too, in pieces of LINE_TOKENS + 1 known tokens.

    Each text is a line; labels count as tokens but are left out; pieces without words have
    no row. A small vocabulary is looked up in each task, of a large one each part of the
    rows gets the entries of its own tokens; both give the same. Sub-sampling comes later,
    anew in each epoch.
    """
    size, nwords = T.LINE_TOKENS + 1, v.nwords

    def line_pieces(lists: pa.Array, look: vocabulary.Lookup) -> pa.Array:
        """The pieces of each line."""
        offsets, words = H.list_parts(lists)
        coded = words.dictionary_encode()
        ids = look.ids(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        offsets, ids = H.kept(offsets, ids, ids >= 0)
        at = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
        # a piece begins where a line does and at each size-th token
        first = at % size == 0
        out, own = H.kept(np.append(np.flatnonzero(first), len(ids)), ids, ids < nwords)
        good = np.diff(out) > 0
        of = np.concatenate(([0], np.cumsum(first)))[offsets]
        pieces = H.to_lists(out[np.concatenate(([True], good))], own)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(good)))[of].astype(np.int32)), pieces)

    look = v.for_tasks()
    if look is None:
        # dealt by what is the same whenever the rows are made, so not by numbers given to them
        plain = [F.col(c).alias(f"_{c}") for c, kind in docs.dtypes if c != text_col and not any(x in kind for x in ("<", "variant", "interval"))]
        own = features.by_lookups(docs, plain or [F.lit(0).alias("_key")], F.col(text_col), None, "unless", v, lambda lists, look: [line_pieces(lists, look)], "pieces array<array<bigint>>")
        return own.select(F.explode("pieces").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield pa.RecordBatch.from_arrays([line_pieces(T.token_lists(batch.column(0).slice(start, 1000), "unless"), look).values], names=["ids"])

    return docs.select(text_col).mapInArrow(run, "ids array<bigint>")


def _lines(docs: DataFrame, v: Vocabulary, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """((part, key, ids, targets), number of parts). Supervised lines have features and labels, others word ids and no targets."""
    p = v.params
    if p.model == ModelKind.SUPERVISED:
        made = features.line_features(docs, v, id_col, text_col, eos=True, eos_in_ngrams=True)
        lines = made.where((F.size("fids") > 0) & (F.size("labels") > 0)).select(F.col("fids").alias("ids"), F.col("labels").alias("targets"))
    else:
        lines = word_lines(docs, v, text_col).select("ids", F.array().cast("array<int>").alias("targets"))
    # numbered before they are written, so the numbers stay; equal lines are dealt apart
    where = fresh_dir(docs.sparkSession, "lines")
    lines.withColumn("key", F.monotonically_increasing_id()).write.parquet(where)
    lines = docs.sparkSession.read.schema("ids array<bigint>, targets array<int>, key long").parquet(where)
    total = lines.agg(F.sum(F.size("ids"))).first()[0] or 0
    parts = max(p.thread, -(-int(total) // PART_TOKENS))
    return lines.withColumn("part", F.pmod(F.xxhash64("key", F.lit(p.seed)), F.lit(parts)).cast("int")), parts


def draw_negatives(chances: DataFrame, asked: DataFrame, seed: int) -> DataFrame:
    """(step, part, row, n): how often each entry of chances (id, chance) is among the ``draws`` of each row of asked (step, part, draws; a row a part and step, so few).

    Draws with repeats are dealt to blocks of ids first and inside them then, both by the
    chances, which is the same as drawing them one by one; each block is a row, and no draw
    is ever a row.
    """
    blocks = chances.groupBy(F.floor(F.col("id") / DRAW_BLOCK).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "chance"))).alias("own"))
    blocks = cut(blocks.select("block", F.col("own.id").alias("ids"), F.col("own.chance").alias("chances")))
    sums = blocks.select("block", F.aggregate("chances", F.lit(0.0), lambda s, x: s + x).alias("mass")).toArrow().sort_by("block")
    named, masses = sums["block"].to_numpy(), sums["mass"].to_numpy()
    steps, parts, draws = (asked.where("draws > 0").select("step", "part", "draws").toArrow().sort_by([("step", "ascending"), ("part", "ascending")])[c].to_numpy() for c in ("step", "part", "draws"))

    def share(n: int, of: np.ndarray, *key: int) -> np.ndarray:
        return np.random.default_rng((seed, *key)).multinomial(n, of / of.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = [share(n, masses, *key) for *key, n in zip(steps.tolist(), parts.tolist(), draws.tolist(), strict=True)] if len(masses) else []
        for batch in batches:
            for block, ids, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, own, at = ids.values.to_numpy(), own.values.to_numpy(), int(np.searchsorted(named, block))
                for step, part, each in zip(steps.tolist(), parts.tolist(), dealt, strict=True):
                    n = share(int(each[at]), own, step, part, block) if each[at] else each[:0]
                    some = np.flatnonzero(n)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), step, np.int32)), pa.array(np.full(len(some), part, np.int32)), pa.array(ids[some]), pa.array(n[some])], names=["step", "part", "row", "n"])

    return blocks.repartition(asked.sparkSession.sparkContext.defaultParallelism, "block").mapInArrow(run, "step int, part int, row long, n long")


_NEEDED = "part int, mat int, row long, ids array<bigint>, keep float"


def _needed(lines: DataFrame, v: Vocabulary, parts: int, hs: DataFrame | None) -> DataFrame:
    """(part, mat, row, ids, keep): rows of weights each part may touch in every epoch (ids, by blocks), subwords of its words and the chance that sub-sampling keeps them, paths of its targets (twice the node, and one if from the right)."""
    p = v.params
    none, all_kept = F.lit(None).cast("array<bigint>"), F.lit(None).cast("float")
    said = lambda df, mat, ids=none, keep=all_kept: df.select("part", F.lit(mat).alias("mat"), F.col("row").cast("long").alias("row"), ids.alias("ids"), keep.alias("keep"))
    size = block_rows(p.dim)
    blocks = lambda df, mat: said(df, mat, F.col("ids"))
    each = lambda df: df.select("part", F.explode("ids").alias("row"))
    own = _touched(lines, "ids", size)
    if p.model == ModelKind.SUPERVISED:
        out = blocks(own, INPUT)
        targets = _touched(lines, "targets", size)
        counted = v.labels().select(F.col("label_id").alias("id"), "count")
    else:
        own = targets = cut(own)
        chance = vocabulary.keep_probability(F.col("count"), F.lit(max(v.ntokens, 1)), p.t).cast("float")
        words = cut(each(own).join(features.subwords(v).where("entry_type = 0").select(F.col("id").cast("long").alias("row"), "subwords", chance.alias("keep")), "row"))
        grams = p.maxn > 0 and p.bucket > 0
        out = said(words, WORD, F.col("subwords"), F.col("keep")).unionByName(blocks(pack(words.select("part", F.explode("subwords").alias("row")), size, "part") if grams else own, INPUT))
        counted = v.words().select("id", "count")
    if p.loss == LossKind.NS:
        out = out.unionByName(blocks(targets, OUTPUT))
    elif p.loss == LossKind.HS:
        steps = F.zip_with("path", "code", lambda node, right: node.cast("long") * 2 + right.cast("long"))
        paths = cut(each(targets).join(hs.select(F.col("label_id").cast("long").alias("row"), steps.alias("ids")), "row"))
        nodes = paths.select("part", F.explode("ids").alias("step")).select("part", F.floor(F.col("step") / 2).alias("row"))
        out = out.unionByName(said(paths, PATH, F.col("ids"))).unionByName(blocks(pack(nodes, size, "part"), OUTPUT))
    else:
        # every part needs every label, as each step changes them all
        every = pack(counted.select(F.col("id").alias("row")), size).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        out = out.unionByName(blocks(every, OUTPUT))
    return out


def _touched(lines: DataFrame, column: str, size: int) -> DataFrame:
    """(part, row, ids): the different numbers in a column of each part's lines, by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has the files of a few parts
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            for part in np.unique(of).tolist():
                _, values = H.list_parts(batch.column(1).filter(pa.array(of == part)))
                seen[part] = np.union1d(seen.get(part, np.zeros(0, np.int64)), values.to_numpy(zero_copy_only=False).astype(np.int64))
        for part, ids in seen.items():
            made = in_blocks(ids, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made[0]), part, np.int32)), *made], names=["part", "row", "ids"])

    made = lines.select("part", column).mapInArrow(run, "part int, row long, ids array<bigint>")
    # a part's file may be read by several tasks
    return made.groupBy("part", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


class Waves:
    """What training reads and writes, filed by waves in a folder of its own; steps count the waves of all epochs.

    lines/wave, needed/wave, draws/step and schedule/step are written once, schedule/step=-1
    has the first step of each row; weights/step is the log of the weights, each row filed
    under the step that reads it next, or under ``last`` if none does. Rows of weights are
    filed by blocks; ``read`` has them one by one, ``blocks`` as they are filed.
    """

    _SCHEMAS = {
        "lines": "part int, key long, ids array<bigint>, targets array<int>, wave int",
        "needed": f"{_NEEDED}, wave int",
        "draws": "part int, row long, n long, step int",
        "schedule": "mat int, row long, ids array<bigint>, next array<int>, step int",
        "weights": f"{_BLOCKS}, step int",
    }

    def __init__(self, lines: DataFrame, v: Vocabulary, parts: int, hs: DataFrame | None):
        p, spark = v.params, lines.sparkSession
        self.params, self.spark, self.where = p, spark, fresh_dir(spark, "training")
        # whole rounds of all cores, so that none waits for the last parts of a wave
        cores = spark.sparkContext.defaultParallelism
        self.at_once = -(-max(p.thread, cores) // cores) * cores
        #: parts of a wave
        self.size = self.at_once * max(1, -(-parts // (self.at_once * MOST_WAVES)))
        self.count = -(-parts // self.size)
        self.last = p.epoch * self.count
        wave = F.floor(F.col("part") / self.size).cast("int")
        self._file("lines", lines.withColumn("wave", wave).repartitionById(parts, F.col("part")), "wave")
        self._file("needed", _needed(self.read("lines"), v, parts, hs).withColumn("wave", wave), "wave")
        epochs = F.explode(F.sequence(F.lit(0), F.lit(p.epoch - 1)))
        self.dim, self.rows = p.dim, block_rows(p.dim)
        touched = self.read("needed").where(F.col("mat") <= OUTPUT)
        none = F.lit(None).cast("int")
        uses = touched.groupBy("mat", "row", "wave").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")).select("mat", "row", "ids", "wave", none.alias("step"))
        n_output = v.nlabels if p.model == ModelKind.SUPERVISED else v.nwords
        every = spark.range(0, n_output, self.rows).select(F.lit(OUTPUT).alias("mat"), F.col("id").alias("row"), F.sequence(F.col("id"), F.least(F.col("id") + self.rows, F.lit(n_output)) - 1).alias("ids"), none.alias("wave"), none.alias("step"))
        uses = uses.unionByName(every)
        if p.loss == LossKind.NS and p.epoch:
            counted = v.labels().select(F.col("label_id").alias("id"), "count") if p.model == ModelKind.SUPERVISED else v.words().select("id", "count")
            sizes = self.read("lines").groupBy("part", "wave").agg(F.sum(F.size("ids" if p.model != ModelKind.SUPERVISED else "targets")).alias("n")).withColumn("epoch", epochs)
            asked = sizes.select((F.col("epoch") * self.count + F.col("wave")).cast("int").alias("step"), "part", F.least(F.greatest(F.ceil(F.col("n") * NEGATIVE_DRAWS), F.lit(LEAST_DRAWS)), F.lit(MOST_DRAWS)).cast("int").alias("draws"))
            self._file("draws", draw_negatives(vocabulary.negative_chances(counted), asked, p.seed), "step")
            uses = uses.unionByName(pack(self.read("draws").select("step", "row"), self.rows, "step").select(F.lit(OUTPUT).alias("mat"), "row", "ids", none.alias("wave"), "step"))
        self._file("schedule", uses.groupBy("mat", "row").applyInArrow(_schedule(self.rows, self.count, self.last), self._SCHEMAS["schedule"]), "step")

    def _file(self, name: str, rows: DataFrame, by: str) -> None:
        """Rows are written where they are, a file for each value of ``by`` that a task has; these are few."""
        rows.write.mode("append").option("parquet.enable.dictionary", "false").partitionBy(by).parquet(f"{self.where}/{name}")

    def deal(self, rows: DataFrame, wave: int):
        """Rows (part, ..) of a wave, each part to a task of its own."""
        slot = F.col("part") - wave * self.size
        return rows.withColumn("slot", slot.cast("int")).repartitionById(self.size, F.col("slot")).groupBy("slot")

    def keep(self, step: int, changed: DataFrame) -> DataFrame:
        """What a step has changed, from the folder, so that it is made once."""
        where = f"{self.where}/changed/step={step}"
        changed.write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(where)
        return self.spark.read.schema(_BLOCKS).parquet(where)

    def blocks(self, name: str, at: int | None = None) -> DataFrame:
        """All rows of a table as they are filed, or those under a wave or step, from their own folder: no other files are listed or read."""
        fields, by = self._SCHEMAS[name].rsplit(", ", 1)
        if at is None:
            return self.spark.read.schema(self._SCHEMAS[name]).parquet(f"{self.where}/{name}")
        own = f"{name}/{by.split()[0]}={at}"
        return self.spark.read.schema(fields).parquet(f"{self.where}/{own}") if self.has(own) else self.spark.createDataFrame([], fields)

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """blocks(), but weights and schedule with a row for each row of a matrix."""
        found = self.blocks(name, at)
        if name == "weights":
            return unpacked(found, self.dim)
        if name == "schedule":
            return found.select("mat", F.inline(F.arrays_zip(F.col("ids").alias("row"), F.col("next").alias("next"))), *(["step"] if at is None else []))
        return found

    def start(self, n_input: int, given: DataFrame | None = None, only: bool = False) -> None:
        """File the first weights under the step that reads them first: those given (mat, row, vec), which have all rows if ``only``, else made anew."""
        p, dim, size, last = self.params, self.dim, self.rows, self.last
        first = self.blocks("schedule", -1)
        if given is not None:
            placed = given.join(self.read("schedule", -1).select("mat", "row", F.col("next").alias("step")), ["mat", "row"], "left").select("mat", "row", F.col("vec").cast("array<float>").alias("vec"), F.coalesce("step", F.lit(last)).alias("step"))
            held = placed.groupBy("mat", block_of("row", size).alias("_b"), "step").agg(F.array_sort(F.collect_list(F.struct("row", "vec"))).alias("_own"))
            self._file("weights", held.select("mat", F.col("_b").alias("row"), F.col("_own.row").alias("ids"), F.flatten("_own.vec").alias("vec"), "step"), "step")
        if only:
            return
        if given is not None:
            own = pack(given.select("mat", "row"), size, "mat").withColumnRenamed("ids", "_given")
            kept = first.join(own, ["mat", "row"], "left").withColumn("_p", F.arrays_zip("ids", "next"))
            kept = kept.withColumn("_p", F.filter("_p", lambda x: ~F.array_contains(F.coalesce("_given", F.array().cast("array<bigint>")), x["ids"])))
            first = kept.select("mat", "row", F.col("_p.ids").alias("ids"), F.col("_p.next").alias("next"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    mat, ids, after = batch.column("mat")[r].as_py(), batch.column("ids")[r].values.to_numpy(), batch.column("next")[r].values.to_numpy()
                    if len(ids):
                        flat = initial_values(ids, n_input, dim, p.seed).astype(np.float32) if mat == INPUT else np.zeros(len(ids) * dim, np.float32)
                        yield _by_steps(mat, ids, flat.reshape(-1, dim), after, size)

        self._file("weights", first.select("mat", "ids", "next").mapInArrow(run, self._SCHEMAS["weights"]), "step")

    def take(self, step: int) -> tuple[DataFrame, DataFrame]:
        """(lines; rows part, mat, row, vec, ids, keep) of the wave of a step; weights by blocks: ids, and their vectors one after the other."""
        wave, size = step % self.count, self.rows
        needed = self.read("needed", wave)
        asked, rest = needed.where(F.col("mat") <= OUTPUT).select("part", "mat", "row", "ids"), needed.where(F.col("mat") > OUTPUT)
        if self.has("draws"):
            draws = self.read("draws", step)
            asked = asked.unionByName(pack(draws.select("part", "row"), size, "part").withColumn("mat", F.lit(OUTPUT)))
            rest = rest.unionByName(draws.select("part", F.lit(DRAW).alias("mat"), "row", F.array("n").alias("ids"), F.lit(None).cast("float").alias("keep")))
        dealt = asked.groupBy("mat", "row").cogroup(self.blocks("weights", step).groupBy("mat", "row")).applyInArrow(_pick(self.dim), f"part int, {_BLOCKS}")
        none = F.lit(None)
        return self.read("lines", wave), dealt.select("part", "mat", "row", "vec", "ids", none.cast("float").alias("keep")).unionByName(rest.select("part", "mat", "row", none.cast("array<float>").alias("vec"), "ids", "keep"))

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def put(self, step: int, changed: DataFrame) -> None:
        """File what a step has changed (blocks of rows), the mean where parts differ, under the next steps; then drop what it has read."""
        none = F.lit(None)
        given = changed.where(F.col("mat") != LOSS).select("mat", "row", "ids", "vec", none.cast("array<int>").alias("next"))
        given = given.unionByName(self.blocks("weights", step).select("mat", "row", F.transform("ids", lambda x: -1 - x).alias("ids"), "vec", none.cast("array<int>").alias("next")))
        given = given.unionByName(self.blocks("schedule", step).select("mat", "row", "ids", none.cast("array<float>").alias("vec"), "next"))
        self._file("weights", given.groupBy("mat", "row").applyInArrow(_means(self.dim, self.rows), self._SCHEMAS["weights"]), "step")
        self.drop(f"weights/step={step}")
        self.drop(f"changed/step={step}")

    def drop(self, name: str = "") -> None:
        """Delete a table, or the whole folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}" if name else self.where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = H.list_parts(whole)
    return offsets, values.to_numpy(zero_copy_only=False)


def _by_steps(mat: int, ids: np.ndarray, vecs: np.ndarray, after: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows of one block (mat, row, ids, vec, step), a row for each of the steps that they are filed under."""
    order = np.lexsort((ids, after))
    ids, vecs, after = ids[order], vecs[order], after[order]
    starts = np.flatnonzero(np.concatenate(([True], after[1:] != after[:-1]))) if len(ids) else np.zeros(0, np.int64)
    offsets = np.append(starts, len(ids))
    n = len(starts)
    columns = [np.full(n, mat, np.int32), np.full(n, ids[0] // size * size if n else 0, np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), H.to_lists(offsets, ids), H.to_lists(offsets * vecs.shape[1], vecs.ravel()), pa.array(after[starts].astype(np.int32))], names=["mat", "row", "ids", "vec", "step"])


def _schedule(size: int, waves: int, last: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block's uses (mat, row, ids, wave or step, or neither), the step that reads each row next, for each step that has it, and the first, as step -1."""

    def run(uses: pa.Table) -> pa.Table:
        mat, base = uses["mat"][0].as_py(), uses["row"][0].as_py()
        used, there = np.zeros((size, last), bool), np.zeros(size, bool)
        offsets, ids = _lists(uses["ids"])
        for k, (wave, step) in enumerate(zip(uses["wave"].to_pylist(), uses["step"].to_pylist(), strict=True)):
            at = ids[offsets[k] : offsets[k + 1]] - base
            there[at] = True
            if step is not None:
                used[at, step] = True
            elif wave is not None:
                used[at, wave::waves] = True
        after, steps, own, nexts = np.full(size, last), [], [], []
        for step in range(last - 1, -2, -1):
            at = np.flatnonzero(used[:, step] if step >= 0 else there)
            if len(at):
                steps.append(step)
                own.append(at + base)
                nexts.append(after[at])
                after[at] = step
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        columns = [np.full(len(steps), mat, np.int32), np.full(len(steps), base, np.int64)]
        return pa.table([*map(pa.array, columns), H.to_lists(offsets, np.concatenate(own)), H.to_lists(offsets, np.concatenate(nexts).astype(np.int32)), pa.array(steps, pa.int32())], names=["mat", "row", "ids", "next", "step"])

    return run


def _pick(dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of a block that each part asks for, from those that are filed."""

    def run(asked: pa.Table, filed: pa.Table) -> pa.Table:
        _, own = _lists(filed["ids"])
        _, flat = _lists(filed["vec"])
        order = np.argsort(own, kind="stable")
        own, vecs = own[order], flat.reshape(-1, dim)[order]
        offsets, ids = _lists(asked["ids"])
        of = np.repeat(asked["part"].to_numpy(), np.diff(offsets))
        parts, found = [], []
        for part in np.unique(of).tolist() if len(own) else []:
            want = np.unique(ids[of == part])
            at = np.searchsorted(own, want).clip(max=len(own) - 1)
            at = at[own[at] == want]
            if len(at):
                parts.append(part)
                found.append(at)
        at, offsets = np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
        one = lambda name: pa.array([(asked if asked.num_rows else filed)[name][0].as_py()] * len(parts))
        columns = [pa.array(parts, pa.int32()), one("mat").cast(pa.int32()), one("row").cast(pa.int64()), H.to_lists(offsets, own[at]), H.to_lists(offsets * dim, vecs[at].ravel())]
        return pa.table(columns, names=["part", "mat", "row", "ids", "vec"])

    return run


def _means(dim: int, size: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block's rows, changed, as they were (-1 - id) and with the step that reads them next: the means of what has changed, else what was, by the steps that they are filed under."""

    def run(rows: pa.Table) -> pa.Table:
        mat, base = rows["mat"][0].as_py(), rows["row"][0].as_py()
        offsets, ids = _lists(rows["ids"])
        planned = np.repeat(rows["next"].is_valid().to_numpy(zero_copy_only=False), np.diff(offsets))
        _, nexts = _lists(rows["next"])
        _, flat = _lists(rows["vec"])
        ids, due = ids[~planned], ids[planned]
        vecs = flat.reshape(-1, dim).astype(np.float64)
        new, total, n = ids >= 0, np.zeros((size, dim)), np.zeros(size, np.int64)
        at = ids[new] - base
        for j in range(dim):
            total[:, j] = np.bincount(at, vecs[new, j], size)
        n += np.bincount(at, minlength=size)
        mean = total / np.maximum(n, 1)[:, None]
        was, there = -1 - ids[~new] - base, n > 0
        still = was[n[was] == 0]
        mean[still] = vecs[~new][n[was] == 0]
        there[still] = True
        good = there[due - base]
        due, nexts = due[good], nexts[good]
        return pa.Table.from_batches([_by_steps(mat, due, mean[due - base].astype(np.float32), nexts, size)])

    return run


def _kernel(p: Params, epoch: int, wave: int, waves: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names, size = ["mat", "row", "ids", "vec"], block_rows(p.dim)

    def run(rows: pa.Table, lines: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], _VEC)], names=names)
        if not lines.num_rows or not rows.num_rows:
            return empty
        rows = rows.sort_by([("mat", "ascending"), ("row", "ascending")]).combine_chunks()
        mat, row = rows["mat"].to_numpy(), rows["row"].to_numpy()
        span = lambda k: (int(np.searchsorted(mat, k)), int(np.searchsorted(mat, k, "right")))

        def weights(k: int) -> tuple[np.ndarray, np.ndarray]:
            a, b = span(k)
            flat = np.array(rows["vec"].slice(a, b - a).combine_chunks().flatten(), np.float32).reshape(-1, p.dim)
            offsets, ids = _lists(rows["ids"].slice(a, b - a))
            # a block's rows are its ids; without these it is a row by itself
            return (ids if len(ids) else row[a:b]), flat

        def lists(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = span(k)
            offsets, values = H.list_parts(rows["ids"].slice(a, b - a).combine_chunks())
            return row[a:b], offsets, values.to_numpy(zero_copy_only=False)

        in_rows, wi = weights(INPUT)
        out_rows, wo = weights(OUTPUT)
        part = lines["part"][0].as_py()
        draws = paths = None
        if p.loss == LossKind.NS:
            own, _, times = lists(DRAW)
            draws = np.searchsorted(out_rows, np.repeat(own, times))
        elif p.loss == LossKind.HS:
            own, offsets, steps = lists(PATH)
            at = np.searchsorted(out_rows, steps // 2)
            paths = {int(t): (at[a:b], (steps[a:b] % 2).astype(np.float32)) for t, a, b in zip(own.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)}
        step = kernels.Step(wi, wo, p.loss, p.model == ModelKind.SUPERVISED, (p.seed, epoch, part), p.neg, draws, paths)
        lines = lines.sort_by("key").combine_chunks()
        offsets, ids = H.list_parts(lines["ids"].combine_chunks())
        ids = ids.to_numpy(zero_copy_only=False)
        total = max(1, len(ids))
        rate = lambda seen: learning_rate(p.lr, epoch, p.epoch, (wave + seen / total) / waves)
        if p.model == ModelKind.SUPERVISED:
            ends, labels = H.list_parts(lines["targets"].combine_chunks())
            labels, places = labels.to_numpy(zero_copy_only=False), np.searchsorted(in_rows, ids)
            for k in range(lines.num_rows):
                wanted = labels[ends[k] : ends[k + 1]]
                right = wanted if p.loss == LossKind.OVA else wanted[[int(step.rng.integers(len(wanted)))]]
                step.update(places[offsets[k] : offsets[k + 1]], right if p.loss == LossKind.HS else np.searchsorted(out_rows, right), rate(offsets[k]))
        else:
            words, starts, subs = lists(WORD)
            a, b = span(WORD)
            keep = rows["keep"].to_numpy()[a:b]
            ends = offsets[1:]
            # sub-sampling, drawn anew in each epoch
            offsets, ids = H.kept(offsets, ids, step.rng.random(len(ids)) <= keep[np.searchsorted(words, ids)])
            subs, goals = np.searchsorted(in_rows, subs), None if p.loss == LossKind.HS else np.searchsorted(out_rows, ids)
            sizes, at = np.diff(starts), np.searchsorted(words, ids)
            for k in range(lines.num_rows):
                a, b = int(offsets[k]), int(offsets[k + 1])
                centre, context = kernels.examples(b - a, p.ws, step.rng)
                goal = (ids if goals is None else goals)[a:b]
                cuts = np.searchsorted(centre, np.arange(0, b - a + CENTRES, CENTRES)).tolist()
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    _word_steps(step, p, centre[i:j], context[i:j], at[a:b], goal, starts, sizes, subs, rate(ends[k]))
        if not (np.isfinite(wi).all() and np.isfinite(wo).all()):
            raise NaNEncountered(f"weights of part {part} in epoch {epoch}; lower the learning rate")
        parts = []
        for mat, own, vecs in ((INPUT, in_rows, wi), (OUTPUT, out_rows, wo)):
            made = in_blocks(own, size, vecs)
            parts.append(pa.Table.from_arrays([pa.array(np.full(len(made[0]), mat, np.int32)), *made], names=names))
        loss = [pa.array([LOSS], pa.int32()), pa.array([part], pa.int64()), pa.array([[]], pa.list_(pa.int64())), pa.array([[step.total, float(step.n)]], _VEC)]
        return pa.concat_tables([*parts, pa.Table.from_arrays(loss, names=names)])

    return run


def _word_steps(step: kernels.Step, p: Params, centre: np.ndarray, context: np.ndarray, at: np.ndarray, goal: np.ndarray, starts: np.ndarray, sizes: np.ndarray, subs: np.ndarray, lr: float) -> None:
    """Steps of the pairs of some centres; at: the words of the line, whose subwords are subs[starts[w] : starts[w] + sizes[w]]."""
    if not len(centre):
        return
    # centres rise
    new = np.concatenate(([True], centre[1:] != centre[:-1]))
    first = np.flatnonzero(new)
    own, plain = centre[first], len(subs) == len(sizes)  # each word its own row only
    words = at[context] if p.model == ModelKind.CBOW else at[own]
    ends = np.arange(len(words) + 1) if plain else np.concatenate(([0], np.cumsum(sizes[words])))
    ids = subs[starts[words]] if plain else subs[H.ranges(starts[words], sizes[words])]
    if p.model == ModelKind.CBOW:
        # a centre's input is all of its contexts' subwords
        offsets = np.append(ends[first], len(ids))
        of, targets = np.arange(len(own)), goal[own]
    else:
        of, offsets, targets = np.cumsum(new) - 1, ends, goal[context]
    if p.loss == LossKind.NS:
        step.batch(offsets, ids, of, targets, lr)
    else:
        for g, t in zip(of.tolist(), targets.tolist(), strict=True):
            step.update(ids[offsets[g] : offsets[g + 1]], np.array([t]), lr)


class Prepared:
    """What trainings on the same documents have in common, made once and by the first that asks: the vocabulary, and the lines by the parameters that decide them.

    Trainings may ask at the same time. They may differ in what is decided after the
    vocabulary, so not in counts, labels' prefix or the kind of model.
    """

    def __init__(self, docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.params, self.id_col, self.text_col = docs, params, id_col, text_col
        self._made: dict[tuple, object] = {}
        self._locks: dict[tuple, threading.Lock] = {}
        self._lock = threading.Lock()

    def _once(self, key: tuple, make: Callable[[], object]):
        with self._lock:
            own = self._locks.setdefault(key, threading.Lock())
        with own:
            if key not in self._made:
                self._made[key] = make()
            return self._made[key]

    def vocabulary(self, params: Params) -> Vocabulary:
        given = ("min_count", "min_count_label", "label", "model")
        if any(getattr(params, x) != getattr(self.params, x) for x in given):
            raise InvalidArgument(f"trainings on prepared documents have the same {', '.join(given)}")
        return replace(self._once(("vocabulary",), lambda: vocabulary.build(self.docs, self.params, self.text_col)), params=params)

    def lines(self, v: Vocabulary) -> tuple[DataFrame, int]:
        p = v.params
        key = ("lines", p.minn, p.maxn, p.bucket, p.word_ngrams, p.thread, p.seed)
        return self._once(key, lambda: _lines(self.docs, v, self.id_col, self.text_col))


class Course:
    """A training that can be gone on with: ``run`` takes it up to an epoch, ``model`` is what it has come to, ``end`` deletes what it has written."""

    def __init__(self, docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text", pretrained: DataFrame | None = None, start: Model | None = None, prepared: Prepared | None = None):
        if start:
            v = replace(start.vocabulary, params=params)
        else:
            v = prepared.vocabulary(params) if prepared else vocabulary.build(docs, params, text_col)
        p, spark = v.params, docs.sparkSession
        if p.model == ModelKind.SUPERVISED and not v.nlabels:
            raise InvalidArgument(f"no token begins with {p.label!r}")
        self.vocabulary, self.params, self.begun, self.losses, self.epochs = v, p, start is not None, [], 0
        self.n_input = v.nwords + p.bucket
        if not p.epoch:
            # no line is read
            lines, parts = spark.createDataFrame([], "key long, ids array<bigint>, targets array<int>, part int"), max(p.thread, 1)
        else:
            lines, parts = prepared.lines(v) if prepared and not start else _lines(docs, v, id_col, text_col)
        self.hs = None
        if p.loss == LossKind.HS:
            entries = v.labels().select(F.col("label_id").alias("id"), "count") if p.model == ModelKind.SUPERVISED else v.words().select("id", "count")
            self.hs = cut(path_table(spark, entries.toArrow().sort_by("id")["count"].to_numpy()))
        self.waves = waves = Waves(lines, v, parts, self.hs)
        given = None
        if start:
            given = start.input.select(F.lit(INPUT).alias("mat"), F.col("fid").cast("long").alias("row"), "vec").unionByName(start.output.select(F.lit(OUTPUT).alias("mat"), F.col("row").cast("long").alias("row"), "vec"))
        elif pretrained is not None:
            given = pretrained.join(v.words().select("token", "id"), "token").select(F.lit(INPUT).alias("mat"), F.col("id").cast("long").alias("row"), F.col("vec").cast("array<float>").alias("vec"))
        waves.start(self.n_input, given, start is not None)

    def run(self, upto: int, stop: threading.Event | None = None, on_epoch: Callable[[int, float], None] | None = None) -> None:
        """Goes on to an epoch, the learning rate by the epochs of the parameters. Once stop is set it ends after the wave that runs, and can't be gone on with."""
        p, waves, context = self.params, self.waves, self.waves.spark.sparkContext
        # the tag stays if the thread had it before
        own_tag = isinstance(stop, Stop) and stop.tag not in context.getJobTags()
        if own_tag:
            context.addJobTag(stop.tag)
        for epoch in range(self.epochs, min(upto, p.epoch)):
            total = n = 0.0
            for wave in range(waves.count):
                step = epoch * waves.count + wave
                try:
                    own_lines, rows = waves.take(step)
                    changed = waves.keep(step, waves.deal(rows, wave).cogroup(waves.deal(own_lines, wave)).applyInArrow(_kernel(p, epoch, wave, waves.count), _BLOCKS))
                    t, k = changed.where(F.col("mat") == LOSS).agg(F.sum(F.get("vec", F.lit(0)).cast("double")), F.sum(F.get("vec", F.lit(1)).cast("double"))).first()
                    waves.put(step, changed)
                except Exception:
                    # an interrupted wave leaves the weights as the last one filed them
                    if stop is None or not stop.is_set():
                        raise
                    break
                total, n = total + (t or 0.0), n + (k or 0.0)
                if stop is not None and stop.is_set():
                    break
            self.epochs = epoch + 1
            self.losses.append(total / (n or 1.0))
            if on_epoch:
                on_epoch(epoch, self.losses[-1])
            if stop is not None and stop.is_set():
                break
        if own_tag:
            context.removeJobTag(stop.tag)

    def model(self) -> Model:
        p, spark = self.params, self.waves.spark
        weights = cut(self.waves.read("weights").drop("step"))
        own = weights.where(F.col("mat") == INPUT).select("row", "vec")
        if not self.begun:
            rest = spark.range(self.n_input).select(F.col("id").alias("row")).join(own.select("row"), "row", "left_anti")
            own = own.unionByName(initial_rows(rest, self.n_input, p.dim, p.seed).select("row", "vec"))
        table = cut(own.select(F.col("row").alias("fid"), "vec"))
        output = weights.where(F.col("mat") == OUTPUT).select(F.col("row").cast("int").alias("row"), "vec")
        return Model(p, self.vocabulary, table, output, self.hs, tuple(self.losses))

    def end(self) -> None:
        self.waves.drop()


def train(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text", pretrained: DataFrame | None = None, start: Model | None = None, stop: threading.Event | None = None, on_epoch: Callable[[int, float], None] | None = None, prepared: Prepared | None = None) -> Model:
    """Train on the lines of docs, one for each row; labels are the tokens with params.label in the texts.

    pretrained: (token, vec) that replace the start of words in the vocabulary. start: a
    model whose vocabulary and weights are trained on. stop: checked after each wave; the
    model is usable as it is then. The waves' jobs have the tag of a Stop. prepared: the
    same documents, prepared for several trainings.
    """
    course = Course(docs, params, id_col, text_col, pretrained, start, prepared)
    course.run(params.epoch, stop, on_epoch)
    model = course.model()
    course.end()
    return model


class Stop(threading.Event):
    """Set to end work, whose Spark jobs have its tag."""

    def __init__(self):
        super().__init__()
        self.tag = f"lexivec-{uuid.uuid4().hex}"


class Interruptible:
    """Work in a thread of its own; abort() ends the jobs that run and have the tag of its Stop: all of them if ``whole``."""

    def __init__(self, spark: SparkSession, work: Callable[[Stop], object], whole: bool = False):
        self._stop, self._out, self._error, self._done = Stop(), None, None, threading.Event()
        self._context = spark.sparkContext
        # an interrupted task may give its Python worker back with a closed channel, and the next task there fails; this makes it rarer, not impossible
        spark.conf.set("spark.sql.execution.interruptOnCancel", "false")

        def run() -> None:
            try:
                if whole:
                    self._context.addJobTag(self._stop.tag)
                self._out = work(self._stop)
            except Exception as error:
                self._error = Aborted("ended before there was a result") if self._stop.is_set() and not isinstance(error, LexivecError) else error
            finally:
                self._done.set()

        self._thread = InheritableThread(target=run, session=spark)
        self._thread.daemon = True
        self._thread.start()

    def abort(self) -> None:
        """Ends the jobs that run; the thread goes on after them."""
        self._stop.set()
        self._context.cancelJobsWithTag(self._stop.tag)

    def wait(self, seconds: float) -> bool:
        """Whether it has ended, after so many seconds at most."""
        return self._done.wait(seconds)

    def result(self):
        self._thread.join()
        if self._error:
            raise self._error
        return self._out


class TrainingHandle(Interruptible):
    """Training in a thread of its own; abort() ends the wave that runs, and the result is the model as the waves before left it.

    What comes before the first wave isn't ended, nor a first wave that begins after abort().
    """

    def __init__(self, docs: DataFrame, params: Params, **given):
        super().__init__(docs.sparkSession, lambda stop: train(docs, params, stop=stop, **given))
