"""Hidden vectors, label scores and predictions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import hashing as H
from ..functions import text as T
from ..functions import vectors as V
from ..params import LossKind, ModelKind, Params
from ..storage import cut
from . import features
from .vocabulary import Vocabulary

#: Numbers in a table of vectors up to which it is broadcast (4 bytes each); larger ones are joined by shuffle.
BROADCAST_NUMBERS = 20_000_000
#: Blocks of rows, of at most BROADCAST_NUMBERS numbers each, up to which tasks hold a larger table block by block.
MOST_BLOCKS = 8
#: Labels scored together in one row.
LABEL_BLOCK = 1024


@dataclass
class Model:
    """input: (fid, vec); output: (row, vec), a row for each label (or word, or inner node); hs: (label_id, path, code)."""

    params: Params
    vocabulary: Vocabulary
    input: DataFrame
    output: DataFrame
    hs: DataFrame | None = None
    losses: tuple[float, ...] = ()

    @property
    def dimension(self) -> int:
        return self.params.dim

    @property
    def is_supervised(self) -> bool:
        return self.params.model == ModelKind.SUPERVISED

    @property
    def last_train_loss(self) -> float:
        return self.losses[-1] if self.losses else 0.0


def hint_small(table: DataFrame, numbers: int) -> DataFrame:
    return F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table


@dataclass
class Here:
    """What a task has itself, in the place of a broadcast."""

    value: tuple[np.ndarray, np.ndarray]


@dataclass
class Held:
    """A small table of vectors in tasks: sorted row numbers and a matrix."""

    held: Broadcast | Here

    def means(self, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The mean of the rows of each list of ids, repeats counted; zeros where none is there."""
        rows, matrix = self.held.value
        out = np.zeros((len(offsets) - 1, matrix.shape[1]))
        for at, sums, n in self._sums(offsets, ids):
            out[at] = sums / n[:, None]
        return out

    def sums(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the sum of the rows of each list of ids, repeats counted; how many there are)."""
        out, count = np.zeros((len(offsets) - 1, self.held.value[1].shape[1])), np.zeros(len(offsets) - 1, np.int64)
        for at, sums, n in self._sums(offsets, ids):
            out[at], count[at] = sums, n
        return out, count

    def _sums(self, offsets: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(lists, their sums, how many rows each has) for 64 lists at a time, without those that have none."""
        rows, matrix = self.held.value
        if not len(rows) or not len(ids):
            return
        at = np.searchsorted(rows, ids).clip(max=len(rows) - 1)
        own, at = H.kept(offsets, at, rows[at] == ids)
        for a in range(0, len(offsets) - 1, 64):
            b = min(a + 64, len(offsets) - 1)
            n = np.diff(own[a : b + 1])
            some = np.flatnonzero(n)
            if len(some):
                yield a + some, np.add.reduceat(matrix[at[own[a] : own[b]]], own[a:b][some] - own[a], axis=0, dtype=np.float64), n[some]


def hold(table: DataFrame, numbers: int, dim: int, row_col: str = "fid") -> Held | None:
    """The table (row_col, vec) for all tasks, if it has at most BROADCAST_NUMBERS numbers; else None."""
    if numbers > BROADCAST_NUMBERS or table.limit(BROADCAST_NUMBERS // dim + 1).count() > BROADCAST_NUMBERS // dim:
        return None
    own = table.select(F.col(row_col).cast("long").alias("row"), F.col("vec").cast("array<float>").alias("vec")).toArrow().sort_by("row").combine_chunks()
    matrix = np.asarray(own["vec"].combine_chunks().flatten(), np.float32).reshape(-1, dim) if own.num_rows else np.zeros((0, dim), np.float32)
    return Held(table.sparkSession.sparkContext.broadcast((own["row"].to_numpy(), matrix)))


def _vectors(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), pa.array(matrix.ravel()))


def hidden(lines: DataFrame, table: DataFrame, dim: int, id_col: str = "doc_id", fids_col: str = "fids", rows: int | None = None) -> DataFrame:
    """(id_col, hidden), a row for each line: the mean of the input rows of its ids, repeats counted; zeros if none is there.

    A table of at most BROADCAST_NUMBERS (rows * dim) is held by each task and nothing is
    shuffled. Of one with up to MOST_BLOCKS times as many each task holds a block of rows, and
    the lines' sums over the blocks are added up: a few vectors a line are shuffled. For larger
    ones each part of the lines gets the rows of its own ids, a vector for each different id.
    """
    small = None if rows is None else hold(table, rows * dim, dim)
    if small is not None:
        return features.map_lists(lines, [F.col(id_col)], F.col(fids_col), lambda lists: [_vectors(small.means(*_ids(lists)))], "hidden array<double>")
    blocks = None if rows is None else hold_blocks(table, rows, dim)
    if blocks is not None:
        return _hidden_by_blocks(lines, blocks, dim, id_col, fids_col)
    vectors = table.where("vec is not null").select(F.col("fid").cast("long").alias("item"), F.col("vec").cast("array<float>").alias("vec"))

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("item").combine_chunks()
        matrix = np.asarray(found["vec"].combine_chunks().flatten(), np.float32).reshape(-1, dim) if found.num_rows else np.zeros((0, dim), np.float32)
        part = Held(Here((found["item"].to_numpy(), matrix)))
        made = [pa.RecordBatch.from_arrays([b.column("key"), _vectors(part.means(*_ids(b.column("items"))))], names=["key", "hidden"]) for b in own.to_batches(1000)]
        return pa.Table.from_batches(made)

    fids = lambda c: F.coalesce(c, F.array()).cast("array<bigint>")
    return features.by_parts(lines, [F.col(id_col)], F.col(fids_col), fids, vectors, run, "hidden array<double>").select("key.*", "hidden")


def hold_blocks(table: DataFrame, rows: int, dim: int) -> list[Held] | None:
    """Blocks of rows of the table (fid, vec), each of which a task can hold, if there are at most MOST_BLOCKS; else None."""
    size = BROADCAST_NUMBERS // dim
    if not size or -(-rows // size) > MOST_BLOCKS:
        return None
    starts, out = range(0, rows, size), []
    for a in starts:
        inside = F.lit(True)
        if a > 0:
            inside = inside & (F.col("fid") >= a)
        if a + size < rows:
            inside = inside & (F.col("fid") < a + size)
        own = hold(table.where(inside), min(size, rows - a) * dim, dim)
        if own is None:
            return None
        out.append(own)
    return out


def _hidden_by_blocks(lines: DataFrame, blocks: list[Held], dim: int, id_col: str, fids_col: str) -> DataFrame:
    """hidden() of a table in blocks. Lines are known by their id and the hash of their ids; those that have both in common have the same mean."""
    same = [F.col(id_col), F.xxhash64(fids_col, F.size(fids_col)).alias("_h")]

    def over(block: Held) -> DataFrame:
        def use(lists: pa.Array) -> list[pa.Array]:
            sums, n = block.sums(*_ids(lists))
            return [_vectors(sums), pa.array(n)]

        return features.map_lists(lines, same, F.col(fids_col), use, "_sums array<double>, _n long")

    each = reduce(DataFrame.unionByName, map(over, blocks))
    added = each.groupBy(id_col, "_h").agg(V.sum_of("_sums", dim).alias("_v"), F.sum("_n").alias("_n"), (F.count("*") / len(blocks)).cast("int").alias("_times"))
    mean = F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(F.col("_v"))
    return added.select(id_col, mean.alias("hidden"), F.explode(F.sequence(F.lit(1), F.col("_times")))).select(id_col, "hidden")


def _ids(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, values = H.list_parts(lists)
    return offsets, values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def label_blocks(output: DataFrame, block: int = LABEL_BLOCK) -> DataFrame:
    """(block, rows array<struct<row, vec>>)."""
    return output.groupBy(F.floor(F.col("row") / block).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "vec"))).alias("rows"))


def logits(hidden_rows: DataFrame, output: DataFrame, n_rows: int, dim: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, block, z array<struct<row, z>>): dot products with all output rows, a row for each block of them."""
    blocks = -(-max(n_rows, 1) // LABEL_BLOCK)
    spread = hidden_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), V.dot(F.col("hidden"), r["vec"]).alias("z")))
    return spread.join(hint_small(label_blocks(output), n_rows * dim), "block").select(id_col, "block", own.alias("z"))


def top_k(scores: Column, k: int, threshold: float) -> Column:
    """The k largest of array<struct<p, label_id>> with p at the threshold or above; equal ones by higher label."""
    kept = F.filter(scores, lambda s: s["p"] >= F.lit(max(float(threshold), 0.0)))
    return F.slice(F.reverse(F.array_sort(kept)), 1, k)


def label_probabilities(z: DataFrame, loss: LossKind, id_col: str = "doc_id", n_rows: int = 1) -> DataFrame:
    """(id_col, block, scores array<struct<p, label_id>>) of logits(); softmax sums go over all blocks of a line."""
    values = F.transform("z", lambda s: s["z"])
    if loss in (LossKind.OVA, LossKind.NS):
        return z.select(id_col, "block", F.transform("z", lambda s: F.struct(V.table_sigmoid(s["z"]).alias("p"), s["row"].alias("label_id"))).alias("scores"))
    if loss != LossKind.SOFTMAX:
        raise InvalidArgument("paths are scored by path_probabilities")
    if n_rows <= LABEL_BLOCK:
        return z.withColumn("_p", V.softmax(values)).select(id_col, "block", F.zip_with("_p", "z", lambda p, s: F.struct(p.alias("p"), s["row"].alias("label_id"))).alias("scores"))
    top = F.array_max(values)
    part = z.withColumn("_m", top).withColumn("_s", F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m"))))
    parts = part.groupBy(F.col(id_col).alias("_id")).agg(F.max("_m").alias("m"), F.collect_list(F.struct("_m", "_s")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["_s"] * F.exp(x["_m"] - F.col("m")))
    norm = parts.select("_id", "m", total.alias("total"))
    return z.join(norm, F.col(id_col) == F.col("_id")).select(id_col, "block", F.transform("z", lambda s: F.struct((F.exp(s["z"] - F.col("m")) / F.col("total")).alias("p"), s["row"].alias("label_id"))).alias("scores"))


def path_probabilities(z: DataFrame, paths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, label_id, p) of logits() of all inner nodes, for hierarchical softmax: the product over a label's path of exact sigmoids, by shifted logarithms.

    id_col tells lines apart. Each step of a path is a row that is joined with its node; a
    label without steps, the only one, has probability 1.
    """
    each = z.select(id_col, F.inline("z")).withColumn("f", V.exact_sigmoid(F.col("z")))
    steps = paths.select("label_id", F.inline(F.arrays_zip(F.col("path").alias("node"), F.col("code").alias("right")))).select("label_id", F.col("node").alias("row"), "right")
    log_p = V.std_log(F.when(F.col("right"), F.col("f")).otherwise(1.0 - F.col("f")))
    found = each.join(steps, "row").groupBy(id_col, "label_id").agg(F.exp(F.sum(log_p)).alias("p"))
    only = paths.where(F.size("path") == 0).select("label_id", F.lit(1.0).alias("p")).limit(1)
    return found.unionByName(z.select(id_col).distinct().crossJoin(F.broadcast(only)).select(id_col, "label_id", "p"))


@dataclass
class Tree:
    """The tree of hierarchical softmax: children of inner nodes (left, right; label l as -1 - l), how many steps the longest way down has, and the root."""

    children: np.ndarray
    height: np.ndarray
    root: int

    @classmethod
    def of(cls, labels: np.ndarray, offsets: np.ndarray, nodes: np.ndarray, right: np.ndarray) -> Tree:
        """From the paths of labels, leaf to root: label labels[i] has the inner nodes nodes[offsets[i] : offsets[i + 1]], and right tells which child the step before was."""
        if not len(nodes):
            return cls(np.zeros((0, 2), np.int64), np.zeros(0, np.int64), -1 - int(labels[0]) if len(labels) else 0)
        children, height = np.zeros((int(nodes.max()) + 1, 2), np.int64), np.zeros(int(nodes.max()) + 1, np.int64)
        starts = offsets[:-1][np.diff(offsets) > 0]
        below = np.concatenate(([0], nodes[:-1]))
        below[starts] = -1 - labels[np.diff(offsets) > 0]
        children[nodes, right.astype(np.int64)] = below
        np.maximum.at(height, nodes, np.arange(len(nodes)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1)
        return cls(children, height, int(nodes[offsets[1] - 1] if offsets[1] else nodes[-1]))

    def best(self, h: np.ndarray, rows: np.ndarray, matrix: np.ndarray, k: int, least: float) -> tuple[list[list[tuple[float, int]]], int]:
        """For each vector of h the k best (p, label) with p at ``least`` or above, equal ones by higher label; and how many inner nodes were looked at.

        Best first: in each round every vector opens the most likely inner node that it has
        reached, all of them in one product, until none can lead to a label above its k
        best. A step multiplies by at most 1 + LOG_SHIFT, which bounds what is below a node.
        """
        n, looked = len(h), 0
        floor = np.log(least) - 1e-12 if least > 0 else -np.inf
        step = float(np.log1p(V.LOG_SHIFT))
        found: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        ahead: list[list[tuple[float, int, float]]] = [[] for _ in range(n)]
        at = np.zeros(int(self.children.shape[0]), np.int64)
        if len(at):
            at = np.searchsorted(rows, np.arange(len(at)))

        def reach(i: int, node: int, log_p: float) -> None:
            if node < 0:
                # the best labels, the worst first
                (heapq.heappush if len(found[i]) < k else heapq.heappushpop)(found[i], (log_p, -1 - node))
            else:
                heapq.heappush(ahead[i], (-(log_p + step * self.height[node]), node, log_p))

        for i in range(n):
            reach(i, self.root, 0.0)
        live = list(range(n))
        while live:
            opened = []
            for i in live:
                if ahead[i] and (bound := -ahead[i][0][0]) >= floor and (len(found[i]) < k or bound >= found[i][0][0]):
                    opened.append((i, *heapq.heappop(ahead[i])[1:]))
            live = [i for i, _, _ in opened]
            if not opened:
                break
            looked += len(opened)
            nodes = np.array([node for _, node, _ in opened])
            f = _sigmoid(np.einsum("ij,ij->i", h[live], matrix[at[nodes]].astype(np.float64)))
            logs = np.log(np.stack((1.0 - f, f), axis=1) + V.LOG_SHIFT)
            for (i, node, log_p), (left, right) in zip(opened, logs.tolist(), strict=True):
                reach(i, int(self.children[node, 0]), log_p + left)
                reach(i, int(self.children[node, 1]), log_p + right)
        return [[(p, label) for x, label in sorted(own, reverse=True) if (p := float(np.exp(x))) >= least] for own in found], looked


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def tree_table(paths: DataFrame) -> DataFrame:
    """(node, left, right, height) of paths (label_id, path, code): each inner node's children, label l as -1 - l; a row a node."""
    steps = F.transform("path", lambda node, i: F.struct(node.cast("long").alias("node"), F.get("code", i).alias("right"), (i + 1).alias("height"), F.when(i == 0, -1 - F.col("label_id").cast("long")).otherwise(F.get("path", i - 1).cast("long")).alias("child")))
    each = paths.select(F.inline(steps))
    side = lambda right: F.max(F.when(F.col("right") == right, F.col("child")))
    return each.groupBy("node").agg(side(False).alias("left"), side(True).alias("right"), F.max("height").alias("height"))


def search_paths(hidden_rows: DataFrame, output: DataFrame, paths: DataFrame, k: int, threshold: float, id_col: str) -> DataFrame:
    """(id_col, predictions) as predict_features has them, for a tree too large for one task: level by level, by joins of what lines have reached with the nodes.

    id_col tells lines apart. What can't be above a line's k best, or the threshold, isn't
    followed; each node of a level is met by a line at most once.
    """
    nodes = cut(tree_table(paths).join(output.select(F.col("row").cast("long").alias("node"), "vec"), "node"))
    root = nodes.orderBy(F.col("height").desc()).select("node").first()
    step, floor = float(np.log1p(V.LOG_SHIFT)), float(np.log(threshold) - 1e-12) if threshold > 0 else None
    best = lambda column: F.slice(F.reverse(F.array_sort(column)), 1, k)
    if root is None:
        own = F.array(F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("label_id")))
        return hidden_rows.select(id_col, F.filter(own, lambda s: s["p"] >= threshold).alias("predictions"))
    ahead = hidden_rows.select(id_col, F.lit(root.node).alias("node"), F.lit(0.0).alias("log_p"))
    found = None
    while True:
        f = V.exact_sigmoid(V.dot(F.col("hidden"), F.col("vec")))
        met = ahead.join(hidden_rows.select(id_col, "hidden"), id_col).join(nodes, "node").withColumn("f", f)
        ways = F.array(
            F.struct(F.col("left").alias("node"), (F.col("log_p") + V.std_log(1.0 - F.col("f"))).alias("log_p")),
            F.struct(F.col("right").alias("node"), (F.col("log_p") + V.std_log(F.col("f"))).alias("log_p")),
        )
        reached = cut(met.select(id_col, F.inline(ways)))
        new = reached.where("node < 0").select(id_col, F.struct("log_p", (-1 - F.col("node")).cast("int").alias("label_id")).alias("s"))
        every = new.groupBy(id_col).agg(best(F.collect_list("s")).alias("b"))
        if found is not None:
            both = found.unionByName(every).select(id_col, F.explode("b").alias("s"))
            every = both.groupBy(id_col).agg(best(F.collect_list("s")).alias("b"))
        found = cut(every)
        bound = F.col("log_p") + step * F.col("height")
        least = F.when(F.size("b") >= k, F.get("b", F.lit(k - 1))["log_p"])
        open_nodes = reached.where("node >= 0").join(nodes.select("node", "height"), "node").join(found, id_col, "left")
        kept = open_nodes.where((bound >= least) | least.isNull())
        ahead = cut((kept if floor is None else kept.where(bound >= floor)).select(id_col, "node", "log_p"))
        if ahead.isEmpty():
            break
    scored = F.transform("b", lambda s: F.struct(F.exp(s["log_p"]).alias("p"), s["label_id"].alias("label_id")))
    return found.select(id_col, F.filter(scored, lambda s: s["p"] >= max(float(threshold), 0.0)).alias("predictions"))


def predict_features(lines: DataFrame, model: Model, k: int = 1, threshold: float = 0.0, id_col: str = "doc_id") -> DataFrame:
    """(id_col, predictions array<struct<p, label_id>>), a row for each of (id_col, fids), best first; no ids or k = 0 give none.

    If both tables are small each task holds them, else they are joined block by block.
    """
    v, dim = model.vocabulary, model.params.dim
    none = F.array().cast("array<struct<p:double,label_id:int>>")
    if k <= 0 or not model.is_supervised or v.nlabels == 0:
        return lines.select(id_col, none.alias("predictions"))
    rows = v.nwords + (model.params.bucket if model.params.maxn > 0 or model.params.word_ngrams > 1 else 0)
    k = min(k, v.nlabels)
    table = hold(model.input, rows * dim, dim)
    output = hold(model.output, v.nlabels * dim, dim, "row") if table is not None else None
    if output is not None:
        paths = _held_tree(model) if model.params.loss == LossKind.HS else None
        loss, least = model.params.loss, max(float(threshold), 0.0)
        return features.map_lists(lines, [F.col(id_col)], F.col("fids"), lambda lists: [_best(*_ids(lists), table, output, paths, loss, k, least)], "predictions array<struct<p:double,label_id:int>>")
    numbered = cut(lines.select(F.col(id_col).alias("_id"), "fids", F.monotonically_increasing_id().alias("_row")))
    h = hidden(numbered.where(F.size("fids") > 0), model.input, dim, "_row", rows=rows)
    if model.params.loss == LossKind.HS:
        best = search_paths(cut(h), model.output, model.hs, k, max(float(threshold), 0.0), "_row")
    else:
        scored = label_probabilities(logits(h, model.output, v.nlabels, dim, "_row"), model.params.loss, "_row", v.nlabels)
        best = scored.select("_row", top_k(F.col("scores"), k, threshold).alias("predictions"))
        if v.nlabels > LABEL_BLOCK:
            best = best.groupBy("_row").agg(top_k(F.flatten(F.collect_list("predictions")), k, threshold).alias("predictions"))
    return numbered.select("_row", "_id").join(best, "_row", "left").select(F.col("_id").alias(id_col), F.coalesce("predictions", none).alias("predictions"))


def _held_tree(model: Model) -> Broadcast:
    """The tree in all tasks, a few numbers a label."""
    own = model.hs.select("label_id", "path", "code").toArrow().sort_by("label_id").combine_chunks()
    path = own["path"].combine_chunks()
    offsets = np.asarray(path.offsets) - path.offsets[0].as_py()
    tree = Tree.of(own["label_id"].to_numpy(), offsets, np.asarray(path.flatten(), np.int64), own["code"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
    return model.input.sparkSession.sparkContext.broadcast(tree)


def _scores(h: np.ndarray, output: Held, loss: LossKind) -> tuple[np.ndarray, np.ndarray]:
    """(label ids, probabilities [lines, labels])."""
    rows, matrix = output.held.value
    z = h @ matrix.T.astype(np.float64)
    if loss == LossKind.SOFTMAX:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return rows, e / e.sum(axis=1, keepdims=True)
    return rows, V.grid_sigmoid(z)


def _best(offsets: np.ndarray, ids: np.ndarray, table: Held, output: Held, paths: Broadcast | None, loss: LossKind, k: int, least: float) -> pa.Array:
    h, ends, probabilities, labels = table.means(offsets, ids), [0], [], []
    if paths is not None:
        some = np.flatnonzero(np.diff(offsets))
        found, _ = paths.value.best(h[some], *output.held.value, k, least)
        sizes = np.zeros(len(h), np.int64)
        sizes[some] = [len(x) for x in found]
        each = [x for own in found for x in own]
        structs = pa.StructArray.from_arrays([pa.array([p for p, _ in each], pa.float64()), pa.array([i for _, i in each], pa.int32())], names=["p", "label_id"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), structs)
    step = max(1, (1 << 21) // max(len(output.held.value[0]), 1))
    for a in range(0, len(h), step):
        names, p = _scores(h[a : a + step], output, loss)
        order = np.lexsort((np.broadcast_to(names, p.shape), p), axis=1)[:, ::-1][:, :k]
        top = np.take_along_axis(p, order, axis=1)
        # a NaN is above all in the order and left out here
        good = (top >= least) & (np.diff(offsets[a : a + len(p) + 1]) > 0)[:, None]
        probabilities.append(top[good])
        labels.append(names[order][good].astype(np.int32))
        ends.append(good.sum(axis=1))
    structs = pa.StructArray.from_arrays([pa.array(np.concatenate([*probabilities, np.empty(0)])), pa.array(np.concatenate([*labels, np.empty(0, np.int32)]).astype(np.int32))], names=["p", "label_id"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([np.atleast_1d(x) for x in ends])).astype(np.int32)), structs)


def with_labels(predictions: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id_col, rank, label, prob) with the label's name; prob is p + 1e-5 and may exceed 1."""
    each = predictions.select(id_col, F.posexplode("predictions").alias("rank", "s")).select(id_col, "rank", F.col("s.label_id"), (F.col("s.p") + V.LOG_SHIFT).alias("prob"))
    names = model.vocabulary.labels().select("label_id", F.col("token").alias("label"))
    return each.join(F.broadcast(names) if model.vocabulary.nlabels <= 500_000 else names, "label_id").select(id_col, "rank", "label", "prob")


def predict(docs: DataFrame, model: Model, k: int = 1, threshold: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, label, prob) for each document's k best labels; documents without features have no rows."""
    return with_labels(predict_features(features.line_features(docs, model.vocabulary, id_col, text_col), model, k, threshold, id_col), model, id_col)


def _table_rows(model: Model) -> int:
    return model.vocabulary.nwords + max(model.params.bucket, 0)


def word_vectors(words: DataFrame, model: Model) -> DataFrame:
    """(token, vec): the mean of a token's subword rows; zeros if it has none. words: (token), no repeats."""
    lines = features.subwords_of(words.select("token"), model.vocabulary).select("token", F.when(F.col("entry_type") == 1, F.array().cast("array<bigint>")).otherwise(F.col("subwords")).alias("fids"))
    return hidden(lines, model.input, model.params.dim, "token", rows=_table_rows(model)).withColumnRenamed("hidden", "vec")


def ngram_vectors(words: DataFrame, model: Model) -> DataFrame:
    """(token, pos, gram, vec)."""
    grams = features.ngram_strings(words, model.vocabulary)
    return grams.join(hint_small(model.input, _table_rows(model) * model.params.dim), "fid").select("token", "pos", "gram", "vec")


def sentence_vectors(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, vec). Supervised: mean of all feature rows. Else: mean of the normalised vectors of the tokens that have one."""
    dim = model.params.dim
    if model.is_supervised:
        lines = features.line_features(docs, model.vocabulary, id_col, text_col)
        return hidden(lines, model.input, dim, id_col, rows=_table_rows(model)).withColumnRenamed("hidden", "vec")
    tokens = docs.select(id_col, F.explode(T.simple_tokens(text_col)).alias("token")).groupBy(id_col, "token").agg(F.count("*").cast("double").alias("n"))
    own = word_vectors(tokens.select("token").distinct(), model)
    unit = own.where(V.norm(F.col("vec")) > 0).select("token", V.l2_normalize(F.col("vec")).alias("vec"))
    sums = tokens.join(unit, "token").groupBy(F.col(id_col).alias("_id")).agg(F.sum("n").alias("_n"), V.sum_of("vec", dim, F.col("n")).alias("_v"))
    zeros = F.array(*(F.lit(0.0) for _ in range(dim)))
    return docs.select(id_col).join(sums, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce(F.transform("_v", lambda x: x / F.col("_n")), zeros).alias("vec"))
