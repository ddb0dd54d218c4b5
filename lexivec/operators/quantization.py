"""Product quantization: codebooks, codes, quantized matrices, pruning before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import text as T
from ..functions import vectors as V
from ..params import LossKind, Params
from ..storage import cut
from . import training, vocabulary
from .scoring import Model

# Fixed values of the format: codes are bytes; rows and rounds of the fit; the split of an empty cluster.
CENTROIDS, SAMPLE_ROWS, ROUNDS, SEED, SPLIT = 256, 65_536, 25, 1234, 1e-7
_BOOK = "m int, code int, centroid array<float>"


def pieces(dim: int, dsub: int) -> list[tuple[int, int]]:
    """(start, length) of each sub-vector; the last may be shorter."""
    return [(s, min(dsub, dim - s)) for s in range(0, dim, dsub)]


def _kmeans(x: np.ndarray, seed: int) -> np.ndarray:
    """CENTROIDS means of rows; fewer rows are cycled. Empty clusters take half of a large one."""
    if len(x) < CENTROIDS:
        return x[np.arange(CENTROIDS) % len(x)]
    rng = np.random.default_rng(seed)
    means = x[rng.permutation(len(x))[:CENTROIDS]].astype(np.float32)
    signs = np.where(np.arange(x.shape[1]) % 2, SPLIT, -SPLIT).astype(np.float32)
    for _ in range(ROUNDS):
        code = nearest(x, means)
        size = np.bincount(code, minlength=CENTROIDS)
        sums = np.stack([np.bincount(code, x[:, j], CENTROIDS) for j in range(x.shape[1])], axis=1)
        means = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], means).astype(np.float32)
        for k in np.flatnonzero(size == 0):
            big = int(size.argmax())
            means[k], means[big] = means[big] + signs, means[big] - signs
            size[k] = size[big] // 2
            size[big] -= size[k]
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The first nearest mean of each row."""
    x, means = x.astype(np.float64), means.astype(np.float64)
    return ((means**2).sum(axis=1)[None] - 2 * x @ means.T).argmin(axis=1)


def fit(table: DataFrame, dim: int, dsub: int, row_col: str = "fid") -> DataFrame:
    """(m, code, centroid): one task for each sub-vector, on at most SAMPLE_ROWS rows of (row_col, vec), chosen by hash.

    The bound is the format's own; every row is encoded later.
    """
    n = table.count()
    rows = table if n <= SAMPLE_ROWS else table.orderBy(F.xxhash64(row_col), row_col).limit(SAMPLE_ROWS)
    cuts = pieces(dim, dsub)
    parts = F.array(*(F.struct(F.lit(m).alias("m"), F.slice("vec", s + 1, n).cast("array<float>").alias("sub")) for m, (s, n) in enumerate(cuts)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        m = group["m"][0].as_py()
        means = _kmeans(np.array(group["sub"].to_pylist(), np.float32), SEED + m)
        return pa.Table.from_arrays([pa.array([m] * CENTROIDS, pa.int32()), pa.array(range(CENTROIDS), pa.int32()), pa.array(means.tolist(), pa.list_(pa.float32()))], names=["m", "code", "centroid"])

    return rows.select(F.col(row_col).alias("row"), F.explode(parts).alias("p")).select("row", "p.m", "p.sub").groupBy("m").applyInArrow(run, _BOOK)


def codebook_array(book: DataFrame) -> list[np.ndarray]:
    """The codebook on the driver: 256 * dim numbers, whatever the size of the matrix."""
    out: dict[int, list] = {}
    for r in book.orderBy("m", "code").collect():
        out.setdefault(r.m, []).append(r.centroid)
    return [np.array(out[m], np.float32) for m in sorted(out)]


def encode(table: DataFrame, books: list[np.ndarray], row_col: str = "fid") -> DataFrame:
    """(row_col, codes binary): the nearest centroid of each sub-vector of each row."""
    starts = np.cumsum([0, *(b.shape[1] for b in books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float32).reshape(batch.num_rows, -1)
            codes = np.stack([nearest(x[:, s : s + b.shape[1]], b) for s, b in zip(starts, books, strict=False)], axis=1).astype(np.uint8) if batch.num_rows else np.empty((0, len(books)), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], names=[row_col, "codes"])

    return table.select(F.col(row_col).cast("long").alias(row_col), "vec").mapInArrow(run, f"{row_col} long, codes binary")


def decode(codes: DataFrame, books: list[np.ndarray], row_col: str = "fid") -> DataFrame:
    """(row_col, vec) of (row_col, codes[, norm])."""
    scaled = "norm" in codes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(books))
            vec = np.concatenate([b[c[:, m]] for m, b in enumerate(books)], axis=1)
            if scaled:
                vec = vec * np.array(batch.column(2).to_pylist(), np.float32)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec.tolist(), pa.list_(pa.float32()))], names=[row_col, "vec"])

    return codes.select(row_col, "codes", *(["norm"] if scaled else [])).mapInArrow(run, f"{row_col} long, vec array<float>")


def assign(sub: Column, centroids: Column) -> Column:
    """Code of a sub-vector by a codebook in array<struct<code, centroid>>: least squared distance, the first wins."""
    dist = F.transform(centroids, lambda c: F.struct(F.aggregate(F.zip_with(sub, c["centroid"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["code"].alias("code")))
    return F.array_min(dist)["code"]


@dataclass
class Quantized:
    """A matrix as codes: codes (row, codes[, norm]), books, and whether norms were taken out."""

    codes: DataFrame
    books: list[np.ndarray]
    row_col: str
    norm_book: np.ndarray | None = None

    def dense(self) -> DataFrame:
        return decode(self.codes, self.books, self.row_col)


def quantize_matrix(table: DataFrame, dim: int, dsub: int, qnorm: bool = False, row_col: str = "fid") -> Quantized:
    """Codes of (row_col, vec); with qnorm the rows' lengths are quantized apart from their directions."""
    own, lengths, norm_book = table.select(row_col, "vec"), None, None
    if qnorm:
        length = V.checked_norm(F.col("vec"))
        own = cut(own.withColumn("n", length))
        norms = own.select(row_col, F.array(F.col("n").cast("float")).alias("vec"))
        norm_book = codebook_array(fit(norms, 1, 1, row_col))[0]
        lengths = decode(encode(norms, [norm_book], row_col), [norm_book], row_col).select(row_col, F.get("vec", F.lit(0)).alias("norm"))
        own = own.select(row_col, F.transform("vec", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(x).cast("float")).alias("vec"))
    books = codebook_array(fit(own, dim, dsub, row_col))
    codes = encode(own, books, row_col)
    return Quantized(cut(codes.join(lengths, row_col) if lengths is not None else codes), books, row_col, norm_book)


def select_rows(model: Model, cutoff: int) -> DataFrame:
    """(fid): the end-of-line row first, then the longest rows, ``cutoff`` in all; ties by id."""
    eos = model.vocabulary.id_of(T.EOS)
    first = F.col("fid") == F.lit(-1 if eos is None else eos)
    return model.input.select("fid", first.cast("int").alias("eos"), V.checked_norm(F.col("vec")).alias("n")).orderBy(F.desc("eos"), F.desc("n"), "fid").limit(cutoff).select("fid")


def prune_model(model: Model, cutoff: int) -> Model:
    """The model with the ``cutoff`` best input rows: words keep their order, n-gram rows follow in that of their buckets."""
    kept = cut(select_rows(model, cutoff))
    v = vocabulary.prune(model.vocabulary, kept)
    words = model.vocabulary.words().select(F.col("id").alias("fid"), "token").join(v.words().select("token", F.col("id").alias("new")), "token").select("fid", "new")
    grams = v.prune.select((F.col("bucket") + model.vocabulary.nwords).alias("fid"), (F.col("new_id") + v.nwords).cast("int").alias("new"))
    rows = model.input.join(words.unionByName(grams), "fid").select(F.col("new").cast("long").alias("fid"), "vec")
    return replace(model, vocabulary=v, input=cut(rows))


@dataclass
class QuantizedModel:
    model: Model
    input: Quantized
    output: Quantized | None

    def as_model(self) -> Model:
        """The model with decoded matrices, scored by softmax unless it is one-vs-all or sampled."""
        out = self.model.output if self.output is None else self.output.dense().select(F.col("row").cast("int").alias("row"), "vec")
        return replace(self.model, input=self.input.dense(), output=out)

    def bytes(self) -> int:
        """Size of codes and codebooks, about."""
        n = self.input.codes.count() * (len(self.input.books) + (self.input.norm_book is not None)) + sum(b.nbytes for b in self.input.books)
        return n + (self.output.codes.count() * len(self.output.books) + sum(b.nbytes for b in self.output.books) if self.output else self.model.output.count() * self.model.params.dim * 4)


def quantize(model: Model, dsub: int = 2, cutoff: int = 0, qnorm: bool = False, qout: bool = False, retrain_on: DataFrame | None = None, **given) -> QuantizedModel:
    """Prune (cutoff), train on (retrain_on, only after pruning) and quantize a supervised model.

    given: lr, epoch and thread of the retraining.
    """
    if not model.is_supervised:
        raise InvalidArgument("only supervised models are quantized")
    p: Params = model.params
    if p.loss not in (LossKind.SOFTMAX, LossKind.OVA, LossKind.NS, LossKind.HS):
        raise InvalidArgument("unknown loss")
    if 0 < cutoff < model.input.count():
        pruned = prune_model(model, cutoff)
        if retrain_on is not None:
            retrained = training.train(retrain_on, replace(p, **given), start=replace(pruned, vocabulary=replace(pruned.vocabulary, params=replace(p, **given))))
            pruned = replace(pruned, input=retrained.input, output=retrained.output, losses=retrained.losses)
        model = pruned
    table = quantize_matrix(model.input, p.dim, dsub, qnorm)
    out = quantize_matrix(model.output, p.dim, 2, qnorm, "row") if qout else None
    return QuantizedModel(model, table, out)
