"""Binary model files, little-endian, of format version 12 (version 11 is read).

A file is a header, thirteen parameters, the dictionary, and the two matrices, each plain
or quantized. Reading: the driver reads the header and runs through the dictionary, whose
entries have no fixed length, a block at a time; tasks read ranges of its rows and of those
of the matrices. Writing: save_binary streams rows into the file in order, on the driver,
which holds one partition at a time; model_format.write_model writes the same bytes by tasks.
save()/load() take Parquet tables.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import InvalidModel
from ..operators.quantization import Quantized, QuantizedModel, pieces
from ..operators.scoring import Model
from ..operators.training import path_table
from ..operators.vocabulary import Vocabulary
from ..params import FILE_FIELDS, LossKind, ModelKind, Params

# Fixed values of the format.
MAGIC, VERSION, OLDEST = 793712314, 12, 11
_PARAMS = struct.Struct("<12id")
_DICT = struct.Struct("<iiiqq")
_SHAPE = struct.Struct("<qq")
#: What follows a word and its zero: count and kind.
_FACTS = struct.Struct("<qb")
_BLOCK = 8 << 20
#: Rows of a matrix or of the dictionary that one task reads at once.
READ_ROWS = 50_000


def _opened(path: str):
    files, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, own


def pack_params(p: Params) -> bytes:
    return _PARAMS.pack(*(int(getattr(p, f)) for f in FILE_FIELDS[:-1]), float(p.t))


def unpack_params(data: bytes) -> Params:
    if len(data) != _PARAMS.size:
        raise InvalidModel("parameters are cut off")
    given = dict(zip(FILE_FIELDS, _PARAMS.unpack(data), strict=True))
    try:
        return Params(**{**given, "loss": LossKind(given["loss"]), "model": ModelKind(given["model"])})
    except ValueError as error:
        raise InvalidModel(str(error)) from None


class _Reader:
    def __init__(self, source):
        self.source = source

    def take(self, n: int) -> bytes:
        data = self.source.read(n)
        if len(data) != n:
            raise InvalidModel("the file is cut off")
        return data

    def unpack(self, form: struct.Struct) -> tuple:
        return form.unpack(self.take(form.size))


@dataclass
class Dictionary:
    """Where the entry of every ``every``-th row begins, and the last ends; words, labels and tokens; the prune table's rows, -1 if there is none."""

    rows: int
    every: int
    starts: list[int]
    nwords: int
    nlabels: int
    ntokens: int
    pruned: int

    @classmethod
    def read(cls, source) -> Dictionary:
        """Entries have no fixed length, so they are read through once; a block of them is held, and nothing is kept of them."""
        size, nwords, nlabels, ntokens, pruned = _Reader(source).unpack(_DICT)
        if min(size, nwords, nlabels) < 0:
            raise InvalidModel("negative sizes in the dictionary")
        starts, at, held, here = [], source.tell(), b"", 0
        for k in range(size):
            if k % READ_ROWS == 0:
                starts.append(at + here)
            end = held.find(b"\0", here)
            while end < 0 or end + _FACTS.size >= len(held):
                more = source.read(_BLOCK)
                if not more:
                    raise InvalidModel("the file is cut off")
                at, held, here = at + here, held[here:] + more, 0
                end = held.find(b"\0")
            if held[end + _FACTS.size] not in (0, 1):
                raise InvalidModel(f"entry of kind {struct.unpack_from('<b', held, end + _FACTS.size)[0]}")
            try:
                held[here:end].decode()
            except UnicodeDecodeError:
                raise InvalidModel("a word isn't UTF-8") from None
            here = end + 1 + _FACTS.size
        source.seek(at + here + 8 * max(pruned, 0))
        return cls(size, READ_ROWS, [*starts, at + here], nwords, nlabels, ntokens, pruned)

    def entries(self, path: str, start: int, end: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(tokens, counts, kinds) of the rows from start, where a range begins, to its end or ``end``."""
        k, n = start // self.every, end - start
        data = _bytes_at(path, self.starts[k], self.starts[k + 1] - self.starts[k]) if n > 0 else b""
        words, facts, here = [], [], 0
        for _ in range(n):
            zero = data.index(b"\0", here)
            words.append(data[here:zero])
            facts.append(_FACTS.unpack_from(data, zero + 1))
            here = zero + 1 + _FACTS.size
        return pa.array(words, pa.binary()).cast(pa.string()), pa.array([c for c, _ in facts], pa.int64()), pa.array([x for _, x in facts], pa.int8())

    def pairs(self, path: str, start: int, end: int) -> tuple[pa.Array, pa.Array]:
        """(bucket, new_id) of rows of the prune table."""
        found = np.frombuffer(_bytes_at(path, self.starts[-1] + 8 * start, 8 * (end - start)), "<i4").reshape(-1, 2).astype(np.int64)
        return pa.array(found[:, 0]), pa.array(found[:, 1])


def _bytes_at(path: str, at: int, n: int) -> bytes:
    files, own = _opened(path)
    with files.open_input_file(own) as source:
        data = source.read_at(n, at)
    if len(data) != n:
        raise InvalidModel("the file is cut off")
    return data


def _read_listed(spark: SparkSession, path: str, rows: int, get: Callable, schema: str) -> DataFrame:
    """The rows of get(path, start, end), an array of row numbers before its columns; a range of READ_ROWS rows a task."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                end = min(start + READ_ROWS, rows)
                own = [pa.array(np.arange(start, end, dtype=np.int32)), *get(path, start, end)]
                yield pa.RecordBatch.from_arrays(own[-len(names) :], names=names)

    return spark.range(0, rows, READ_ROWS, max(1, -(-rows // READ_ROWS))).mapInArrow(run, schema)


def _read_rows(spark: SparkSession, path: str, offset: int, rows: int, width: int, kind: str, row_col: str) -> DataFrame:
    """(row_col, vec | codes) of fixed-length rows, each task reading its own byte ranges."""
    each = width * (4 if kind == "vec" else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, own = _opened(path)
        with files.open_input_file(own) as source:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    n = min(READ_ROWS, rows - start)
                    data = source.read_at(n * each, offset + start * each)
                    if len(data) != n * each:
                        raise InvalidModel("a matrix is cut off")
                    ids = pa.array(np.arange(start, start + n))
                    if kind == "vec":
                        values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.frombuffer(data, "<f4")))
                    else:
                        values = pa.array([data[k * width : (k + 1) * width] for k in range(n)], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids, values], names=[row_col, kind])

    starts = spark.range(0, max(rows, 0), READ_ROWS, max(1, -(-rows // READ_ROWS)))
    return starts.mapInArrow(run, f"{row_col} long, {'vec array<float>' if kind == 'vec' else 'codes binary'}")


def _read_pq(r: _Reader) -> list[np.ndarray]:
    dim, nsubq, dsub, last = r.unpack(struct.Struct("<4i"))
    if len(pieces(dim, dsub)) != nsubq or pieces(dim, dsub)[-1][1] != last:
        raise InvalidModel("sub-vectors don't fit the dimension")
    flat = np.frombuffer(r.take(4 * dim * 256), "<f4")
    out, at = [], 0
    for _, n in pieces(dim, dsub):
        out.append(flat[at : at + 256 * n].reshape(256, n))
        at += 256 * n
    return out


def _read_matrix(spark: SparkSession, r: _Reader, path: str, quantized: bool, row_col: str) -> tuple[DataFrame | Quantized, int]:
    """The matrix that begins here, and its rows; the reader is moved past it."""
    if not quantized:
        m, n = r.unpack(_SHAPE)
        if m < 0 or n < 0:
            raise InvalidModel("negative matrix size")
        at = r.source.tell()
        r.source.seek(at + 4 * m * n)
        return _read_rows(spark, path, at, m, n, "vec", row_col), m
    (qnorm,) = r.unpack(struct.Struct("<?"))
    m, n = r.unpack(_SHAPE)
    (size,) = r.unpack(struct.Struct("<i"))
    at = r.source.tell()
    r.source.seek(at + size)
    books = _read_pq(r)
    if size != m * len(books):
        raise InvalidModel("the codes don't fit the rows")
    codes, norm_book = _read_rows(spark, path, at, m, len(books), "codes", row_col), None
    if qnorm:
        own = r.source.tell()
        r.source.seek(own + m)
        norm_book = _read_pq(r)[0]
        values = norm_book[:, 0].tolist()
        norms = _read_rows(spark, path, own, m, 1, "codes", row_col).select(row_col, F.element_at(F.array(*map(F.lit, values)), F.conv(F.hex("codes"), 16, 10).cast("int") + 1).cast("float").alias("norm"))
        codes = codes.join(norms, row_col)
    return Quantized(codes, books, row_col, norm_book), m


def load_binary(spark: SparkSession, path: str) -> Model | QuantizedModel:
    """The model of a file; broken files raise InvalidModel."""
    files, own = _opened(path)
    with files.open_input_file(own) as source:
        r = _Reader(source)
        magic, version = r.unpack(struct.Struct("<ii"))
        if magic != MAGIC or version > VERSION:
            raise InvalidModel("not a model file of a known version")
        p = unpack_params(r.take(_PARAMS.size))
        if version == OLDEST and p.model == ModelKind.SUPERVISED:
            p = replace(p, maxn=0)
        d = Dictionary.read(source)
        (quant,) = r.unpack(struct.Struct("<?"))
        if d.pruned >= 0 and not quant:
            raise InvalidModel("a plain matrix with a pruned dictionary")
        table, _ = _read_matrix(spark, r, path, quant, "fid")
        (qout,) = r.unpack(struct.Struct("<?"))
        out, n_out = _read_matrix(spark, r, path, quant and qout, "row")
    entries = _read_listed(spark, path, d.rows, d.entries, "id int, token string, count long, entry_type byte")
    prune = _read_listed(spark, path, d.pruned, d.pairs, "bucket long, new_id long") if d.pruned >= 0 else None
    v = Vocabulary(entries, d.nwords, d.nlabels, d.ntokens, replace(p, qout=qout), prune)
    hs = None
    if p.loss == LossKind.HS:
        hs = path_table(spark, entries.where(F.col("entry_type") == (1 if p.model == ModelKind.SUPERVISED else 0)).select("id", "count").toArrow().sort_by("id")["count"].to_numpy())
    dense = lambda x, name: x.dense() if isinstance(x, Quantized) else x  # noqa: E731, ARG005
    model = Model(v.params, v, dense(table, "fid"), dense(out, "row").select(F.col("row").cast("int").alias("row"), "vec"), hs)
    return QuantizedModel(model, table, out if isinstance(out, Quantized) else None) if quant else model


def _write_matrix(sink, table: DataFrame, rows: int, dim: int, key: str) -> None:
    sink.write(_SHAPE.pack(rows, dim))
    n = 0
    for r in table.select(key, "vec").orderBy(key).toLocalIterator():
        sink.write(np.asarray(r[1], "<f4").tobytes())
        n += 1
    if n != rows:
        raise InvalidModel(f"{n} rows instead of {rows}")


def _pack_pq(books: list[np.ndarray]) -> bytes:
    dim, dsub = sum(b.shape[1] for b in books), books[0].shape[1]
    return struct.pack("<4i", dim, len(books), dsub, books[-1].shape[1]) + b"".join(b.astype("<f4").tobytes() for b in books)


def _write_quantized(sink, q: Quantized, dim: int) -> None:
    rows = q.codes.count()
    sink.write(struct.pack("<?", q.norm_book is not None) + _SHAPE.pack(rows, dim) + struct.pack("<i", rows * len(q.books)))
    norms = bytearray()
    for r in q.codes.orderBy(q.row_col).toLocalIterator():
        sink.write(bytes(r["codes"]))
        if q.norm_book is not None:
            norms.append(int(np.abs(q.norm_book[:, 0] - r["norm"]).argmin()))
    sink.write(_pack_pq(q.books))
    if q.norm_book is not None:
        sink.write(bytes(norms) + _pack_pq([q.norm_book]))


def save_binary(model: Model | QuantizedModel, path: str) -> None:
    """Write the model as one file."""
    quantized = model if isinstance(model, QuantizedModel) else None
    m = model.model if quantized else model
    v, p = m.vocabulary, m.params
    files, own = _opened(path)
    with files.open_output_stream(own, compression=None) as sink:
        sink.write(struct.pack("<ii", MAGIC, VERSION) + pack_params(p))
        pairs = [] if v.prune is None else v.prune.orderBy("bucket").collect()
        sink.write(_DICT.pack(v.size, v.nwords, v.nlabels, v.ntokens, -1 if v.prune is None else len(pairs)))
        for e in v.entries.orderBy("id").toLocalIterator():
            sink.write(e["token"].encode() + b"\0" + struct.pack("<qb", e["count"], e["entry_type"]))
        for b in pairs:
            sink.write(struct.pack("<ii", b["bucket"], b["new_id"]))
        sink.write(struct.pack("<?", quantized is not None))
        if quantized:
            _write_quantized(sink, quantized.input, p.dim)
        else:
            _write_matrix(sink, m.input, v.nwords + p.bucket, p.dim, "fid")
        qout = quantized is not None and quantized.output is not None
        sink.write(struct.pack("<?", qout))
        if qout:
            _write_quantized(sink, quantized.output, p.dim)
        else:
            _write_matrix(sink, m.output, m.output.count(), p.dim, "row")


def _save_quantized(q: Quantized, path: str) -> dict:
    """Codes and codebooks as tables; returns what else is needed."""
    spark = q.codes.sparkSession
    q.codes.write.mode("overwrite").parquet(f"{path}/codes")
    rows = [(m, k, c.tolist()) for m, book in enumerate(q.books) for k, c in enumerate(book)]
    if q.norm_book is not None:
        rows += [(-1, k, c.tolist()) for k, c in enumerate(q.norm_book)]
    spark.createDataFrame(rows, "m int, code int, centroid array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
    return {"row_col": q.row_col}


def _load_quantized(spark: SparkSession, path: str, facts: dict) -> Quantized:
    books: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/books").orderBy("m", "code").collect():
        books.setdefault(r.m, []).append(r.centroid)
    made = {m: np.array(b, np.float32) for m, b in books.items()}
    return Quantized(spark.read.parquet(f"{path}/codes"), [made[m] for m in sorted(made) if m >= 0], facts["row_col"], made.get(-1))


def save(model: Model | QuantizedModel, path: str) -> None:
    """The model as a folder of Parquet tables and one of parameters; every table is written by its tasks. Quantized matrices are written as codes."""
    quantized = model if isinstance(model, QuantizedModel) else None
    m = model.model if quantized else model
    spark, v = m.input.sparkSession, m.vocabulary
    facts = {"params": asdict(m.params), "nwords": v.nwords, "nlabels": v.nlabels, "ntokens": v.ntokens, "losses": m.losses, "prune": v.prune is not None, "hs": m.hs is not None}
    for name in ("input", "output"):
        codes = getattr(quantized, name) if quantized else None
        if codes is not None:
            facts[name] = _save_quantized(codes, f"{path}/{name}")
        else:
            getattr(m, name).write.mode("overwrite").parquet(f"{path}/{name}")
    v.entries.write.mode("overwrite").parquet(f"{path}/entries")
    if v.prune is not None:
        v.prune.write.mode("overwrite").parquet(f"{path}/prune")
    if m.hs is not None:
        m.hs.write.mode("overwrite").parquet(f"{path}/paths")
    spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").json(f"{path}/facts")


def load(spark: SparkSession, path: str) -> Model | QuantizedModel:
    facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()[0])
    given = facts["params"]
    p = Params(**{**given, "loss": LossKind(given["loss"]), "model": ModelKind(given["model"])})
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    v = Vocabulary(table("entries"), facts["nwords"], facts["nlabels"], facts["ntokens"], p, table("prune") if facts["prune"] else None)
    codes = {name: _load_quantized(spark, f"{path}/{name}", facts[name]) if name in facts else None for name in ("input", "output")}
    inputs = codes["input"].dense() if codes["input"] else table("input")
    outputs = codes["output"].dense().select(F.col("row").cast("int").alias("row"), "vec") if codes["output"] else table("output")
    model = Model(p, v, inputs, outputs, table("paths") if facts["hs"] else None, tuple(facts["losses"]))
    return QuantizedModel(model, codes["input"], codes["output"]) if codes["input"] else model
