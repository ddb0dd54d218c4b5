"""Binary model files as a Spark data source: ``spark.read.format("lexivec")`` and ``write.format("lexivec")``.

Reading takes one table of a file: option ``table`` is ``entries`` (row, token, count,
kind), ``prune`` (bucket, new_id), ``input`` or ``output`` (row, vec; decoded if the matrix is quantized), or
``input_codes`` and ``output_codes`` (row, codes, norm: its code or null). Matrices are read
by ranges of rows, a range a task; filters on ``row`` leave out ranges, and a schema with fewer columns reads
fewer bytes: without vec or codes none at all.

Writing takes the rows of a whole model (``model_rows``), ranged and sorted. Each task
writes the bytes of its rows to a part of its own; the commit puts the parts of the
attempts that succeeded in order, between the headers, and only then is there a file under
its name. A task that fails leaves a part behind that nobody reads, and the commit or the
abort drops the folder of parts.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import InvalidModel
from ..operators.quantization import Quantized, QuantizedModel
from ..operators.scoring import Model
from . import binary

NAME = "lexivec"
_SCHEMAS = {
    "entries": "row long, token string, count long, kind byte",
    "prune": "bucket long, new_id long",
    "input": "row long, vec array<float>",
    "output": "row long, vec array<float>",
    "input_codes": "row long, codes binary, norm int",
    "output_codes": "row long, codes binary, norm int",
}
#: Rows of a whole model: what each is for and its place there.
ROWS = "section int, row long, token string, count long, kind byte, vec array<float>, codes binary"
ENTRY, PRUNE, INPUT, INPUT_NORM, OUTPUT, OUTPUT_NORM = range(6)


@dataclass
class Matrix:
    """Where a matrix is in its file: rows of ``width`` numbers or codes from ``at`` on."""

    rows: int
    width: int
    at: int
    books: list[np.ndarray] | None = None
    norms_at: int = -1
    norm_book: np.ndarray | None = None

    @classmethod
    def read(cls, r: binary._Reader, quantized: bool) -> Matrix:
        if not quantized:
            rows, dim = r.unpack(binary._SHAPE)
            out = cls(rows, dim, r.source.tell())
            r.source.seek(out.at + 4 * rows * dim)
            return out
        (qnorm,) = r.unpack(struct.Struct("<?"))
        rows, _ = r.unpack(binary._SHAPE)
        (size,) = r.unpack(struct.Struct("<i"))
        at = r.source.tell()
        r.source.seek(at + size)
        books = binary._read_pq(r)
        out = cls(rows, len(books), at, books)
        if size != rows * len(books):
            raise InvalidModel("the codes don't fit the rows")
        if qnorm:
            out.norms_at = r.source.tell()
            r.source.seek(out.norms_at + rows)
            out.norm_book = binary._read_pq(r)[0]
        return out


@dataclass
class Rows(InputPartition):
    start: int
    end: int


class ModelReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.names = path, table, schema.names
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.first, self.last = 0, 2**62
        files, own = binary._opened(path)
        with files.open_input_file(own) as source:
            r = binary._Reader(source)
            magic, version = r.unpack(struct.Struct("<ii"))
            if magic != binary.MAGIC or version > binary.VERSION:
                raise InvalidModel("not a model file of a known version")
            r.take(binary._PARAMS.size)
            self.dictionary = binary.Dictionary.read(source)
            (quant,) = r.unpack(struct.Struct("<?"))
            inputs = Matrix.read(r, quant)
            (qout,) = r.unpack(struct.Struct("<?"))
            outputs = Matrix.read(r, quant and qout)
        self.matrix = inputs if table.startswith("input") else outputs
        if table.endswith("_codes") and self.matrix.books is None:
            raise InvalidModel(f"{table}: the matrix isn't quantized")
        self.listed = table in ("entries", "prune")
        self.rows = {"entries": self.dictionary.rows, "prune": max(self.dictionary.pruned, 0)}.get(table, self.matrix.rows)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of ``row`` are taken; filters are also returned, as a range may have more rows than wanted."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("row",) and not self.listed and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                value = int(f.value)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(self.last, value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[InputPartition]:
        ends = range(self.first, min(self.last + 1, self.rows), binary.READ_ROWS)
        return [Rows(k, min(k + binary.READ_ROWS, self.last + 1, self.rows)) for k in ends] or [Rows(0, 0)]

    def _listed(self, partition: Rows) -> pa.RecordBatch:
        """Rows of the dictionary or of the prune table, from their own bytes."""
        d, a, b = self.dictionary, partition.start, partition.end
        columns = dict(zip(("bucket", "new_id"), d.pairs(self.path, a, b), strict=True)) if self.table == "prune" else dict(zip(("row", "token", "count", "kind"), (pa.array(np.arange(a, b)), *d.entries(self.path, a, b)), strict=True))
        return pa.RecordBatch.from_arrays([columns[name] for name in self.names], names=self.names)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if self.listed:
            yield self._listed(partition)
            return
        m, a, n = self.matrix, partition.start, partition.end - partition.start
        columns = {"row": lambda: pa.array(np.arange(a, a + n))}
        files, own = binary._opened(self.path)

        def bytes_of(at: int, each: int) -> bytes:
            with files.open_input_file(own) as source:
                data = source.read_at(n * each, at + a * each)
            if len(data) != n * each:
                raise InvalidModel("a matrix is cut off")
            return data

        def codes() -> np.ndarray:
            return np.frombuffer(bytes_of(m.at, m.width), np.uint8).reshape(n, m.width)

        def norms() -> np.ndarray:
            return np.frombuffer(bytes_of(m.norms_at, 1), np.uint8)

        def vectors() -> pa.Array:
            if m.books is None:
                dim, flat = m.width, np.frombuffer(bytes_of(m.at, 4 * m.width), "<f4")
            else:
                c = codes()
                made = np.concatenate([b[c[:, k]] for k, b in enumerate(m.books)], axis=1)
                if m.norm_book is not None:
                    made = made * m.norm_book[norms(), 0][:, None]
                dim, flat = made.shape[1], made.ravel()
            return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(flat.astype(np.float32)))

        columns |= {"vec": vectors, "codes": lambda: pa.array([c.tobytes() for c in codes()], pa.binary()), "norm": lambda: pa.array(norms().astype(np.int32)) if m.norm_book is not None else pa.nulls(n, pa.int32())}
        yield pa.RecordBatch.from_arrays([columns[name]() for name in self.names], names=self.names)


@dataclass
class Part(WriterCommitMessage):
    """A part's name and, section by section, the first row, rows and bytes."""

    name: str
    sections: list[tuple[int, int, int, int]]


class ModelWriter(DataSourceArrowWriter):
    def __init__(self, path: str, facts: dict):
        self.path, self.facts, self.parts = path, facts, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, own = binary._opened(self.parts)
        name, sections = f"{own}/{uuid.uuid4().hex}", []
        files.create_dir(own)
        with files.open_output_stream(name, compression=None) as sink:
            for batch in iterator:
                for r in batch.to_pylist():
                    data = _packed(r)
                    sink.write(data)
                    if not sections or sections[-1][0] != r["section"]:
                        sections.append((r["section"], r["row"], 0, 0))
                    section, first, rows, size = sections[-1]
                    sections[-1] = (section, first, rows + 1, size + len(data))
        return Part(name, sections)

    def commit(self, messages: list[Part | None]) -> None:
        found = sorted((section, first, rows, size, part.name, sum(s[3] for s in part.sections[:k])) for part in messages if part is not None for k, (section, first, rows, size) in enumerate(part.sections))
        facts = self.facts
        rows = {k: sum(x[2] for x in found if x[0] == k) for k in range(6)}
        files, own = binary._opened(self.path)
        made = f"{own}.made-{uuid.uuid4().hex}"

        def section(sink, k: int) -> None:
            for _, _, _, size, name, at in (x for x in found if x[0] == k):
                with files.open_input_file(name) as source:
                    source.seek(at)
                    while size:
                        data = source.read(min(size, binary._BLOCK))
                        if not data:
                            raise InvalidModel(f"{name} is cut off")
                        sink.write(data)
                        size -= len(data)

        def matrix(sink, k: int, name: str) -> None:
            shape = binary._SHAPE.pack(rows[k], facts["dim"])
            if name not in facts:
                sink.write(shape)
                section(sink, k)
                return
            books, norm_book = facts[name]
            sink.write(struct.pack("<?", norm_book is not None) + shape + struct.pack("<i", rows[k] * len(books)))
            section(sink, k)
            sink.write(binary._pack_pq(_books(books)))
            if norm_book is not None:
                section(sink, k + 1)
                sink.write(binary._pack_pq(_books([norm_book])))

        with files.open_output_stream(made, compression=None) as sink:
            sink.write(struct.pack("<ii", binary.MAGIC, binary.VERSION) + base64.b64decode(facts["params"]))
            sink.write(binary._DICT.pack(rows[ENTRY], facts["nwords"], facts["nlabels"], facts["ntokens"], rows[PRUNE] if facts["pruned"] else -1))
            section(sink, ENTRY)
            section(sink, PRUNE)
            sink.write(struct.pack("<?", "input" in facts))
            matrix(sink, INPUT, "input")
            sink.write(struct.pack("<?", "output" in facts))
            matrix(sink, OUTPUT, "output")
        files.move(made, own)
        self._drop()

    def abort(self, messages: list[Part | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        files, own = binary._opened(self.parts)
        if files.get_file_info(own).type == FileType.Directory:
            files.delete_dir(own)


def _packed(r: dict) -> bytes:
    section = r["section"]
    if section == ENTRY:
        return r["token"].encode() + b"\0" + binary._FACTS.pack(r["count"], r["kind"])
    if section == PRUNE:
        return struct.pack("<ii", r["row"], r["count"])
    return r["codes"] if r["codes"] is not None else np.asarray(r["vec"], "<f4").tobytes()


def _books(given: list) -> list[np.ndarray]:
    return [np.array(b, np.float32) for b in given]


class ModelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "input")
        if table not in _SCHEMAS:
            raise InvalidModel(f"no table {table!r}: {', '.join(_SCHEMAS)}")
        return table

    def schema(self) -> str:
        return _SCHEMAS[self._table()]

    def reader(self, schema: StructType) -> ModelReader:
        return ModelReader(self.options["path"], self._table(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ModelWriter:
        return ModelWriter(self.options["path"], json.loads(self.options["facts"]))


def register(spark: SparkSession) -> None:
    """Make the format known to a session; filters go down to its readers, which Spark has to be told."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ModelSource)


def model_rows(model: Model | QuantizedModel) -> DataFrame:
    """All rows of a model, as the writer wants them."""
    quantized = model if isinstance(model, QuantizedModel) else None
    m = model.model if quantized else model
    none = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(ROWS).fields}
    said = lambda df, section, **own: df.select(*(x.alias(name) for name, x in (none | {"section": F.lit(section)} | own).items()))
    out = said(m.vocabulary.entries, ENTRY, row=F.col("id").cast("long"), token=F.col("token"), count=F.col("count").cast("long"), kind=F.col("entry_type").cast("byte"))
    if m.vocabulary.prune is not None:
        out = out.unionByName(said(m.vocabulary.prune, PRUNE, row=F.col("bucket").cast("long"), count=F.col("new_id").cast("long")))
    for section, name, key, table in ((INPUT, "input", "fid", m.input), (OUTPUT, "output", "row", m.output)):
        q: Quantized | None = getattr(quantized, name) if quantized else None
        if q is None:
            out = out.unionByName(said(table, section, row=F.col(key).cast("long"), vec=F.col("vec").cast("array<float>")))
            continue
        out = out.unionByName(said(q.codes, section, row=F.col(q.row_col).cast("long"), codes=F.col("codes")))
        if q.norm_book is not None:
            values = q.norm_book[:, 0].tolist()
            nearest = F.array_min(F.transform(F.array(*(F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for k, v in enumerate(values))), lambda x: F.struct(F.abs(F.col("norm") - x["v"]).alias("d"), x["k"].alias("k"))))["k"]
            out = out.unionByName(said(q.codes, section + 1, row=F.col(q.row_col).cast("long"), codes=F.unhex(F.lpad(F.hex(nearest), 2, "0"))))
    return out


def write_model(model: Model | QuantizedModel, path: str) -> None:
    """Write a model as one binary file, its bytes made by tasks; an existing file is replaced when the new one is whole."""
    quantized = model if isinstance(model, QuantizedModel) else None
    m = model.model if quantized else model
    v, p, spark = m.vocabulary, m.params, m.input.sparkSession
    facts = {"params": base64.b64encode(binary.pack_params(p)).decode(), "dim": p.dim, "nwords": v.nwords, "nlabels": v.nlabels, "ntokens": v.ntokens, "pruned": v.prune is not None}
    for name in ("input", "output"):
        if quantized and (q := getattr(quantized, name)) is not None:
            facts[name] = ([b.tolist() for b in q.books], None if q.norm_book is None else q.norm_book.tolist())
    register(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = model_rows(model).repartitionByRange(parts, "section", "row").sortWithinPartitions("section", "row")
    rows.write.format(NAME).option("facts", json.dumps(facts)).mode("append").save(path)


__all__ = ["ModelSource", "model_rows", "register", "write_model"]
