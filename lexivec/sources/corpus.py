"""Text corpora in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators.quantization import QuantizedModel
from ..operators.scoring import Model


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, text): one row a line of the files; ids grow with files and lines but have gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("text"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files that come into a folder, as a stream (text)."""
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def format_number(value: float, digits: int = 6) -> str:
    """As "%.{digits}g": no trailing zeros, exponents where they are shorter."""
    return format(value, f".{digits}g")


def dump(model: Model | QuantizedModel, what: str) -> DataFrame:
    """Lines (text) of the model's "args", "dict", "input" or "output"; quantized matrices can't be dumped."""
    own = model.model if isinstance(model, QuantizedModel) else model
    if what == "args":
        spark = own.input.sparkSession
        return spark.createDataFrame([(f"{k} {v}",) for k, v in own.params.as_rows()], "text string")
    if what == "dict":
        kind = F.when(F.col("entry_type") == 0, "word").otherwise("label")
        return own.vocabulary.entries.orderBy("id").select(F.concat_ws(" ", "token", F.col("count").cast("string"), kind).alias("text"))
    if what not in ("input", "output"):
        raise InvalidArgument(f"no part {what!r}")
    if isinstance(model, QuantizedModel) and (what == "input" or model.output is not None):
        raise InvalidArgument("a quantized matrix can't be dumped")
    table, key = (own.input, "fid") if what == "input" else (own.output, "row")
    return table.orderBy(key).select(F.array_join(F.transform("vec", lambda x: F.format_string("%.5g", x.cast("double"))), " ").alias("text"))
