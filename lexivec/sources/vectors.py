"""Word vectors as text: a header "n dim", then a word and its numbers a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators import scoring
from ..operators.scoring import Model


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(token, vec) of a vector file; a header of another size, lines of another length or fewer lines than said raise."""
    lines = spark.read.text(path)
    header = lines.first()
    said = (header[0] if header else "").split()
    if len(said) != 2 or not all(x.isdigit() for x in said) or int(said[1]) != dim:
        raise InvalidArgument(f"{path}: the header must be a count and {dim}")
    fields = F.filter(F.split(F.trim("value"), r"[ \t]+"), lambda x: x != "")
    rows = lines.where((F.col("value") != header[0]) & (F.trim("value") != "")).select(fields.alias("f"))
    right = F.size("f") == dim + 1
    checked = rows.select(F.when(right, F.col("f")).otherwise(F.raise_error(F.lit(f"{path}: a line has not {dim} numbers"))).alias("f"))
    if rows.count() < int(said[0]):
        raise InvalidArgument(f"{path}: fewer than {said[0]} vectors")
    return checked.select(F.get("f", F.lit(0)).alias("token"), F.transform(F.slice("f", 2, dim), lambda x: x.cast("float")).alias("vec"))


def write_vectors(model: Model, path: str) -> None:
    """The vectors of all words, in order of their ids, under path; the first line of the first file is the header."""
    words = model.vocabulary.words().select("id", "token")
    own = scoring.word_vectors(words.select("token"), model).join(words, "token")
    body = own.select("id", F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: F.format_string("%.6g", x)), " ")).alias("value"))
    head = model.input.sparkSession.createDataFrame([(-1, f"{model.vocabulary.nwords} {model.params.dim}")], "id int, value string")
    head.unionByName(body).orderBy("id").select("value").write.mode("overwrite").text(path)
