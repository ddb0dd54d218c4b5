"""SQL names for the functions: scalars over batches and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators import neighbors, scoring
from ..operators.scoring import Model
from . import text as T
from .held import HeldModel


def register_text(spark: SparkSession) -> None:
    """tv_hash(text), tv_tokens(text) and tv_ngrams(text, minn, maxn) for SQL; per batch, not per row, in Python."""

    @F.pandas_udf("array<string>")
    def tv_tokens(texts):
        return texts.map(lambda t: [w for w in (t or "").translate(_SPACES).split(" ") if w])

    spark.udf.register("tv_hash", T._hash)
    spark.udf.register("tv_tokens", tv_tokens)
    spark.udtf.register("tv_ngrams", _ngrams_table())


_SPACES = str.maketrans("\t\n\f\r", "    ")


def _ngrams_table():
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, gram string")
    class Ngrams:
        def eval(self, word: str, minn: int, maxn: int) -> Iterator[tuple[int, str]]:
            marked, at = f"<{word or ''}>", 0
            for i in range(len(marked)):
                for n in range(max(minn, 1), min(maxn, len(marked) - i) + 1):
                    if n > 1 or 0 < i < len(marked) - 1:
                        yield at, marked[i : i + n]
                        at += 1

    return Ngrams


def register_model(spark: SparkSession, model: Model, name: str = "tv") -> None:
    """Views <name>_labels and <name>_words (token, vec at length 1), and for models that tasks can hold functions for SQL.

    Scalars, a batch at a time: <name>_word_vector(token), of unknown tokens by their
    n-grams; <name>_sentence_vector(text). Table functions, by lateral join: <name>_predict
    (text, k, threshold) gives rank, label, prob; <name>_nn(word, k) gives rank, token,
    sim. Each Python worker holds the model once. They agree with scoring.predict,
    scoring.sentence_vectors and neighbors.nearest; models beyond BROADCAST_NUMBERS or
    BROADCAST_ENTRIES have the views only and are asked by these.
    """
    model.vocabulary.labels().createOrReplaceTempView(f"{name}_labels")
    words = model.vocabulary.words().select("token")
    neighbors.normalized(scoring.word_vectors(words, model), "token", "vec").createOrReplaceTempView(f"{name}_words")
    try:
        held = HeldModel.of(model)
    except InvalidArgument:
        return

    def lists(matrix) -> pa.Array:
        return pa.array(list(matrix), pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def word_vector(tokens: pa.Array) -> pa.Array:
        return lists(held.word_vectors(tokens.to_pylist()))

    @F.arrow_udf("array<double>")
    def sentence_vector(texts: pa.Array) -> pa.Array:
        return lists(held.sentence_vectors(texts.to_pylist()))

    @F.udtf(returnType="rank int, label string, prob double", useArrow=True)
    class Predict:
        def eval(self, text: str, k: int, threshold: float) -> Iterator[tuple[int, str, float]]:
            for rank, (label, prob) in enumerate(held.predict([text], int(k), float(threshold))[0]):
                yield rank, label, prob

    @F.udtf(returnType="rank int, token string, sim double", useArrow=True)
    class Nearest:
        def eval(self, word: str, k: int) -> Iterator[tuple[int, str, float]]:
            for rank, (token, sim) in enumerate(held.nearest(word, int(k))):
                yield rank + 1, token, sim

    spark.udf.register(f"{name}_word_vector", word_vector)
    spark.udf.register(f"{name}_sentence_vector", sentence_vector)
    spark.udtf.register(f"{name}_predict", Predict)
    spark.udtf.register(f"{name}_nn", Nearest)
