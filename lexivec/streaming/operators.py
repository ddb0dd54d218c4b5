"""Prediction, vocabularies and meters over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import scoring
from ..operators.scoring import Model


def predict_stream(lines: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 1, threshold: float = 0.0) -> StreamingQuery:
    """Each micro-batch of (text) with its predictions goes to sink(batch, number): text, rank, label, prob."""

    def each(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("line_id", F.monotonically_increasing_id()).persist()
        sink(scoring.predict(keyed, model, k, threshold, "line_id").join(keyed.select("line_id", "text"), "line_id").select("text", "rank", "label", "prob"), number)
        keyed.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def count_stream(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Running token counts (token, count), for update or complete mode."""
    return lines.select(F.explode(T.tokens(text_col)).alias("token")).groupBy("token").count()


def window_meter(events: DataFrame, ts_col: str, hit: Column, late: str = "10 minutes", size: str = "10 minutes", slide: str | None = None, session_gap: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, *by, n, hits, precision) in tumbling, sliding or, with session_gap, session windows.

    The same plan runs on a table or on a stream; on a stream rows later than ``late`` are
    dropped and windows come out once they are closed (append mode).
    """
    timed = events.withWatermark(ts_col, late) if events.isStreaming else events
    frame = F.session_window(ts_col, session_gap) if session_gap else F.window(ts_col, size, slide) if slide else F.window(ts_col, size)
    # Spark wants another key beside session windows on a stream; this one is 0 for all rows
    keys = [*by] or ([(F.unix_micros(F.col(ts_col).cast("timestamp")) % 1).alias("_all")] if session_gap and events.isStreaming else [])
    sums = timed.groupBy(frame.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "hits", (F.col("hits") / F.col("n")).alias("precision"))


def test_then_train(lines: DataFrame, model: Model, params, checkpoint: str, on_batch: Callable[[int, float, Model], None]) -> StreamingQuery:
    """Each labelled micro-batch is evaluated by the model so far and then trained on; on_batch gets number, F1 and the new model."""
    from ..operators import search, training

    state = {"model": model}

    def each(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("line_id", F.monotonically_increasing_id()).persist()
        if not keyed.isEmpty():
            value = search.score(state["model"], keyed, id_col="line_id")
            state["model"] = training.train(keyed, params, "line_id", start=state["model"])
            on_batch(number, value, state["model"])
        keyed.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
