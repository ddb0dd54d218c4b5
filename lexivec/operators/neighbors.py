"""Nearest neighbours and analogies by cosine, exactly, over all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..storage import cut

#: Queries compared in one pass; the vectors of a pass are one row on every executor.
QUERY_BLOCK = 1024
#: Centres of blocks for many queries, at most; rows of a block, and queries, that one task multiplies.
CENTRES, BLOCK_ROWS, BLOCK_QUERIES = 512, 16_384, 4096
#: What rounding may add to a similarity.
SLACK = 1e-9


def normalized(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id_col, vec) at length 1; vectors shorter than 1e-8 stay as they are."""
    return table.select(id_col, V.l2_normalize(F.col(vec_col)).alias("vec"))


def nearest(queries: DataFrame, table: DataFrame, k: int, id_col: str = "id", n_queries: int | None = None) -> DataFrame:
    """(query, id_col, sim, rank): the k rows of the table most like each query, ties by id.

    queries: (query, vec, banned array of ids); table: (id_col, vec); vectors are
    normalised. Queries are put in blocks; each row of the table meets each block once,
    and every task keeps only its k best for a query before the shuffle. More than
    QUERY_BLOCK queries of a table whose ids are whole numbers go by nearest_by_blocks,
    which finds the same without making all pairs.
    """
    n = queries.count() if n_queries is None else n_queries
    if n > QUERY_BLOCK and dict(table.dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint"):
        return nearest_by_blocks(queries, table, k, id_col)
    blocks = max(1, -(-n // QUERY_BLOCK))
    dealt = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("query", "vec", "banned")).alias("qs"))
    own = table.select(id_col, "vec").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a block holds about QUERY_BLOCK vectors; beyond 64 blocks they are joined by shuffle
    met = own.join(F.broadcast(dealt) if blocks <= 64 else dealt, "block")
    scored = met.select(id_col, F.explode(F.transform("qs", lambda q: F.struct(q["query"].alias("query"), F.array_contains(q["banned"], F.col(id_col)).alias("ban"), V.dot(q["vec"], F.col("vec")).alias("sim")))).alias("s"))
    live = scored.where(~F.col("s.ban") & ~F.isnan("s.sim")).select("s.query", id_col, "s.sim")
    return _ranked(live, k, id_col)


def _ranked(live: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("sim").desc(), F.col(id_col))
    return live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _nearest_centre(centres: np.ndarray):
    """Rows with ``centre`` (the number of the nearest) and ``turn`` (the angle to it) of rows (key, vec); vectors are normalised or zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sim = _matrix(part.column(1)) @ centres.T
                best = sim.argmax(axis=1)
                turn = np.arccos(np.clip(sim[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best.astype(np.int32)), pa.array(turn)], names=["key", "vec", "centre", "turn"])

    return run


def _best_of_block(k: int):
    """(key, id, sim) of the k best rows of a block for each of its queries."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, out = rows["key"].to_numpy(), []
        order = np.argsort(ids)
        ids, matrix = ids[order], _matrix(rows["vec"])[order] if rows.num_rows else np.zeros((0, 1))
        vectors, banned, keys = _matrix(asked["vec"]) if asked.num_rows else np.zeros((0, 1)), asked["banned"].to_pylist(), asked["key"].to_pylist()
        for a in range(0, len(keys) if len(ids) else 0, 256):
            sim = vectors[a : a + 256] @ matrix.T
            for i, own in enumerate(sim):
                out_of = np.searchsorted(ids, banned[a + i] or [])
                own[out_of[(out_of < len(ids)) & np.isin(ids[np.minimum(out_of, len(ids) - 1)], banned[a + i] or [])]] = np.nan
                live = np.flatnonzero(~np.isnan(own))
                if len(live) > k:
                    least = np.partition(own[live], len(live) - k)[len(live) - k]
                    live = live[own[live] >= least]
                best = live[np.lexsort((ids[live], -own[live]))][:k]
                out += [(keys[a + i], int(ids[j]), float(own[j])) for j in best]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["key", "id", "sim"])

    return run


def nearest_by_blocks(queries: DataFrame, table: DataFrame, k: int, id_col: str = "id", seen: list | None = None) -> DataFrame:
    """(query, id_col, sim, rank) as nearest() has them, exactly, for many queries; ids are numbers.

    Rows are put in blocks by the nearest of at most CENTRES of them; large blocks are cut.
    A query is first compared with its own block, which gives the least that its k-th best
    can be. A row is at most as near as the angle to its block's centre, less the block's
    greatest angle, allows, so only blocks that may reach that are looked at. All products
    are of whole blocks, and each task keeps k rows a query. seen: gets (pairs of query and
    block looked at, all pairs).
    """
    held = table.select(F.col(id_col).cast("long").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    some = held.orderBy(F.xxhash64("key")).limit(CENTRES).toArrow()  # a bounded sample; any choice gives the same rows
    asked = cut(queries.select("query", F.col("vec").cast("array<double>").alias("vec"), F.col("banned").cast("array<bigint>").alias("banned")).withColumn("key", F.monotonically_increasing_id()))
    empty = asked.sparkSession.createDataFrame([], f"query {asked.schema['query'].dataType.simpleString()}, {id_col} {dict(table.dtypes)[id_col]}, sim double, rank int")
    if not some.num_rows or k <= 0:
        return empty
    centres = _matrix(some["vec"])
    fields = "key long, vec array<double>, centre int, turn double"
    placed = cut(held.mapInArrow(_nearest_centre(centres), fields))
    sizes = placed.groupBy("centre").agg(F.count("*").alias("n"), F.max("turn").alias("radius"))
    blocks = sizes.withColumn("cuts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    radius = np.full(len(centres), -1.0)
    cuts = np.zeros(len(centres), np.int64)
    for r in blocks.collect():  # at most CENTRES rows
        radius[r.centre], cuts[r.centre] = r.radius, r.cuts
    rows = placed.join(F.broadcast(blocks.select("centre", "cuts")), "centre").select("key", "vec", "centre", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int").alias("cut"))

    def ask(wanted: DataFrame) -> DataFrame:
        """(key, id, sim) of queries (key, vec, banned, centre, cut), queries of a block cut too."""
        counts = wanted.groupBy("centre", "cut").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("tasks"))
        few = F.broadcast(counts) if int(cuts.sum()) <= 100_000 else counts  # a row a block
        dealt = wanted.join(few, ["centre", "cut"]).withColumn("task", F.pmod(F.xxhash64("key"), F.col("tasks")).cast("int"))
        spread = rows.join(few, ["centre", "cut"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        group = ["centre", "cut", "task"]
        return dealt.select(*group, "key", "vec", "banned").groupBy(*group).cogroup(spread.select(*group, "key", "vec").groupBy(*group)).applyInArrow(_best_of_block(k), "key long, id long, sim double")

    own = asked.select("key", "vec").mapInArrow(_nearest_centre(np.where(radius[:, None] >= 0, centres, 0)), fields)
    home = cut(asked.join(own.select("key", "centre"), "key").withColumn("cut", F.lit(0)))
    near = cut(ask(home.select("key", "vec", "banned", "centre", "cut")))
    kth = near.groupBy("key").agg(F.count("*").alias("n"), F.min("sim").alias("least"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, centre, cut) of the blocks that may have a better row."""
        all_blocks = [(c, j) for c in range(len(cuts)) for j in range(cuts[c])]
        which, part = np.array([c for c, _ in all_blocks]), np.array([j for _, j in all_blocks])
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                turn = np.arccos(np.clip(_matrix(some.column(1)) @ centres.T, -1, 1))
                most = np.cos(np.maximum(turn - radius[None], 0))[:, which]
                least = some.column(3).fill_null(-2.0).to_numpy(zero_copy_only=False)
                home_at = some.column(2).to_numpy(zero_copy_only=False)
                i, b = np.nonzero((most >= least[:, None] - SLACK) & ~((which[None] == home_at[:, None]) & (part[None] == 0)))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(i)), pa.array(which[b].astype(np.int32)), pa.array(part[b].astype(np.int32))], names=["key", "centre", "cut"])

    bounds = home.join(kth, "key", "left").select("key", "vec", "centre", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    more = cut(bounds.mapInArrow(others, "key long, centre int, cut int"))
    if seen is not None:
        seen.append((more.count() + home.count(), home.count() * int(cuts.sum())))
    far = ask(more.join(asked.select("key", "vec", "banned"), "key"))
    found = _ranked(near.unionByName(far).withColumnRenamed("key", "query"), k, "id").withColumnRenamed("query", "key")
    kind = dict(table.dtypes)[id_col]
    return found.join(asked.select("key", "query"), "key").select("query", F.col("id").cast(kind).alias(id_col), "sim", "rank")


def analogy_queries(triples: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """(query, vec, banned) of triples (query, a, b, c): n(a) - n(b) + n(c), which bans all three; normalised."""
    side = lambda name: table.select(F.col(id_col).alias(name), F.col("vec").alias(f"v_{name}"))
    joined = triples.join(side("a"), "a").join(side("b"), "b").join(side("c"), "c")
    mixed = V.add(V.add(F.col("v_a"), F.col("v_b"), -1.0), F.col("v_c"))
    return joined.select("query", V.l2_normalize(mixed).alias("vec"), F.array("a", "b", "c").alias("banned"))
