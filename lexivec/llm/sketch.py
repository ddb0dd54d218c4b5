"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions.

A sketch holds every five-word shingle hash (xxhash64, read as unsigned) below 2 ** 64 /
SCALE, sorted, without repeats, and nothing else. Sketches of parts merge by union, and
since the limit doesn't depend on the text, the share of one sketch found in another
estimates containment however unequal the texts are. Very short texts may have an empty
sketch; they are alike only if they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

WORDS = 5
SCALE = 4
#: Documents in one stretch of neighbours at most, where ids and texts tell them apart.
STRETCH = 8192
#: Crowded beginnings of ids that are told to all tasks (50 bytes each) are at most about 16 times this many; larger tables get longer stretches.
CROWDED = 200_000
#: Digits of the order that are counted in one pass.
DIGITS = 4


def let(value: Column, use) -> Column:
    """use(value), with value made once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted array<bigint> of the text's hashes below the limit; null and wordless texts give an empty one."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        shingles = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
        return F.when(n >= words, shingles).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    def low(h: Column) -> Column:
        return F.sort_array(F.array_distinct(F.filter(h, lambda x: (x >= 0) & (x < 2**64 // scale))))

    return let(let(split, hashes), low)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two parts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def likeness(a: Column, b: Column, equal: Column | None = None) -> Column:
    """Estimated Jaccard similarity, 0 to 1; of two empty sketches 1 if the texts are ``equal`` (or that isn't given), else 0."""
    common = F.size(F.array_intersect(a, b))
    none = F.lit(1.0) if equal is None else equal.cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), none).otherwise(common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)))


def as_text(s: Column) -> Column:
    """16 hex digits a hash, one after the other."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def place(id_: Column, text: Column) -> Column:
    """33 digits that order rows by id and then by a hash of the text; null ids come first."""
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.when(id_.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), digits(id_))), digits(F.xxhash64(text)))


def crowded(places: DataFrame, stretch: int = STRETCH) -> list[tuple[int, DataFrame]]:
    """(length, beginnings of that length) of places that more than ``stretch`` rows begin with, from the beginning common to all on.

    One pass over the places for each DIGITS digits that crowded beginnings reach into,
    which for ids that are evenly dense is one. Counts are made in each task first.
    """
    lo, hi, n = places.agg(F.min("place"), F.max("place"), F.count("*")).first()
    stretch = max(stretch, n // CROWDED)
    if n <= stretch:
        return []
    at = next((k for k in range(len(lo)) if lo[k] != hi[k]), len(lo))
    found = [(at, places.sparkSession.createDataFrame([(lo[:at],)], "begins string"))]
    while at < len(lo):
        inside = places.join(F.broadcast(found[-1][1]), F.substring("place", 1, at) == F.col("begins"), "left_semi")
        fine = cut(inside.groupBy(F.substring("place", 1, at + DIGITS).alias("begins")).agg(F.count("*").alias("n")))
        for k in range(at + 1, min(at + DIGITS, len(lo)) + 1):
            some = cut(fine.groupBy(F.substring("begins", 1, k).alias("begins")).agg(F.sum("n").alias("n")).where(F.col("n") > stretch).select("begins"))
            if some.isEmpty():
                return found
            found.append((k, some))
        at += DIGITS
    return found


def with_stretch(rows: DataFrame, crowds: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows (place, ..) with ``stretch``: the shortest beginning of the place that isn't crowded, and ``coarse``, its first digits."""
    if not crowds:
        return rows.withColumns({"stretch": F.lit(""), "coarse": F.lit("")})
    length = F.lit(crowds[0][0] + 1)
    for k, some in crowds[1:]:
        rows = rows.join(F.broadcast(some.select(F.col("begins").alias("_b"), F.lit(1).alias("_in"))), F.substring("place", 1, k) == F.col("_b"), "left").withColumn(f"_c{k}", F.coalesce("_in", F.lit(0))).drop("_b", "_in")
        length = length + F.col(f"_c{k}")
    stretch = F.substring(F.col("place"), F.lit(1), length)
    out = rows.withColumn("stretch", stretch).withColumn("coarse", F.substring("stretch", 1, crowds[0][0] + DIGITS))
    return out.drop(*(f"_c{k}" for k, _ in crowds[1:]))


def heads(rows: DataFrame) -> DataFrame:
    """(place, before): the largest place of each stretch, and the stretch of larger places that comes before; the largest is before the smallest.

    rows: (place, stretch, coarse). Stretches are ordered within each coarse one, and
    then the coarse ones, which are at most 16 ** DIGITS.
    """
    own = rows.groupBy("coarse", "stretch").agg(F.max("place").alias("place"))
    inner = Window.partitionBy("coarse").orderBy(F.col("place").desc())
    each = cut(own.withColumn("next", F.lead("place").over(inner)))
    ends = each.groupBy("coarse").agg(F.max("place").alias("head"))
    outer = Window.orderBy(F.col("head").desc())
    every = outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select("coarse", F.coalesce(F.lead("head").over(outer), F.first("head").over(every)).alias("after"))
    return each.join(F.broadcast(after), "coarse").select(F.coalesce("next", "after").alias("place"), F.col("stretch").alias("before"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch), a row for each row of docs.

    The next document is the one with the next smaller id; after the smallest comes the
    largest. Null ids come after the smallest; rows of the same id follow by hash of their
    text, falling. Null texts count as empty; a single row is its own next; an empty table
    gives an empty one. Any ids will do, dense, far apart, clustered or hashes.

    Rows are put in stretches of neighbours: the order's digits are counted, and each
    stretch is a beginning that few rows share, so a range of ids that holds most rows
    is cut finer. The first row of a stretch is also copied to the end of the one before,
    so texts move once. Only rows that repeat both id and text can't be told apart; their
    stretch is sorted by one task, which spills.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = ids.withColumn("place", place(F.col("id"), F.col("text")))
    places = cut(keyed.select("place"))
    crowds = crowded(places, stretch)
    first = heads(with_stretch(places, crowds)).withColumnRenamed("place", "_head")
    # a head for each stretch, which are at most 16 for each crowded beginning
    copied = with_stretch(keyed, crowds).join(F.broadcast(first), F.col("place") == F.col("_head"), "left").drop("_head", "coarse")
    own = F.struct(F.lit(0).alias("copy"), F.col("stretch").alias("at"))
    also = F.struct(F.lit(1).alias("copy"), F.col("before").alias("at"))
    dealt = (
        copied.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))))
        .select("id", "text", "place", F.col("to.copy").alias("copy"), F.col("to.at").alias("at"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "at")
    )
    row = Window.partitionBy("at").orderBy("copy", F.col("place").desc())
    return (
        dealt.withColumn("sketch", sketch(F.col("text")))
        .withColumn("next", F.lead(F.struct("text", "sketch")).over(row))
        .where("copy = 0")
        .select("id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))
    )


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """with_next() plus the edited text and its sketch: the last third replaced by the next document's beginning."""
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next_text", F.lit(1), third))
    return with_next(docs, id_col, text_col).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
