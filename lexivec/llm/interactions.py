"""How filters of documents interact: what each removes alone, after others, and on average.

Five filters give 32 subsets; how many documents survive each subset, in each part of the
corpus, says all there is to know of every order in which the filters can be applied.
Texts are read once, into failure flags; rows are added up to cells of equal flags, and a
CUBE over the flags and the part gives the subsets: a grouping set keeps some flags, and
its row with all of these false counts the survivors of these filters. Each step of an
order is then a pair of subsets, before and after.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Marks that text of filter D doesn't hold.
MARKS = r"[#$%&*|]"


@dataclass(frozen=True)
class Limits:
    least_words: int = 100
    #: Least share of different words, and greatest share of capital letters, in hundredths.
    least_distinct: int = 80
    most_capitals: int = 10


PRODUCTION = Limits()
FILTERS = "ABCDE"


def text_flags(text: Column, limits: Limits = PRODUCTION) -> dict[str, Column]:
    """Whether a text (not null) fails by too few words, repeated words, capitals or marks."""
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    return {
        "A": F.size(words) < limits.least_words,
        "B": 100 * F.size(F.array_distinct(words)) < limits.least_distinct * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > limits.most_capitals * F.length(text),
        "D": F.regexp_count(text, F.lit(MARKS)) > 0,
    }


def cells(docs: DataFrame, labels: DataFrame, limits: Limits = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): documents of equal flags and labels, added up.

    Null texts and parts count as empty. Each row is a document; one fails E if a smaller
    id has the same text. Rows without an id, and those that repeat the smallest id of
    their text, don't fail E. Labels are looked up by id: one good row makes a document
    good, one toxic row makes it toxic, and without rows it is neither.

    Only the text's digest goes into the shuffle. Copies are added up in the tasks that
    have them and again by digest, so a group of copies of any size ends as a few rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flags = text_flags(text, limits)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *(c.alias(name) for name, c in flags.items()),
    )
    own = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.join(own, "id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    keys = ["digest", "part", *flags, "good", "toxic"]
    each = marked.groupBy("id", *keys).agg(F.count("*").alias("n"))
    known = F.when(F.col("id").isNotNull(), F.col("n"))
    alike = cut(each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(known).alias("n_known"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")))
    smallest = alike.groupBy("digest").agg(F.min("first.id").alias("smallest"))
    late = F.coalesce("n_known", F.lit(0)) - F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = alike.join(smallest, "digest").withColumn("late", late)
    halves = F.inline(F.array(F.struct(F.lit(False).alias("E"), (F.col("n") - F.col("late")).alias("k")), F.struct(F.lit(True).alias("E"), F.col("late").alias("k"))))
    names = ["part", *FILTERS, "good", "toxic"]
    return split.select("part", *flags, "good", "toxic", halves).where("k > 0").groupBy(*names).agg(F.sum("k").alias("n"))


def survivors(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic) of every part and every subset of the filters (bit k: filter k), zeros too."""
    bit = lambda f: F.lit(1 << filters.index(f))
    cube = cells.cube(*filters, "part").agg(
        *(F.grouping(f).alias(f"_{f}") for f in filters),
        F.grouping("part").alias("_part"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    passed = F.col("_part") == 0
    subset = F.lit(0)
    for f in filters:
        passed &= (F.col(f"_{f}") == 1) | ~F.col(f)
        subset = subset + F.when(F.col(f"_{f}") == 0, bit(f)).otherwise(0)
    found = cut(cube.where(passed).select("part", subset.alias("subset"), "n", "good", "toxic"))
    every = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters.

    kept: after this step; removed: by it; redundant: fail its filter, but are removed
    before; unique_fails: fail its filter only; good_lost and toxic_lost: good and toxic
    ones removed by it; shapley: what its filter removes in all orders together.
    An empty table has no parts and gives no rows.
    """
    spark, n, everything = cells.sparkSession, len(filters), (1 << len(filters)) - 1
    held = cut(survivors(cells, filters))
    times = [factorial(k) * factorial(n - 1 - k) for k in range(n)]
    steps = spark.createDataFrame([(s, s | 1 << f, filters[f], times[s.bit_count()]) for f in range(n) for s in range(everything + 1) if not s >> f & 1], "before int, after int, filter string, times long")
    before = held.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")))
    after = held.select("part", F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_after") for c in ("n", "good", "toxic")))
    lost = lambda c: F.col(f"{c}_before") - F.col(f"{c}_after")
    pairs = cut(
        F.broadcast(steps)  # 80 rows for five filters
        .join(before, "before")
        .join(after, ["part", "after"])
        .select("part", "before", "after", "filter", "times", F.col("n_after").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    )
    only = lambda when: F.sum(F.when(when, F.col("removed")))
    whole = pairs.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"), only(F.col("before") == 0).alias("fails"), only(F.col("after") == everything).alias("unique_fails"))
    orders = []
    for order in permutations(range(n)):
        seen = 0
        for k, f in enumerate(order):
            orders.append(("".join(filters[x] for x in order), k + 1, seen, seen | 1 << f))
            seen |= 1 << f
    told = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, before int, after int"))  # 600 rows for five filters
    return (
        pairs.join(whole, ["part", "filter"])
        .join(told, ["before", "after"])
        .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


#: Each order is applied to the cells filter by filter, without subsets or pairs.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), w.doc_id > min(w.doc_id) OVER (PARTITION BY text)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ord
  FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, step, ord[step] AS f, ord[1:step - 1] AS earlier FROM o, range(1, 6) t(step)),
x AS (
  SELECT part, ord, step, f, n, good, toxic, fails[f] AS failing,
         list_bool_or(list_transform(earlier, lambda i: fails[i])) IS TRUE AS gone,
         len(list_filter(fails, lambda b: b)) = 1 AS one
  FROM c, s),
g AS (
  SELECT part, ord, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
         coalesce(sum(n) FILTER (failing AND one), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost
  FROM x GROUP BY part, ord, step, f)
SELECT part, array_to_string(list_transform(ord, lambda i: substr('ABCDE', i::INT, 1)), '') AS filter_order, step::INT AS step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM g
"""
