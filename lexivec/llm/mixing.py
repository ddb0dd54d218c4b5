"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions.

The tree is domain, language, source. A token budget goes down it: at each node the
children share by weight, none gets more than its subtree holds (tokens times the most
epochs), and what a child can't use goes to its siblings; only what no sibling can use
stays with the ancestors' other children. A leaf takes whole seeded epochs of its
documents and then the token-prefix of one more, in a new seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut

#: Leaves up to this many are broadcast (about 100 bytes each); more are joined by shuffle.
LEAVES_BROADCAST = 50_000
#: Documents in a leaf's stretch of the seeded order, on average; one stretch a leaf is ordered.
STRETCH = 1024
LEVELS = ("domain", "lang", "source")
#: The largest weight, as a whole number.
MOST_WEIGHT = 10**9


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level (1 where none is given; 0 or less: nothing), and the budget.

    Weights may be fractions: floats count as their shortest decimals.
    """

    domain_weights: Mapping[str, float | Decimal | Fraction] = field(default_factory=dict)
    lang_weights: Mapping[str, float | Decimal | Fraction] = field(default_factory=dict)
    source_weights: Mapping[str, float | Decimal | Fraction] = field(default_factory=dict)
    #: Tokens to give out, as a share of all tokens.
    share: float = 0.6
    max_epochs: int = 3
    seed: str = "mix-1"

    def weight(self, level: str) -> Column:
        """The weights of a level, all multiplied by what makes them whole numbers."""
        given = {name: Fraction(str(w) if isinstance(w, float) else w) for name, w in getattr(self, f"{level}_weights").items()}
        scale = lcm(*(w.denominator for w in given.values()))
        if any(abs(w) * scale > MOST_WEIGHT for w in (1, *given.values())):
            raise ValueError(f"{level}_weights: more than {len(str(MOST_WEIGHT)) - 1} digits in all")
        out = F.lit(scale)
        for name, w in given.items():
            out = F.when(F.col(level) == name, F.lit(int(w * scale))).otherwise(out)
        return out.cast("long")


#: Domains are sources by number: source k belongs to domain k mod 4; others to "other".
PRODUCTION = Mix(domain_weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, lang_weights={"en": 4, "de": 2, "fr": 2, "es": 2})


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.try_cast("int") % 4).cast("string"))).otherwise("other")


def with_leaf(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """docs with the columns of ``leaf`` (a struct of domain, lang, source) and ``tokens`` (words); nulls are named "none"."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    leaf = F.struct((domain if domain is not None else domain_of(source)).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"), source.alias("source"))
    return docs.withColumn("leaf", leaf).withColumn("tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def share_out(children: DataFrame, parents: list[str], budget: str, weight: Column) -> DataFrame:
    """children with ``allotted``: least(cap, level * weight), where the level uses up the budget.

    Children are taken from the one that is full first; each gives the level that holds if
    all before it are full, and the highest of these is the right one. Those that are full
    at the same level come one after the other and have their highest level at the first or
    after the last, so they are added up first: a node of very many children, most of them
    alike, is a few rows in the task that orders them.
    """
    live = children.withColumn("w", weight).where("w > 0").withColumn("full", F.col("cap") / F.col("w"))
    runs = live.groupBy(*parents, "full").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.max(budget).alias("budget"))
    own = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = own.orderBy("full").rowsBetween(Window.unboundedPreceding, -1)
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left_tokens = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    levels = runs.withColumn("level", left_tokens.cast("double") / left_weight.cast("double")).groupBy(*parents).agg(F.max("level").alias("level"))
    met = live.join(levels, parents) if parents else live.crossJoin(F.broadcast(levels))  # one row
    return met.withColumn("allotted", F.least("cap", F.floor(F.greatest(F.col("level"), F.lit(0.0)) * F.col("w")).cast("long"))).drop("w", "full", "level")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens, docs. Adds allotted, whole (epochs), rest (tokens of one more epoch).

    Leaves that have, or are under, a weight of 0 or less get nothing and have no row;
    what they hold is in the total that the budget is a share of, but in nobody's cap.
    """
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double") * F.lit(float(mix.share))).cast("long")).first()[0] or 0
    live = leaves
    for level in LEVELS:
        live = live.where(mix.weight(level) > 0)
    caps = live.withColumn("cap", F.col("tokens") * mix.max_epochs)
    by_domain = caps.groupBy("domain").agg(F.sum("cap").alias("cap"))
    top = share_out(by_domain.withColumn("budget", F.lit(total)), [], "budget", mix.weight("domain")).select("domain", F.col("allotted").alias("budget"))
    by_lang = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top, "domain")
    mid = share_out(by_lang, ["domain"], "budget", mix.weight("lang")).select("domain", "lang", F.col("allotted").alias("budget"))
    low = share_out(caps.join(mid, ["domain", "lang"]), ["domain", "lang"], "budget", mix.weight("source"))
    whole = F.when(F.col("tokens") > 0, F.expr("allotted div tokens")).otherwise(F.lit(0))
    return low.withColumn("whole", whole).withColumn("rest", F.col("allotted") - F.col("whole") * F.col("tokens")).drop("cap", "budget")


def _keys(docs: DataFrame, id_col: str, domain: Column | None) -> DataFrame:
    """(_id, leaf, tokens, _said) of each row, written once, so that texts are read and counted once."""
    return cut(with_leaf(docs, domain).select(F.col(id_col).alias("_id"), "leaf", "tokens", F.xxhash64("text").alias("_said")))


def _order(mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.coalesce("whole", F.lit(0)).cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))


def _stretch() -> Column:
    return F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.coalesce("stretches", F.lit(1)) / F.lit(2**32)).cast("long")


def bounds(keys: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """(leaf, whole, rest, stretches, _last, _upto) and whether it is small: where each leaf's prefix ends.

    _last is the stretch of the leaf's order in which the budget ends and _upto the last
    (order, text's hash) there that still fits. Only sums of a leaf or of a stretch are
    grouped, so a leaf with a third of all rows is pre-aggregated in each task; in each
    leaf just the one stretch is ordered row by row.
    """
    sums = keys.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).select("leaf.*", "tokens", "docs")
    plan = cut(budgets(cut(sums), mix))
    few = plan.limit(LEAVES_BROADCAST + 1).count() <= LEAVES_BROADCAST
    hint = F.broadcast if few else lambda df: df
    of = plan.select(F.struct(*LEVELS).alias("leaf"), "whole", "rest", (F.floor((F.col("docs") - 1) / STRETCH) + 1).alias("stretches"))
    dealt = keys.join(hint(of.where("rest > 0")), "leaf").withColumn("_order", _order(mix)).withColumn("_at", _stretch())
    parts = dealt.groupBy("leaf", "_at").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    run = F.sum("held").over(Window.partitionBy("leaf").orderBy("_at"))
    ends = parts.withColumn("until", run).where(F.col("until") > F.col("rest")).groupBy("leaf").agg(F.min(F.struct("_at", "until", "held")).alias("e"))
    ends = cut(ends.select("leaf", F.col("e._at").alias("_last"), (F.col("e.until") - F.col("e.held")).alias("_before")))
    edge = dealt.join(hint(ends), "leaf").where(F.col("_at") == F.col("_last"))
    # rows of equal place, repeated rows, go together or not at all
    upto = Window.partitionBy("leaf").orderBy("_order", "_said").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = edge.withColumn("until", F.sum("tokens").over(upto) + F.col("_before")).where(F.col("until") <= F.col("rest")).groupBy("leaf").agg(F.max(F.struct("_order", "_said")).alias("_upto"))
    return cut(of.join(ends.drop("_before"), "leaf", "left").join(fits, "leaf", "left")), few


def _with_copies(rows: DataFrame, found: tuple[DataFrame, bool], mix: Mix) -> DataFrame:
    """rows (leaf, _id, _said, ..) with ``copies``."""
    ends, few = found
    marked = rows.join(F.broadcast(ends) if few else ends, "leaf", "left").withColumn("_order", _order(mix)).withColumn("_at", _stretch())
    inside = (F.col("_at") < F.col("_last")) | ((F.col("_at") == F.col("_last")) & (F.struct("_order", "_said") <= F.col("_upto")))
    more = (F.coalesce("rest", F.lit(0)) > 0) & F.coalesce(inside, F.col("_last").isNull())
    copies = F.coalesce("whole", F.lit(0)).cast("int") + F.when(more, 1).otherwise(0)
    return marked.withColumn("copies", copies).drop("whole", "rest", "stretches", "_last", "_upto", "_order", "_at", "_id", "_said")


def count_copies(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", domain: Column | None = None) -> DataFrame:
    """(id, leaf, tokens, copies) for each row of docs, as in select_copies; texts are read once."""
    keys = _keys(docs, id_col, domain)
    return _with_copies(keys.withColumn("id", F.col("_id")), bounds(keys, mix), mix).select("id", "leaf", "tokens", "copies")


def select_copies(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", domain: Column | None = None) -> DataFrame:
    """docs with ``leaf``, ``tokens`` and ``copies``: how often the mix has each row (0: not at all).

    Needs the columns text, lang and source; null texts have no tokens, null languages and
    sources are named "none", null ids are ordered as "". Rows of the same id and leaf are
    ordered by their text's hash; rows that repeat id and text are in the prefix together
    or not at all. A leaf of weight 0 has no copies. Existing columns leaf, tokens and
    copies are replaced; an empty table gives an empty one.

    Texts are read twice: once to count tokens, once to go through.
    """
    names = [c for c in docs.columns if c not in ("leaf", "tokens", "copies")]
    found = bounds(_keys(docs, id_col, domain), mix)
    rows = with_leaf(docs.select(*names), domain).withColumns({"_id": F.col(id_col), "_said": F.xxhash64("text")})
    return _with_copies(rows, found, mix).select(*names, "leaf", "tokens", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]{1,9}$') THEN 'd' || (CAST(substr(source, 4) AS INT) % 4)::VARCHAR ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 3 * sum(tokens)::BIGINT AS cap FROM d GROUP BY ALL),
t AS (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS BIGINT) AS budget FROM leaves),
d1 AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaves GROUP BY domain),
d2 AS (SELECT *, (t.budget - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lv FROM d1, t WINDOW b AS (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d3 AS (SELECT domain, least(cap, CAST(floor(greatest(max(lv) OVER (), 0) * w) AS BIGINT)) AS budget FROM d2),
l1 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w FROM leaves GROUP BY domain, lang),
l2 AS (SELECT l1.*, (budget - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER b, 0))::DOUBLE AS lv FROM l1 JOIN d3 USING (domain) WINDOW b AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l3 AS (SELECT domain, lang, least(cap, CAST(floor(greatest(max(lv) OVER (PARTITION BY domain), 0) * w) AS BIGINT)) AS budget FROM l2),
s1 AS (SELECT leaves.*, 1 AS w, budget FROM leaves JOIN l3 USING (domain, lang)),
s2 AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER b, 0))::DOUBLE AS lv FROM s1 WINDOW b AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT domain, lang, source, tokens AS held, least(cap, CAST(floor(greatest(max(lv) OVER (PARTITION BY domain, lang), 0) * w) AS BIGINT)) AS allotted FROM s2),
s4 AS (SELECT *, CASE WHEN held > 0 THEN allotted // held ELSE 0 END AS whole FROM s3),
r AS (SELECT d.*, whole, allotted - whole * held AS rest, sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1:' || whole::VARCHAR || ':' || doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM d JOIN s4 USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END)::INT AS copies FROM r
"""
