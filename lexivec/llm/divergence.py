"""How the sources of a language differ in their words, by exact divergences.

Each kept term of a language is pivoted into an array with a slot for each source in which
it occurs, in the order of the sources. Higher-order functions make a contribution of each
pair of slots, and these are summed up in the tasks before the shuffle. Terms that a source
lacks aren't written out: there its share of a term is the same for all, so a sum over them
is a multiplication, and of terms that one source of a pair has the shares depend on the
count only, so these are summed over the counts that occur. The sums are the same as over
all terms, and all arithmetic is in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are counted in parts of this many.
UNIT_DIGITS = 9
#: Documents of a language that a kept term is in, at least; terms told of a group.
LEAST_DOCS, MOST_TERMS = 3, 200
#: Sources of all languages up to which they are broadcast (about 60 bytes each); more are joined by shuffle.
GROUPS_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total), by long division three digits at a time, so nothing overflows below totals of 9e15."""
    quotient, rest = F.call_function("div", count, total), count % total
    for _ in range(UNIT_DIGITS // 3):
        quotient, rest = quotient * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return quotient + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q) of shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and documents of it that have it; each group also has a row of a null term.

    Null texts, languages and sources count as empty. A repeated row is another document.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    terms = F.regexp_extract_all(F.translate(text(text_col), _UPPER, _LOWER), F.lit(TERM), 0)
    own = docs.select(text("lang").alias("lang"), text("source").alias("source"), terms.alias("terms"))
    # a document's terms, each of them once, and the null
    kinds = own.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"), F.array(F.lit(None).cast("string")))).alias("kind", "terms"))
    each = kinds.select("lang", "source", "kind", F.explode("terms").alias("term"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.lit(1)).otherwise(0))
    return each.groupBy("lang", "source", "term").agg(of(0).alias("n"), of(1).alias("docs"))


def _numbered(counts: DataFrame) -> DataFrame:
    """(lang, source, at): the groups, numbered from 0 in each language by source."""
    groups = counts.where("term is null").select("lang", "source")
    return groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def wide_terms(counts: DataFrame, groups: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, slots array<struct<at, n>>): the kept terms, a slot for each source that has it."""
    placed = counts.where("term is not null").join(groups, ["lang", "source"])
    wide = placed.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("slots"))
    return wide.where(F.col("docs") >= least_docs).drop("docs")


def languages(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, kept, total, sources array<struct<at, n, filled, none>>): kept terms and their occurrences, and of each source these, its terms, and the share of a term it lacks."""
    sums = wide.select("lang", F.inline("slots")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count("*").alias("filled"))
    whole = wide.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    own = groups.join(sums, ["lang", "at"], "left").join(whole, "lang", "left").na.fill(0, ["n", "filled", "kept", "total"])
    none = F.when(F.col("kept") > 0, share(F.lit(1).cast("long"), F.col("n") + F.col("kept")))
    return own.groupBy("lang", "kept", "total").agg(F.array_sort(F.collect_list(F.struct("at", "n", "filled", none.alias("none")))).alias("sources"))


def _pair(i: Column, j: Column, value: Column) -> Column:
    return F.struct(i["at"].alias("i"), j["at"].alias("j"), value.alias("value"))


def pair_sums(wide: DataFrame, langs: DataFrame, hint=lambda df: df) -> DataFrame:
    """(lang, i, j, value): the sum of gap(share in source i, share in source j) over all kept terms, for all i <> j.

    With p a source's share of a term and e its share of a term it lacks, a pair's sum is
    made of three parts. Terms that both have: gap(p, q) - gap(p, e') - gap(e, q) +
    gap(e, e'). Terms that the first has, by count: gap(p, e'), and the other way round.
    And gap(e, e') for all kept terms less those that either has, counted twice if both do.
    """
    of = langs.select("lang", "kept", "sources")
    others = lambda i: F.filter("sources", lambda j: j["at"] != i["at"])
    empty = F.flatten(F.transform("sources", lambda i: F.transform(others(i), lambda j: _pair(i, j, F.when(F.col("kept") > 0, (F.col("kept") - i["filled"] - j["filled"]) * gap(i["none"], j["none"])).otherwise(F.lit(0).cast("long"))))))
    base = of.select("lang", F.inline(empty))

    # by count: how many terms a source has so often
    times = wide.select("lang", F.inline("slots")).groupBy("lang", "at", "n").agg(F.count("*").alias("times"))
    one = times.join(hint(of), "lang").withColumn("own", F.get("sources", F.col("at")))
    one = one.withColumn("own", F.struct("at", share(F.col("n") + 1, F.col("own.n") + F.col("kept")).alias("p")))
    own = F.col("own")
    single = F.flatten(F.transform(others(own), lambda j: F.array(_pair(own, j, F.col("times") * gap(own["p"], j["none"])), _pair(j, own, F.col("times") * gap(j["none"], own["p"])))))
    by_count = one.select("lang", F.inline(single))

    filled = F.transform("slots", lambda s: F.struct(s["at"].alias("at"), share(s["n"] + 1, F.get("sources", s["at"])["n"] + F.col("kept")).alias("p"), F.get("sources", s["at"])["none"].alias("none")))
    vectors = wide.where(F.size("slots") > 1).join(hint(of), "lang").select("lang", filled.alias("v"))
    value = lambda i, j: gap(i["p"], j["p"]) - gap(i["p"], j["none"]) - gap(i["none"], j["p"]) + gap(i["none"], j["none"])
    both = vectors.select("lang", F.inline(F.flatten(F.transform("v", lambda i: F.transform(F.filter("v", lambda j: j["at"] != i["at"]), lambda j: _pair(i, j, value(i, j)))))))
    added = lambda df: df.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    return added(base.unionByName(added(by_count)).unionByName(added(both)))


def leading_terms(wide: DataFrame, langs: DataFrame, most: int = MOST_TERMS, hint=lambda df: df) -> DataFrame:
    """(lang, at, item, value, rank): the terms that a source has more of than its language, up to ``most`` of a source."""
    slots = wide.select("lang", "term", F.col("n").alias("all_n"), F.inline("slots")).join(hint(langs), "lang")
    q = share(F.col("all_n") + 1, F.col("total") + F.col("kept"))
    p = share(F.col("n") + 1, F.get("sources", F.col("at"))["n"] + F.col("kept"))
    more = slots.select("lang", "at", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "at", "item", gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "at").orderBy(F.col("value").desc(), "item")
    return more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def audit(docs: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other of its language, and by which terms it stands out.

    Part ``pair``: item is another source. Part ``term``: item is a term. Ranks are from 1
    for each group and part, by falling value, ties by item. A language without kept terms
    has pairs of value 0; a language of one source has none. Nulls count as empty; an empty
    table gives no rows. Texts are read once; what follows has the size of the vocabulary.
    """
    counts = cut(term_counts(docs, text_col))
    groups = cut(_numbered(counts))
    few = groups.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST
    hint = F.broadcast if few else lambda df: df
    wide = cut(wide_terms(counts, hint(groups), least_docs))
    langs = cut(languages(wide, groups))
    name = lambda at, own: groups.select("lang", F.col("at").alias(at), F.col("source").alias(own))
    pairs = pair_sums(wide, langs, hint).join(hint(name("i", "source")), ["lang", "i"]).join(hint(name("j", "item")), ["lang", "j"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    terms = leading_terms(wide, langs, most_terms, hint).join(hint(name("at", "source")), ["lang", "at"])
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(terms, "term"))


#: All terms of all groups are written out, zeros too, and divided in 128 bits.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT x.lang, source, term, x.n,
         1 + (1000000000::HUGEINT * (x.n + 1)) // (sum(x.n) OVER (PARTITION BY x.lang, source) + v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (all_n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM x JOIN v ON v.lang = x.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank::INT FROM r WHERE rank <= 200
"""
