import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lexivec.llm import divergence, interactions, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, part string, digest string, term string, at int, good boolean"


def made(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 0, 7, "x", "y", "z", 3, True) for r in rows], DOCS)


def odd_rows(seed=3, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "a", "b#", "Ä", "ärger", "ÉTÉ", "x1y", "CAPS", "zz", "q|"]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 99, 100, 101, 130])
        text = " ".join(rng.choice(words) if rng.random() < 0.5 else f"w{rng.randint(0, 400)}" for _ in range(size))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])))
    rows += [(1000 + i, rows[i % 7][1], "en", "s1") for i in range(40)]  # copies of a few texts
    rows += [rows[3], rows[3], rows[-20]]  # repeated rows
    rows += [(2000, None, None, None), (2001, "", "en", None), (2002, None, "fr", "only"), (2003, " \t\n\x0b", "fr", "only"), (None, rows[3][1], "en", "s1"), (None, "unlike all", "xx", "s9")]
    rows += [(2005, "zzz", "nn", "a"), (2006, None, "nn", "b")]  # a language without kept terms
    rows += [(2004, "wörter " * 30_000, "de", "s1")]
    return rows


def brute_flags(rows):
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        late = i is not None and smallest[t] < i
        out.append((i, lang or "", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), late)))
    return out


def brute_audit(rows, quality, toxic):
    found = brute_flags(rows)
    out = {}
    for part in {p for _, p, _ in found}:
        own = [(i, f) for i, p, f in found if p == part]
        by_order = {}
        for order in permutations(range(5)):
            left, gone = own, []
            for step, f in enumerate(order):
                removed = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                by_order[order, step] = (len(left), len(removed), sum(x[1][f] for x in gone), sum(x[1][f] and sum(x[1]) == 1 for x in own), sum(x[0] in quality for x in removed), sum(x[0] in toxic for x in removed), f)
                gone = gone + removed
        sums = Counter()
        for v in by_order.values():
            sums[v[6]] += v[1]
        for (order, step), v in by_order.items():
            out[part, "".join("ABCDE"[k] for k in order), step + 1] = (*v[:6], sums[v[6]])
    return out


def test_interactions_are_those_of_all_orders_applied_to_the_rows(spark):
    rows = odd_rows()
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 1040, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    quality, toxic = {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None}
    found = interactions.audit(interactions.cells(made(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert got == brute_audit(rows, quality, toxic)


def test_interactions_of_other_filters_and_of_nothing(spark):
    rows = odd_rows(5, 30)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = interactions.cells(made(spark, rows), labels)
    two = interactions.audit(cells, "CA").where("part = 'en'")
    fails = [f for _, p, f in brute_flags(rows) if p == "en"]
    want = {("CA", 1): sum(f[2] for f in fails), ("CA", 2): sum(f[0] and not f[2] for f in fails), ("AC", 1): sum(f[0] for f in fails), ("AC", 2): sum(f[2] and not f[0] for f in fails)}
    assert {(r.filter_order, r.step): r.removed for r in two.collect()} == want
    assert interactions.audit(interactions.cells(made(spark, []), labels)).count() == 0


def brute_divergence(rows, least=3, most=200):
    counts, docs, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(found if part == "pair" else found[:most])]
    return sorted(out)


def test_divergences_are_those_of_all_terms_written_out(spark, monkeypatch):
    rows = odd_rows()
    want = brute_divergence(rows)
    assert any(r[2] == "pair" and r[4] == 0 for r in want) and len({r[0] for r in want}) > 3
    own = lambda: sorted(tuple(r) for r in divergence.audit(made(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert own() == want
    monkeypatch.setattr(divergence, "GROUPS_BROADCAST", 0)  # joins by shuffle
    assert own() == want
    assert sorted(tuple(r) for r in divergence.audit(made(spark, rows), most_terms=2, least_docs=1).select("lang", "source", "part", "item", "value", "rank").collect()) == brute_divergence(rows, 1, 2)
    assert divergence.audit(made(spark, [])).count() == 0


def test_shares_are_exact_where_products_overflow(spark):
    pairs = [(1, 1), (1, 3), (7, 9), (10**12, 10**13 + 1), (8 * 10**15, 9 * 10**15), (123456789012345, 8999999999999999)]
    got = spark.createDataFrame(pairs, "c long, n long").select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.c // r.n for r in got)


@pytest.mark.parametrize("name", ["op11_filter_interactions", "op12_source_divergence"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
