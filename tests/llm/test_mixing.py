import duckdb

from lexivec.llm import mixing, queries


def test_query_matches_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = ["doc_id", "domain", "lang", "source", "tokens", "copies"]
    want = sorted(db.execute(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in queries.op2_mixing_sources(spark, sf).select(*cols).collect())
    assert got == want
    assert {r[5] for r in got} >= {0, 1}


def test_shortage_goes_to_siblings_first(spark):
    leaf = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 5000)]
    df = spark.createDataFrame([(*r, 1) for r in leaf], "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.allotted for r in mixing.budgets(df, mixing.Mix(share=0.5, max_epochs=1)).collect()}
    # 3505 tokens: 1752 each; a: 876 each; s1 has 10, so its sibling s2 gets 866, s3 876
    assert got == {"s1": 10, "s2": 866, "s3": 876, "s4": 1752}


def test_weight_zero_takes_nothing_from_others(spark):
    leaf = [("a", "x", "s1", 1000), ("a", "y", "s2", 1000), ("b", "x", "s3", 5000), ("c", "x", "s4", 0)]
    df = spark.createDataFrame([(*r, 1) for r in leaf], "domain string, lang string, source string, tokens long, docs long")
    given = lambda **w: {r.source: r.allotted for r in mixing.budgets(df, mixing.Mix(share=0.5, max_epochs=1, **w)).collect()}
    assert given(lang_weights={"y": 0}) == {"s1": 1000, "s3": 2500, "s4": 0}
    assert given(source_weights={"s1": 0, "s2": -1}) == {"s3": 3500, "s4": 0}
    assert given(domain_weights={"a": 0, "b": 0, "c": 0}) == {}
    # all three levels on random trees: what can be given is given
    import random

    rng = random.Random(3)
    for _ in range(3):
        rows = [(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{k}", rng.randrange(2000), 1) for k in range(20)]
        tree = spark.createDataFrame(rows, df.schema)
        mix = mixing.Mix({"d0": rng.randrange(3), "d1": 2}, {"l1": rng.randrange(3)}, {"s3": 0, "s4": 5}, share=0.7, max_epochs=2)
        live = [r for r in rows if all(getattr(mix, f"{x}_weights").get(r[k], 1) > 0 for k, x in enumerate(mixing.LEVELS))]
        out = mixing.budgets(tree, mix).collect()
        most = min(int(sum(r[3] for r in rows) * 0.7), 2 * sum(r[3] for r in live))
        assert most - len(rows) * 3 <= sum(r.allotted for r in out) <= most


def test_both_forms_agree_with_a_plain_prefix(spark, monkeypatch):
    import hashlib
    import random

    rng = random.Random(4)
    monkeypatch.setattr(mixing, "STRETCH", 16)
    rows = [(k, "w " * rng.randint(0, 30), "en", rng.choice(["src0", "src0", "src0", "src1"])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(share=0.4, seed="z")
    got = {r.doc_id: r.copies for r in mixing.select_copies(df, mix).collect()}
    assert got == {r.id: r.copies for r in mixing.count_copies(df, mix).collect()}
    sums = mixing.with_leaf(df).groupBy("leaf").agg({"tokens": "sum", "*": "count"}).toDF("leaf", "tokens", "docs").select("leaf.*", "tokens", "docs")
    for r in mixing.budgets(sums, mix).collect():
        run = 0
        for _, k, n in sorted((hashlib.md5(f"z:{r.whole}:{k}".encode()).hexdigest(), k, len(t.split())) for k, t, _, s in rows if s == r.source):
            run += n
            assert got[k] == r.whole + (run <= r.rest and r.rest > 0)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, 5), (1, None, None, None, 5), (None, "a b c", "en", "src1", 6), (2, "a " * 9, "en", "src1", 7)], "doc_id long, text string, lang string, source string, copies int")
    out = mixing.select_copies(df, mixing.Mix(share=1.0)).collect()
    assert len(out) == 4 and all(r.copies >= 0 for r in out)
    assert sum(r.tokens * r.copies for r in out) <= 12
    assert mixing.select_copies(df.limit(0)).count() == 0


def test_weights_may_be_fractions(spark):
    from decimal import Decimal
    from fractions import Fraction

    import pytest

    leaf = [("a", "x", "s1", 1000), ("b", "x", "s2", 1000)]
    df = spark.createDataFrame([(*r, 1) for r in leaf], "domain string, lang string, source string, tokens long, docs long")
    given = lambda a, b: {r.source: r.allotted for r in mixing.budgets(df, mixing.Mix({"a": a, "b": b}, share=0.5)).collect()}
    assert given(0.7, 0.3) == {"s1": 700, "s2": 300} == given(7, 3) == given(Decimal("0.07"), Fraction(3, 100))
    assert given(1.5, 1) == {"s1": 600, "s2": 400} == given(3, 2)
    assert given(0.25, 0.0) == {"s1": 1000} == given(1, -0.5)
    with pytest.raises(ValueError):
        given(float("nan"), 1)
    with pytest.raises(ValueError):
        given(1e-10, 1)


def test_wide_nodes_of_equal_children_are_few_rows(spark):
    """Children that are full at the same level are added up before one task orders them; the shares are those of filling level by level."""
    import random

    rng = random.Random(6)
    rows = [("d", "l", f"s{k}", rng.choice([1, 2, 3, 5, 8, 40]), rng.choice([0.5, 1, 2])) for k in range(3000)]
    df = spark.createDataFrame([(*r[:4], 1) for r in rows], "domain string, lang string, source string, tokens long, docs long")
    mix = mixing.Mix(source_weights={r[2]: r[4] for r in rows[:30]}, share=0.6, max_epochs=1)
    caps = {r[2]: (r[3], r[4] if k < 30 else 1) for k, r in enumerate(rows)}
    budget, left, fixed = int(sum(r[3] for r in rows) * 0.6), dict(caps), {}
    while True:
        level = (budget - sum(fixed.values())) / sum(w for _, w in left.values())
        full = {s: c for s, (c, w) in left.items() if c <= level * w}
        if not full:
            break
        fixed |= full
        left = {s: x for s, x in left.items() if s not in full}
    want = fixed | {s: int(level * w + 1e-9) for s, (_, w) in left.items()}
    assert {r.source: r.allotted for r in mixing.budgets(df, mix).collect()} == want
