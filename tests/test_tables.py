"""Neighbours by blocks, metrics of groups, frequent items, meters and streams."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import frequent, metrics, neighbors


def brute_neighbours(asked, rows, k):
    out = {}
    for q, v, banned in asked:
        sims = sorted(((-float(np.dot(v, x)), i) for i, x in rows if i not in (banned or [])))[:k]
        out[q] = [(i, -s) for s, i in sims]
    return out


@pytest.mark.parametrize("everything", [False, True])
def test_neighbours_by_blocks(spark, monkeypatch, everything):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(neighbors, "CENTRES", 40)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 30)
    monkeypatch.setattr(neighbors, "BLOCK_QUERIES", 25)
    spots = rng.normal(size=(30, 6))
    made = spots[rng.integers(0, 30, 500)] + rng.normal(0, 0.05, (500, 6))
    made[:90] = made[0]  # many equal rows
    made /= np.linalg.norm(made, axis=1)[:, None]
    made[499] = 0
    rows = [(k * 3, v) for k, v in enumerate(made)]
    asked = [(f"q{k}", v, [k * 3]) for k, v in enumerate(made) if everything or k % 50 == 0] + [("new", made[7], None)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id long, vec array<double>")
    queries = spark.createDataFrame([(q, v.tolist(), b) for q, v, b in asked], "query string, vec array<double>, banned array<bigint>")
    seen = []
    got = {}
    for r in neighbors.nearest_by_blocks(queries, table, 4, seen=seen).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.sim))
    want = brute_neighbours(asked, rows, 4)
    assert got.keys() == want.keys()
    for q, own in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in own], abs=1e-12)
        # ids agree where similarities are apart
        assert all(a[0] == b[0] or any(abs(b[1] - c[1]) < 1e-12 for c in own if c is not b) or abs(b[1] - own[-1][1]) < 1e-12 for a, b in zip(got[q], own, strict=True))
    looked, pairs = seen[0]
    assert looked < 0.5 * pairs
    assert neighbors.nearest_by_blocks(queries, table.limit(0), 4).count() == 0 and neighbors.nearest_by_blocks(queries, table, 0).count() == 0
    assert neighbors.nearest_by_blocks(queries.limit(1), table, 1000).count() == 499


def test_metrics_of_groups(spark):
    rng = random.Random(5)
    gold = [(i, rng.randrange(3)) for i in range(60) for _ in range(rng.randrange(3))]
    given = [(i, x) for i in range(60) for x in rng.sample(range(3), rng.randrange(3))] + [(99, 0)]
    groups = {i: rng.choice(["a", "b", None]) for i in range(60)}
    found = metrics.grouped(spark.createDataFrame(given, "doc_id int, label_id int"), spark.createDataFrame(gold, "doc_id int, label_id int"), spark.createDataFrame(list(groups.items()), "doc_id int, part string"), ["part"])
    got = {(r.level, r.part, r.label_id): (r.predicted, r.gold, r.hits, r.precision) for r in found.collect()}
    for level, label, part in itertools.product(range(4), range(3), ["a", "b", None]):
        keep = lambda i, x: (level & 1 or x == label) and (level & 2 or groups.get(i, 0) == part) and i in groups  # noqa: B023, E731
        p, g = {z for z in given if keep(*z)}, [z for z in gold if keep(*z)]
        if p or g:
            want = (len(p), len(g), len(p & set(g)), pytest.approx(len(p & set(g)) / len(p)) if p else None)
            assert got[level, None if level & 2 else part, None if level & 1 else label] == want
    rolled = metrics.grouped(spark.createDataFrame(given, "doc_id int, label_id int"), spark.createDataFrame(gold, "doc_id int, label_id int"), spark.createDataFrame(list(groups.items()), "doc_id int, part string"), ["part"], sets="rollup")
    assert {r.level for r in rolled.collect()} == {0, 1, 3}


@pytest.mark.parametrize("size", [1, 5, 40])
def test_frequent_items_keep_their_bounds(spark, monkeypatch, size):
    monkeypatch.setattr(frequent, "FAN_IN", 2)
    rng = random.Random(size)
    items = [str(int(rng.paretovariate(0.7))) for _ in range(6000)] + [None] * 10
    counts = Counter(x for x in items if x is not None)
    for parts in (1, 7):
        found = {r.token: (r.least, r.most) for r in frequent.frequent(spark.createDataFrame([(x,) for x in items], "token string").repartition(parts), size).collect()}
        assert len(found) <= size and all(a <= counts[x] <= b for x, (a, b) in found.items())
        assert {x for x, n in counts.items() if n > 6000 / size} <= set(found)
        assert all(b - a <= 6000 / size for a, b in found.values())
    assert frequent.frequent(spark.createDataFrame([(None,)], "token string"), size).count() == 0


def test_summaries_merge_in_any_order():
    rng = random.Random(8)
    parts = [Counter(str(int(rng.paretovariate(0.8))) for _ in range(300)) for _ in range(6)]
    counts = sum(parts, Counter())
    for order in itertools.islice(itertools.permutations(parts), 0, 720, 90):
        whole = frequent.Summary(20)
        for own in order:
            s = frequent.Summary(20)
            s.add(own.items())
            whole.merge(s)
        assert whole.total == 1800 and whole.error <= 1800 / 20 and len(whole.counts) <= 20
        assert all(whole.counts[x] <= n <= whole.counts[x] + whole.error for x, n in counts.items())


def test_session_windows_and_late_rows(spark, tmp_path):
    from lexivec.streaming import operators as live

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(at(0), 1), (at(4), 0), (at(20), 1), (at(23), 1), (at(60), 0)]
    schema = "ts timestamp, ok int"
    whole = live.window_meter(spark.createDataFrame(rows, schema), "ts", F.col("ok") == 1, session_gap="5 minutes")
    assert sorted((r.start, r.end, r.n, r.hits) for r in whole.collect()) == [(at(0), at(9), 2, 1), (at(20), at(28), 2, 2), (at(60), at(65), 1, 0)]
    source = tmp_path / "in"
    for k, part in enumerate((rows[:4], rows[4:], [(at(1), 1), (at(62), 1)], [(at(200), 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source / f"{k}"))
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    meter = live.window_meter(stream, "ts", F.col("ok") == 1, late="10 minutes", session_gap="5 minutes")
    run = meter.writeStream.outputMode("append").foreachBatch(lambda batch, _: seen.extend(batch.collect()) and None).option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    # the row of minute 1 is later than the watermark (50) allows; the one of minute 62 isn't
    assert sorted((r.start, r.end, r.n, r.hits) for r in seen) == [(at(0), at(9), 2, 1), (at(20), at(28), 2, 2), (at(60), at(67), 2, 1)]


def test_then_train_on_a_stream(spark, tmp_path):
    from lexivec.operators import training
    from lexivec.params import Params
    from lexivec.streaming import operators as live

    rows = [("__label__sport the team won the big football game",), ("__label__food bake the bread with fresh warm butter",)] * 20
    p = Params.supervised(dim=4, epoch=2, lr=0.5, thread=1)
    first = training.train(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string"), Params.supervised(dim=4, epoch=0, thread=1))
    for k in range(2):
        spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    told = []
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = live.test_then_train(stream, first, p, str(tmp_path / "c"), lambda n, f1, m: told.append((n, f1, m)))
    run.processAllAvailable()
    run.stop()
    assert [n for n, *_ in told] == [0, 1]
    # each batch is scored before it is learned from
    assert told[0][1] <= 0.6 and told[1][1] > 0.95 and told[1][2].losses[-1] < told[0][2].losses[0]


def test_sentence_vectors_are_means(spark):
    from lexivec.operators import features, scoring, training
    from lexivec.params import Params

    docs = spark.createDataFrame([(k, "__label__a x y z" if k % 2 else "__label__b u v w") for k in range(20)], "doc_id long, text string")
    m = training.train(docs, Params.supervised(dim=3, epoch=1, lr=0.3, thread=1, word_ngrams=2, bucket=30))
    rows = {r.fid: np.array(r.vec) for r in m.input.collect()}
    asked = spark.createDataFrame([(1, "x y"), (2, "u unknown"), (3, "nothing known"), (4, None)], "doc_id long, text string")
    fids = {r.doc_id: r.fids for r in features.line_features(asked, m.vocabulary).collect()}
    for r in scoring.sentence_vectors(asked, m).collect():
        want = np.mean([rows[f] for f in fids[r.doc_id]], axis=0) if fids[r.doc_id] else np.zeros(3)
        assert r.vec == pytest.approx(want.tolist())


def test_norms_that_are_no_numbers_raise(spark):
    from lexivec.operators import quantization

    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan"), 0.0])], "fid long, vec array<float>")
    with pytest.raises(Exception, match="isn't a number"):
        quantization.quantize_matrix(table, 2, 1, qnorm=True)
    from lexivec.functions import vectors as V

    assert table.where("fid = 0").select(V.checked_norm(F.col("vec")).alias("n")).first().n == pytest.approx(5**0.5)


def test_many_queries_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    made = rng.normal(size=(20, 3))
    made /= np.linalg.norm(made, axis=1)[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(made)], "id int, vec array<double>")
    queries = spark.createDataFrame([(k, v.tolist(), [k]) for k, v in enumerate(made)], "query int, vec array<double>, banned array<int>")
    calls, plain = [], neighbors.nearest_by_blocks
    monkeypatch.setattr(neighbors, "nearest_by_blocks", lambda *a, **k: calls.append(1) or plain(*a, **k))
    many = neighbors.nearest(queries, table, 2)
    assert calls and dict(many.dtypes)["id"] == "int"
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 1000)
    few = neighbors.nearest(queries, table, 2)
    key = lambda df: sorted((r.query, r["rank"], r.id, round(r.sim, 9)) for r in df.collect())
    assert key(many) == key(few)
