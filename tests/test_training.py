"""Training by waves, and that large vocabularies and models are treated as small ones are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import features, scoring, training, vocabulary
from lexivec.params import LossKind, Params

BLANK = [None, "", " \t\n ", "__label__a", "</s>"]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(["__label__a" if k % 2 else "__label__b", *(rng.choice(words[:30] if k % 2 else words[30:]) for _ in range(rng.randint(1, 12)))])) for k in range(200)]
    rows += [(300 + k, t) for k, t in enumerate(BLANK)] + [(400, "w1 " * 2500 + "unknown"), (None, "w1 w2"), (3, "w1 w2")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.fixture
def large(monkeypatch):
    """Every limit so low that nothing is held by tasks or broadcast."""

    def set_limits():
        monkeypatch.setattr(vocabulary, "BROADCAST_ENTRIES", 0)
        monkeypatch.setattr(scoring, "BROADCAST_NUMBERS", 0)

    return set_limits


def listed(df, *names):
    return sorted((tuple(map(str, r)) for r in df.select(*names).collect()))


def test_features_are_the_same_at_every_size(lines, large):
    p = Params.supervised(min_count=2, word_ngrams=2, bucket=100, minn=2, maxn=3)
    v = vocabulary.build(lines, p)
    made = lambda **x: listed(features.line_features(lines, v, **x), "doc_id", "fids", "labels")
    small = made(), made(eos=False), made(eos_in_ngrams=True)
    assert {i: f for i, f, _ in small[0]}["300"] == "[]" and {i: f for i, f, _ in small[0]}["302"] == "[]"
    large()
    assert v.for_tasks() is None and (made(), made(eos=False), made(eos_in_ngrams=True)) == small


def test_lines_of_words_are_the_same_at_every_size(lines, large):
    v = vocabulary.build(lines, Params.unsupervised("skipgram", min_count=3))
    small = listed(training.word_lines(lines, v, "text"), "ids")
    # 2501 known tokens and the end of line: three pieces
    assert sorted(r[0].count(",") + 1 for r in small)[-3:] == [451, 1025, 1025]
    large()
    assert listed(training.word_lines(lines, v, "text"), "ids") == small


@pytest.mark.parametrize("loss", [LossKind.SOFTMAX, LossKind.HS, LossKind.OVA])
def test_predictions_are_the_same_at_every_size(lines, large, loss):
    m = training.train(lines, Params.supervised(dim=5, epoch=2, lr=0.3, thread=1, loss=loss, min_count=1))
    made = lambda: {(r.doc_id, r.rank): (r.label, round(r.prob, 5)) for r in scoring.predict(lines.where("doc_id is not null and doc_id <> 3"), m, 2).collect()}
    small = made()
    assert {k[0] for k in small} & {300, 301, 302} == set() and len(small) > 300
    large()
    assert made() == small


@pytest.mark.parametrize("kind", ["skipgram", "cbow"])
def test_word_vectors_learn_at_every_size(lines, large, kind):
    p = Params.unsupervised(kind, dim=6, epoch=3, min_count=1, minn=2, maxn=3, bucket=400, thread=1, t=1.0)
    lines = lines.where("doc_id < 200 or doc_id between 300 and 310 or doc_id is null")
    small = training.train(lines, p)
    large()
    many = training.train(lines, p)
    assert small.losses[0] > small.losses[-1] > 0 and many.losses[0] > many.losses[-1] > 0
    assert many.losses == pytest.approx(small.losses, rel=0.1)


def test_a_wave_reads_its_own_lines_and_rows_only(lines, monkeypatch):
    p = Params.supervised(dim=5, epoch=2, lr=0.4, thread=1, min_count=1, minn=2, maxn=3, bucket=300)
    plain = training.train(lines, p)
    monkeypatch.setattr(training, "PART_TOKENS", 270)
    taken, ends = [], []
    take, drop = training.Waves.take, training.Waves.drop

    def count(self, step):
        own, rows = take(self, step)
        weights = self.read("weights", step)
        schedule = {tuple(r) for r in self.read("schedule", step).select("mat", "row").collect()}
        read = {tuple(r) for r in weights.select("mat", "row").collect()}
        assert weights.count() == len(read) and read == schedule  # each touched row once, no other
        taken.append((step, own.count(), set(own.inputFiles()), set(weights.inputFiles())))
        return own, rows

    def finish(self, name=""):
        if not name:
            ends.append((self.count, self.read("lines").count(), self.read("weights").count(), self.read("weights").select("mat", "row").distinct().count()))
        drop(self, name)

    monkeypatch.setattr(training.Waves, "take", count)
    monkeypatch.setattr(training.Waves, "drop", finish)
    m = training.train(lines, p)
    (waves, n_lines, n_weights, n_rows), epochs = ends[0], [taken[: len(taken) // 2], taken[len(taken) // 2 :]]
    assert waves >= 10 and len(taken) == 2 * waves and n_weights == n_rows
    for own in epochs:
        assert sum(n for _, n, _, _ in own) == n_lines
        assert sum(len(files) for *_, files, _ in own) == len(set().union(*(files for *_, files, _ in own)))
    assert not set().union(*(w for *_, w in epochs[0])) & set().union(*(w for *_, w in epochs[1]))
    assert m.losses[-1] < m.losses[0] and m.losses[-1] < 1.5 * plain.losses[0]
    assert m.input.count() == plain.input.count() and m.output.count() == plain.output.count()


def test_negatives_and_kept_words_are_drawn_for_each_epoch(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("abcdefgh") for _ in range(30))) for k in range(100)], "doc_id long, text string")
    drawn = {}
    take = training.Waves.take

    def look(self, step):
        own, rows = take(self, step)
        drawn[step] = {r.row: r.ids[0] for r in rows.where(F.col("mat") == training.DRAW).collect()}
        return own, rows

    monkeypatch.setattr(training.Waves, "take", look)
    seen = []
    examples = training.kernels.examples
    p = Params.unsupervised("skipgram", dim=4, epoch=2, min_count=1, minn=0, maxn=0, bucket=0, thread=1, t=1e-2)
    training.train(docs, p)
    assert len(drawn) == 2 and drawn[0] != drawn[1] and all(sum(d.values()) == training.LEAST_DRAWS for d in drawn.values())
    # what a part keeps, by its kernel alone
    ids = list(range(8)) * 200
    words = [(0, training.WORD, k, [k], 0.3) for k in range(8)]
    import pyarrow as pa

    rows = pa.Table.from_pylist(
        [{"part": 0, "mat": m, "row": k, "vec": [0.1] * 4, "ids": None, "keep": None} for m in (training.INPUT, training.OUTPUT) for k in range(8)]
        + [{"part": 0, "mat": m, "row": k, "vec": None, "ids": x, "keep": c} for _, m, k, x, c in words]
        + [{"part": 0, "mat": training.DRAW, "row": k, "vec": None, "ids": [5], "keep": None} for k in range(8)],
        schema=pa.schema([("part", pa.int32()), ("mat", pa.int32()), ("row", pa.int64()), ("vec", pa.list_(pa.float32())), ("ids", pa.list_(pa.int64())), ("keep", pa.float32())]),
    )
    given = pa.Table.from_pylist([{"part": 0, "key": k, "ids": ids, "targets": []} for k in range(2)], schema=pa.schema([("part", pa.int32()), ("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("targets", pa.list_(pa.int32()))]))

    def watch(n, window, rng):
        seen.append(n)
        return examples(n, window, rng)

    monkeypatch.setattr(training.kernels, "examples", watch)
    for epoch in range(2):
        training._kernel(p, epoch, 0, 1)(rows.drop_columns(["part"]), given)
    assert all(300 < n < 660 for n in seen) and len(set(seen)) > 1  # 0.3 of 1600, equal lines and epochs apart


def full_scores(h, out, paths):
    f = 1 / (1 + np.exp(-(h @ out.T)))
    return np.array([[np.exp(sum(np.log((x[n] if c else 1 - x[n]) + 1e-5) for n, c in zip(*path, strict=True))) for path in paths] for x in f])


@pytest.mark.parametrize("k,least", [(1, 0.0), (5, 0.0), (10, 0.01), (3, 0.5)])
def test_search_of_the_tree_finds_the_best(k, least):
    rng = np.random.default_rng(k)
    n = 300
    paths = training.huffman_paths(sorted((int(10000 / (i + 1)) for i in range(n)), reverse=True))
    out, h = rng.normal(0, 1, (n - 1, 4)).astype(np.float32), rng.normal(0, 1, (20, 4))
    tree = scoring.Tree.of(np.arange(n), np.concatenate(([0], np.cumsum([len(p) for p, _ in paths]))), np.concatenate([p for p, _ in paths]), np.concatenate([c for _, c in paths]))
    found, _ = tree.best(h, np.arange(n - 1), out, k, least)
    for own, p in zip(found, full_scores(h, out.astype(np.float64), paths), strict=True):
        want = [i for i in sorted(range(n), key=lambda i: (-p[i], -i)) if p[i] >= least][:k]
        assert [i for _, i in own] == want and [x for x, _ in own] == pytest.approx([p[i] for i in want])


def test_search_of_a_large_tree_looks_at_few_nodes():
    rng = np.random.default_rng(9)
    n, dim = 100_000, 8
    counts = np.sort((1e7 / np.arange(1, n + 1)).astype(np.int64))[::-1]
    parent, right = training.huffman_tree(counts)
    steps = [training._path(parent, right, k) for k in range(n)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p, _ in steps])))
    nodes, code = np.concatenate([p for p, _ in steps]), np.concatenate([c for _, c in steps])
    tree = scoring.Tree.of(np.arange(n), offsets, nodes, code)
    out, h = rng.normal(0, 1, (n - 1, dim)), rng.normal(0, 1, (40, dim))
    found, looked = tree.best(h, np.arange(n - 1), out, 5, 0.0)
    assert looked < 0.1 * (n - 1) * len(h)
    f = 1 / (1 + np.exp(-(h[:4] @ out.T)))
    logs = np.log(np.where(code, f[:, nodes], 1 - f[:, nodes]) + 1e-5)
    for own, x in zip(found, np.exp(np.add.reduceat(logs, offsets[:-1], axis=1)), strict=False):
        best = sorted(range(n), key=lambda i: (-x[i], -i))[:5]
        assert [i for _, i in own] == best and [p for p, _ in own] == pytest.approx(x[best])


def test_one_label_and_the_joined_search(spark, large):
    only = scoring.Tree.of(np.array([0]), np.array([0, 0]), np.array([], np.int64), np.array([], bool))
    assert only.best(np.zeros((2, 3)), np.zeros(0), np.zeros((0, 3)), 4, 0.0)[0] == [[(1.0, 0)]] * 2
    rng = np.random.default_rng(3)
    n = 40
    paths = training.huffman_paths(list(range(100, 100 - n, -1)))
    out, h = rng.normal(0, 2, (n - 1, 3)), rng.normal(0, 1, (6, 3))
    hid = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(h)], "_row long, hidden array<double>")
    output = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(out)], "row int, vec array<double>")
    table = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(paths)], "label_id int, path array<int>, code array<boolean>")
    scores = full_scores(h, out, paths)
    for k, least in ((3, 0.0), (4, 0.05)):
        for r in scoring.search_paths(hid, output, table, k, least, "_row").collect():
            p = scores[r._row]
            want = [i for i in sorted(range(n), key=lambda i: (-p[i], -i)) if p[i] >= least][:k]
            assert [x.label_id for x in r.predictions] == want and [x.p for x in r.predictions] == pytest.approx([p[i] for i in want])
    z = scoring.logits(hid, output, n - 1, 3, "_row")
    for r in scoring.path_probabilities(z, table, "_row").collect():
        assert r.p == pytest.approx(scores[r._row][r.label_id])
    alone = spark.createDataFrame([(0, [], [])], table.schema)
    assert [r.predictions[0].p for r in scoring.search_paths(hid, output, alone, 1, 0.0, "_row").collect()] == [1.0] * 6
    assert scoring.path_probabilities(z, alone, "_row").count() == 6


def test_initial_matrix_to_its_last_decimal(spark, sf):
    """Rounded from doubles: floats put two of its 8000 numbers on the other side of a half."""
    import duckdb

    from lexivec.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = {(i, j): x for i, j, x in con.execute(f"SELECT fid, j, x FROM ({SQL['initial_matrix']})").fetchall()}
    got = {(r.fid, r.j): r.x for r in QUERIES["initial_matrix"](spark, sf).collect()}
    assert got == want and len(want) == 8000


def test_large_vocabularies_are_looked_up_by_parts(lines, large, monkeypatch):
    """Without a row a token that is joined and put together again; many parts give what one gives."""
    v = vocabulary.build(lines, Params.supervised(min_count=2, word_ngrams=2, bucket=100))
    small = listed(features.line_features(lines, v), "doc_id", "fids", "labels")
    large()
    monkeypatch.setattr(features, "_joined_features", None)
    monkeypatch.setattr(features, "PART_ITEMS", 100)
    assert listed(features.line_features(lines, v), "doc_id", "fids", "labels") == small


def test_the_number_of_waves_is_bounded(lines, monkeypatch):
    monkeypatch.setattr(training, "PART_TOKENS", 10)
    counts, drop = [], training.Waves.drop
    monkeypatch.setattr(training.Waves, "drop", lambda self, name="": (counts.append((self.count, self.read("lines").count())) if not name else None, drop(self, name)))
    training.train(lines, Params.supervised(dim=4, epoch=1, lr=0.1, thread=1, min_count=1))
    assert counts[0][0] <= training.MOST_WAVES and counts[0][1] == 201


def test_many_negatives_are_never_rows(spark):
    # as rows, so many draws were broadcast, as Spark took them for as few as were asked for
    chances = spark.createDataFrame([(0, 0.5), (1, 0.25), (2 * training.DRAW_BLOCK, 0.25), (2 * training.DRAW_BLOCK + 1, 0.0)], "id int, chance double")
    asked = spark.createDataFrame([(0, 0, 2_000_000_000), (0, 1, 10), (1, 0, 1_000_000), (1, 1, 0)], "step int, part int, draws int")
    found = {}
    for r in training.draw_negatives(chances, asked, 3).collect():
        found.setdefault((r.step, r.part), {})[r.row] = r.n
    assert {k: sum(v.values()) for k, v in found.items()} == {(0, 0): 2_000_000_000, (0, 1): 10, (1, 0): 1_000_000}
    for key, few in (((0, 0), 1e-3), ((1, 0), 1e-2)):
        n = sum(found[key].values())
        assert set(found[key]) == {0, 1, 2 * training.DRAW_BLOCK} and abs(found[key][0] / n - 0.5) < few and abs(found[key][1] / n - 0.25) < few
    assert listed(training.draw_negatives(chances, asked, 3), "step", "part", "row", "n") == sorted((str(s), str(p), str(r), str(n)) for (s, p), v in found.items() for r, n in v.items())


def test_a_table_beyond_what_is_held_goes_by_blocks(spark, monkeypatch):
    """A vector for each different id of each part was shuffled, more than a disk has; now a sum a line and block."""
    rng = np.random.default_rng(5)
    n, dim = 90, 4
    table = spark.createDataFrame([(k, rng.normal(size=dim).astype(np.float32).tolist()) for k in range(n)], "fid long, vec array<float>")
    rows = [(k, rng.integers(0, n + 5, rng.integers(0, 30)).tolist()) for k in range(150)] + [(None, [1, 1, 89]), (None, [1, 1, 89]), (None, [2]), (3, None), (3, [40, 95]), (7, [500])]
    lines = spark.createDataFrame(rows, "doc_id long, fids array<bigint>").repartition(3)
    made = lambda: sorted((str(r.doc_id), [round(x, 9) + 0.0 for x in r.hidden]) for r in scoring.hidden(lines, table, dim, rows=n).collect())
    small = made()
    monkeypatch.setattr(features, "by_parts", None)
    for most in (n * dim // 2, n * dim // 3 + dim, n * dim // 8 + dim):
        monkeypatch.setattr(scoring, "BROADCAST_NUMBERS", most)
        assert scoring.hold(table, n * dim, dim) is None and len(scoring.hold_blocks(table, n, dim)) == -(-n // (most // dim))
        assert made() == small and len(small) == len(rows)
    monkeypatch.setattr(scoring, "BROADCAST_NUMBERS", n * dim // 8 - dim)
    assert scoring.hold_blocks(table, n, dim) is None


def test_texts_taken_apart_in_tasks_are_those_of_the_engine(spark, monkeypatch):
    import pyarrow as pa

    from lexivec.functions import text as T

    rng = random.Random(4)
    pieces = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "a", "ü", "</s>", "</s> b", " c", "　", "x</s>", "__label__z "]
    texts = [None, "", " ", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(300))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = [r.t for r in docs.select(T.tokens("text").alias("t")).collect()]
    whole = pa.array(["cut off", *texts]).slice(1)
    assert T.token_lists(whole).to_pylist() == want
    assert T.token_lists(whole, "always").to_pylist() == [t + ["</s>"] for t in want]
    assert T.token_lists(whole, "unless").to_pylist() == [t if "</s>" in t else t + ["</s>"] for t in want]
    ended = vocabulary.explode_tokens(docs, tokenizer=lambda c: F.concat(T.tokens(c), F.array(F.lit("</s>"))))
    counts = listed(vocabulary.count_tokens(ended), "token", "count", "entry_type")
    # no row a token
    monkeypatch.setattr(vocabulary, "explode_tokens", None)
    assert listed(vocabulary.count_lines(docs), "token", "count", "entry_type") == counts
    monkeypatch.setattr(vocabulary, "COUNTED", 3)
    assert listed(vocabulary.count_lines(docs.repartition(2)), "token", "count", "entry_type") == counts
    assert vocabulary.build(docs, Params.supervised()).size == len(counts)


@pytest.mark.parametrize("loss", [LossKind.NS, LossKind.SOFTMAX])
def test_weights_are_filed_by_blocks(spark, lines, monkeypatch, loss):
    """A row of a matrix was a row of its own in every step; the model doesn't depend on how many are together."""
    monkeypatch.setattr(training, "PART_TOKENS", 600)
    p = Params.supervised(dim=4, epoch=2, lr=0.2, thread=1, loss=loss, min_count=1, minn=2, maxn=3, bucket=300)
    given = spark.createDataFrame([("w1", [0.5, 0.25, -0.5, 0.0]), ("w40", [1.0, 2.0, 3.0, 4.0]), ("none", [9.0] * 4)], "token string, vec array<float>")
    filed, made = [], []
    put = training.Waves.put

    def count(self, step, changed):
        filed.append((self.blocks("weights", step).count(), self.read("weights", step).count()))
        put(self, step, changed)

    monkeypatch.setattr(training.Waves, "put", count)
    for numbers in (1 << 15, 40):
        monkeypatch.setattr(training, "BLOCK_NUMBERS", numbers)
        m = training.train(lines, p, pretrained=given)
        made.append([{r[k]: r.vec for r in t.collect()} for t, k in ((m.input, "fid"), (m.output, "row"))])
        again = training.train(lines, p, start=m)
        assert again.input.count() == m.input.count() == m.vocabulary.nwords + 300 and again.losses[-1] < m.losses[0]
    assert all(n <= 20 < rows for n, rows in filed[:2])
    for a, b in zip(*made, strict=True):
        assert a.keys() == b.keys() and all(x == pytest.approx(b[k], abs=1e-6) for k, x in a.items())


def test_tables_and_sums_of_a_step():
    from lexivec.functions.vectors import grid_sigmoid
    from lexivec.operators import kernels

    for kind in (np.float32, np.float64):
        x = np.concatenate((np.linspace(-9, 9, 4001), [-8, 8, np.nextafter(8, 9), np.nextafter(-8, -9), 0, 1e30, -1e30])).astype(kind)
        assert np.allclose(kernels.sigmoid(x), grid_sigmoid(x), rtol=1e-6, atol=0) and kernels.sigmoid(x).dtype == kind
    w = np.zeros((5, 3), np.float32)
    kernels.scatter_add(w, np.array([4, 1, 4, 4]), np.arange(12, dtype=np.float32).reshape(4, 3))
    assert w.tolist() == [[0] * 3, [3, 4, 5], [0] * 3, [0] * 3, [15, 18, 21]]
    # of two groups the first has two examples; all by hand
    wi, wo = np.array([[0.1, 0.2], [0.3, -0.1], [0.2, 0.2]]), np.array([[0.1, 0.0], [0.0, 0.3]])
    a, b = wi.copy(), wo.copy()
    step = kernels.Step(wi, wo, LossKind.NS, False, (0,), 1, np.array([1, 1]))
    step.batch(np.array([0, 2, 3]), np.array([0, 1, 2]), np.array([0, 0, 1]), np.array([0, 0, 0]), 0.5)
    h = np.array([(a[0] + a[1]) / 2, a[2]])
    for g in (0, 0, 1):
        up, down = 0.5 * (1 - grid_sigmoid(h[g] @ b[0])), 0.5 * (0 - grid_sigmoid(h[g] @ b[1]))
        a[[0, 1] if g == 0 else [2]] += up * b[0] + down * b[1]
        wo[0] -= up * h[g]
        wo[1] -= down * h[g]
    assert np.allclose(wi, a) and np.allclose(wo, b) and step.n == 3 and step.total > 0
    bad = kernels.Step(np.array([[np.nan, 1.0]]), np.ones((2, 2)), LossKind.NS, False, (0,), 1, np.array([1, 1]))
    bad.batch(np.array([0, 1]), np.array([0]), np.array([0]), np.array([0]), 0.5)
    assert np.isnan(bad.wi).any() and np.isnan(bad.wo).any()
