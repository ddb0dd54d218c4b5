import math
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec import rng
from lexivec.errors import InvalidArgument, InvalidModel
from lexivec.functions import text as T
from lexivec.functions import vectors as V
from lexivec.operators import features, kernels, metrics, neighbors, quantization, scoring, search, training, vocabulary
from lexivec.params import LossKind, Params, model_kind, parse_metric, parse_size
from lexivec.sources import binary, corpus, vectors
from lexivec.streaming import operators as live


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- hashes and tokens ------------------------------------------------------------

GOLDEN = {"": 2166136261, "hello": 1335831723, "a": 3826002220, "</s>": 3617362777, "日本語": 308035559, "café": 1970454601}


def test_hash_golden(spark):
    rows = spark.createDataFrame([(k,) for k in GOLDEN], "t string").select("t", T.token_hash("t").alias("h")).collect()
    assert {r.t: r.h for r in rows} == GOLDEN
    raw = spark.createDataFrame([(bytes([b]),) for b in (0x80, 0xFF, 0xFE, 0xC0)], "t binary").select(T.token_hash("t").alias("h")).collect()
    assert [r.h for r in raw] == [83079839, 4193493326, 4210270945, 3304279519]


def test_tokenizers(spark):
    text = "a b\tc\x0bd\n\n e\x00f </s> g h"
    r = one(spark, T.tokens(F.lit(text)).alias("t"), T.corpus_tokens(F.lit(text)).alias("c"), T.simple_tokens(F.lit(text)).alias("s"), T.tokens(F.lit(None).cast("string")).alias("n"))
    assert r.t == ["a", "b", "c\x0bd", "e\x00f", "</s>"]
    assert r.c == ["a", "b", "c", "d", "</s>", "</s>", "e", "f", "</s>", "g h"]
    assert r.s == ["a", "b", "c", "d", "e\x00f", "</s>", "g", "h"] and r.n == []
    long = " ".join(["w"] * 1025)
    r = one(spark, F.size(T.corpus_tokens(F.lit(long))).alias("a"), F.size(T.corpus_tokens(F.lit(f"{long}\n{long}\n"))).alias("b"))
    assert (r.a, r.b) == (1024, 2050)


def test_char_ngrams(spark):
    r = one(spark, T.char_ngrams(F.lit("he"), 3, 4).alias("a"), T.char_ngrams(F.lit("hello"), 3, 6).alias("b"), T.char_ngrams(F.lit("café"), 2, 3).alias("c"), T.char_ngrams(F.lit("ab"), 1, 1).alias("d"), T.char_ngrams(F.lit("x"), 0, 0).alias("e"), T.char_ngrams(F.lit("a"), 4, 6).alias("f"))
    assert r.a == ["<he", "<he>", "he>"] and len(r.b) == 14 and len(r.c) == 9 and r.d == ["a", "b"] and r.e == [] and r.f == []


def brute_word_ngrams(tokens_hashes, n, bucket):
    sign = lambda h: h - 2**32 if h >= 2**31 else h
    out = []
    for i in range(len(tokens_hashes)):
        h = sign(tokens_hashes[i]) % 2**64
        for j in range(i + 1, min(len(tokens_hashes), i + n)):
            h = (h * 116049371 + sign(tokens_hashes[j])) % 2**64
            out.append(h % bucket)
    return out


def test_word_ngrams(spark):
    words = ["hello", "world", "日本語", "a", "b"]
    hs = [r.h for r in spark.createDataFrame([(w,) for w in words], "t string").select(T.token_hash("t").alias("h")).collect()]
    for n in (2, 3, 5):
        got = one(spark, T.word_ngram_ids(F.array(*(F.lit(h) for h in hs)), n, 100_000).alias("g")).g
        assert got == brute_word_ngrams(hs, n, 100_000)
    assert one(spark, T.word_ngram_ids(F.array(*(F.lit(h) for h in hs[:2])), 2, 100_000).alias("g")).g == [85020]
    assert one(spark, T.word_ngram_ids(F.array(*(F.lit(h) for h in hs)), 1, 100).alias("g")).g == []


# --- numbers ------------------------------------------------------------------------


def test_generator():
    assert rng.draw(0, 1) == rng.draw(1, 1) == 48271
    x, want = 7, []
    for _ in range(50):
        x = x * 48271 % (2**31 - 1)
        want.append(x)
    assert rng.draws(7, 1, 50).tolist() == want and rng.draws(7, 20, 5).tolist() == want[19:24]


def test_vectors(spark):
    v, w = F.array(*map(F.lit, (3.0, 4.0))), F.array(*map(F.lit, (1.0, 2.0)))
    r = one(spark, V.norm(v).alias("n"), V.dot(v, w).alias("d"), V.softmax(v).alias("s"), V.l2_normalize(v).alias("u"), V.argmax(F.array(*map(F.lit, (1.0, 5.0, 5.0)))).alias("a"), V.table_sigmoid(F.lit(0.0)).alias("g"), V.table_sigmoid(F.lit(9.0)).alias("o"), V.table_log(F.lit(2.0)).alias("l"))
    assert (r.n, r.d, r.a, r.g, r.o, r.l) == (5.0, 11.0, 1, 0.5, 1.0, 0.0)
    assert sum(r.s) == pytest.approx(1) and r.u == [0.6, 0.8]
    xs = np.linspace(-9, 9, 37)
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select(V.table_sigmoid(F.col("x")).alias("y"), V.table_log(F.abs("x") / 9).alias("z")).collect()
    assert np.allclose([r.y for r in rows], kernels.sigmoid(xs), atol=1e-6) and np.allclose([r.z for r in rows], kernels.log(np.abs(xs) / 9), atol=1e-6)


def test_params():
    assert Params().bucket == 2_000_000 and Params().lr == 0.05
    p = Params.supervised()
    assert (p.lr, p.min_count, p.loss, p.bucket, p.minn, p.maxn) == (0.1, 1, LossKind.SOFTMAX, 0, 0, 0)
    assert Params.supervised(word_ngrams=2).bucket == 2_000_000
    assert len(binary.pack_params(p)) == 56 and binary.unpack_params(binary.pack_params(p)) == replace(Params(), **{f: getattr(p, f) for f in ("dim", "ws", "epoch", "min_count", "neg", "word_ngrams", "loss", "model", "bucket", "minn", "maxn", "lr_update_rate", "t")})
    assert parse_size("1.5M") == 1_572_864 and parse_size("2gb") == 2 << 30 and parse_size("100") == 100
    assert parse_metric("f1:__label__a") == ("f1", None, "__label__a") and parse_metric("precisionAtRecall:30") == ("precision_at_recall", 30.0, None)
    for bad in (lambda: parse_size("x"), lambda: model_kind("x"), lambda: Params.supervised(dim=0), lambda: parse_metric("y")):
        with pytest.raises(InvalidArgument):
            bad()


def test_huffman():
    paths = training.huffman_paths([100, 80, 40, 20])
    assert [len(p) for p, _ in paths] == [1, 2, 3, 3] and [len(p) for p, _ in training.huffman_paths([5, 5])] == [1, 1]
    assert training.huffman_paths([3]) == [([], [])]


# --- metrics -----------------------------------------------------------------------


def test_meter(spark):
    preds = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.8), (3, 0, 0.7), (4, 1, 0.6)], "doc_id long, label_id int, p double")
    gold = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "doc_id long, label_id int")
    counts = metrics.confusion(preds, gold)
    m = metrics.micro(counts, 4, 1, 2).first()
    assert (m.n, m.precision, m.recall, m.f1) == (4, 0.75, 0.75, 0.75)
    assert metrics.micro(metrics.confusion(preds.limit(1), gold.limit(1)), 1, 5, 10).first().precision == pytest.approx(0.2)
    by = {r.label_id: r for r in metrics.per_label(counts).collect()}
    assert by[0].precision == 0.5 and by[0].recall == 1.0 and by[1].recall == pytest.approx(2 / 3)
    points = metrics.curve(preds, gold).where("label_id = 0").orderBy(F.desc("threshold")).collect()
    assert [(p.threshold, p.precision, p.recall) for p in points] == [(0.9, 1.0, 1.0)]
    assert metrics.report(m, 1) == "N\t4\nP@1\t0.75\nR@1\t0.75"
    assert "--------" in metrics.label_report([{"label": "x", "precision": None, "recall": float("nan"), "f1": 0.5}])
    empty = metrics.micro(metrics.confusion(preds.limit(0), gold.limit(0)), 0, 1, 2).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


# --- training and what follows -------------------------------------------------------


@pytest.fixture(scope="module")
def toy(spark):
    sport = "__label__sport the team won the big football game"
    food = "__label__food bake the bread with fresh warm butter"
    return spark.createDataFrame([(k, sport if k % 2 else food) for k in range(60)], "doc_id long, text string")


@pytest.fixture(scope="module")
def model(toy):
    return training.train(toy, Params.supervised(dim=10, epoch=6, lr=0.5, thread=2, seed=42))


def test_supervised(spark, toy, model):
    assert model.losses[-1] < model.losses[0] and model.vocabulary.nlabels == 2
    asked = spark.createDataFrame([(1, "football team"), (2, "warm bread"), (3, ""), (4, None), (5, "unknownword")], "doc_id long, text string")
    got = {(r.doc_id, r.rank): r for r in scoring.predict(asked, model, 5).collect()}
    assert got[1, 0].label == "__label__sport" and got[2, 0].label == "__label__food"
    assert {k[0] for k in got} == {1, 2} and got[1, 0].prob + got[1, 1].prob == pytest.approx(1 + 2e-5, abs=1e-5)
    assert scoring.predict(asked, model, 0).count() == 0
    assert search.score(model, toy) > 0.95 and search.score(model, toy, "f1:__label__food") > 0.95
    assert search.score(model, toy, "precisionAtRecall:50") > 0.9
    with pytest.raises(InvalidArgument):
        search.score(model, toy, "f1:nothing")


@pytest.mark.parametrize("loss", [LossKind.OVA, LossKind.NS, LossKind.HS])
def test_other_losses(toy, loss):
    p = Params.supervised(dim=8, epoch=5, lr=0.5, thread=1, loss=loss, word_ngrams=2, bucket=50)
    m = training.train(toy, p)
    assert m.losses[-1] < m.losses[0] and search.score(m, toy) > 0.9


def test_same_seed_same_weights(toy):
    p = Params.supervised(dim=4, epoch=2, thread=1, seed=42)
    a, b = ({r.fid: r.vec for r in training.train(toy, p).input.collect()} for _ in range(2))
    assert a == b


@pytest.mark.parametrize("kind", ["skipgram", "cbow"])
def test_word_vectors(spark, kind):
    lines = ["the cat sat on the mat", "the dog sat on the rug", "a cat and a dog"] * 15
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    m = training.train(docs, Params.unsupervised(kind, dim=6, epoch=3, min_count=1, minn=2, maxn=3, bucket=40, thread=2, t=1.0))
    assert m.losses[-1] < m.losses[0]
    words = m.vocabulary.words().select("token")
    own = scoring.word_vectors(words.unionByName(spark.createDataFrame([("catz",)], "token string")), m)
    assert own.count() == m.vocabulary.nwords + 1 and own.where(~V.is_finite(F.col("vec"))).count() == 0
    table = neighbors.normalized(own, "token", "vec")
    asked = table.where("token = 'cat'").select(F.col("token").alias("query"), "vec", F.array("token").alias("banned"))
    near = neighbors.nearest(asked, table, 3, "token").collect()
    assert len(near) == 3 and all(r.token != "cat" for r in near)
    assert scoring.ngram_vectors(spark.createDataFrame([("cat",)], "token string"), m).count() == 1 + 7
    sv = scoring.sentence_vectors(spark.createDataFrame([(1, "cat dog"), (2, "")], "doc_id long, text string"), m).orderBy("doc_id").collect()
    assert any(sv[0].vec) and not any(sv[1].vec)


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "b a a __label__x"), (2, "a c")], "doc_id long, text string")
    v = vocabulary.build(docs, Params.supervised(min_count=1))
    assert [(r.id, r.token, r["count"]) for r in v.entries.orderBy("id").collect()] == [(0, "a", 3), (1, "</s>", 2), (2, "b", 1), (3, "c", 1), (4, "__label__x", 1)]
    assert (v.nwords, v.nlabels, v.ntokens) == (4, 1, 8)
    pruned = vocabulary.prune(v, spark.createDataFrame([(0,), (2,), (4 + 9,), (4 + 3,)], "fid long"))
    assert [r.token for r in pruned.entries.orderBy("id").collect()] == ["a", "b", "__label__x"]
    assert {(r.bucket, r.new_id) for r in pruned.prune.collect()} == {(3, 0), (9, 1)}
    assert {r.fid for r in features.apply_prune(spark.createDataFrame([(0,), (7,), (8,)], "fid long"), 4, pruned.prune).collect()} == {0, 4}
    with pytest.raises(InvalidArgument):
        vocabulary.build(docs.select("doc_id", F.lit("a b").alias("text")), Params.supervised(min_count=100))
    p = one(spark, vocabulary.keep_probability(F.lit(1), F.lit(10), 1e-4).alias("p")).p
    assert p == pytest.approx(0.0326, abs=1e-4)


def test_quantize(spark, toy, model):
    q = quantization.quantize(model, dsub=2, qnorm=True, qout=True)
    labels = lambda m: {(r.doc_id, r.label) for r in scoring.predict(toy, m).collect()}
    both = labels(model) & labels(q.as_model())
    assert len(both) >= 0.9 * toy.count() and q.bytes() > 0
    small = quantization.quantize(model, cutoff=6, retrain_on=toy, epoch=2)
    assert small.model.input.count() == 6 and small.model.vocabulary.nwords == 6
    with pytest.raises(InvalidArgument):
        quantization.quantize(replace(model, params=replace(model.params, model=model_kind("cbow"))))
    assert quantization.pieces(10, 4) == [(0, 4), (4, 4), (8, 2)]
    x = np.random.default_rng(1).random((1000, 3)).astype(np.float32)
    means = quantization._kmeans(x, 1)
    assert means.shape == (256, 3) and np.linalg.norm(x - means[quantization.nearest(x, means)], axis=1).mean() < 0.1


def test_binary_files(spark, toy, model, tmp_path):
    path = str(tmp_path / "m.bin")
    binary.save_binary(model, path)
    back = binary.load_binary(spark, path)
    rows = lambda t, k: {r[k]: r["vec"] for r in t.collect()}
    assert rows(back.input, "fid") == rows(model.input, "fid") and rows(back.output, "row") == rows(model.output, "row")
    assert back.vocabulary.entries.orderBy("id").collect() == model.vocabulary.entries.orderBy("id").collect()
    q = quantization.quantize(model, qnorm=True)
    binary.save_binary(q, str(tmp_path / "m.ftz"))
    again = binary.load_binary(spark, str(tmp_path / "m.ftz"))
    a, b = rows(q.input.dense(), "fid"), rows(again.input.dense(), "fid")
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    data = (tmp_path / "m.bin").read_bytes()
    for bad in (b"not a model", struct.pack("<ii", 793712314, 13) + data[8:], data[:70], data[:20]):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(InvalidModel):
            binary.load_binary(spark, str(tmp_path / "bad.bin"))
    binary.save(model, str(tmp_path / "folder"))
    folder = binary.load(spark, str(tmp_path / "folder"))
    assert rows(folder.input, "fid") == rows(model.input, "fid") and folder.params == model.params


def test_vector_files_and_dump(spark, toy, model, tmp_path):
    (tmp_path / "v.vec").write_text("2 10\nbread " + " ".join(["0.5"] * 10) + "\nzebra " + " ".join(["1"] * 10) + "\n")
    given = vectors.read_vectors(spark, str(tmp_path / "v.vec"), 10)
    m = training.train(toy, Params.supervised(dim=10, epoch=0), pretrained=given)
    fid = m.vocabulary.id_of("bread")
    assert m.input.where(F.col("fid") == fid).first().vec == [0.5] * 10
    with pytest.raises(InvalidArgument):
        vectors.read_vectors(spark, str(tmp_path / "v.vec"), 9)
    vectors.write_vectors(model, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == model.vocabulary.nwords + 1
    assert corpus.dump(model, "dict").count() == model.vocabulary.size and corpus.dump(model, "output").count() == 2
    assert corpus.dump(model, "args").where("text = 'dim 10'").count() == 1
    with pytest.raises(InvalidArgument):
        corpus.dump(quantization.quantize(model), "input")
    assert [corpus.format_number(x) for x in (0.1, 1e-7, 123456789.0, 2.0)] == ["0.1", "1e-07", "1.23457e+08", "2"]


def test_search(toy):
    p = Params.supervised(dim=4, epoch=1)
    ask = search.Proposals(p, 10.0, 3)
    assert ask.next(0) == p
    for k in range(30):
        t = ask.next(k / 3)
        assert 1 <= t.epoch <= 100 and 0.01 <= t.lr <= 5 and t.minn in (0, 2, 3) and t.maxn in (0, t.minn + 3) and t.dsub in (2, 4, 8, 16) and t.loss == LossKind.SOFTMAX
    assert search.spread_at(2, 1, 0.1) == 2 and search.spread_at(2, 1, 0.5) == 1.5 and search.spread_at(2, 1, 1) == 1
    found = search.autotune(toy, toy, replace(p, autotune_duration=1, lr=0.5, epoch=3))
    assert found.trials >= 1 and found.score > 0.5 and found.model.vocabulary.nlabels == 2


def test_abort(toy):
    handle = training.TrainingHandle(toy, Params.supervised(dim=4, epoch=50))
    handle.abort()
    m = handle.result()
    assert len(m.losses) <= 2 and scoring.predict(toy, m).count() == 60
    with pytest.raises(InvalidArgument):
        training.TrainingHandle(toy.select("doc_id", F.lit("no labels").alias("text")), Params.supervised()).result()


def test_streams(spark, model, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("football team\nwarm bread\n\n")
    lines = corpus.stream_lines(spark, str(tmp_path / "in"))
    seen = []
    run = live.predict_stream(lines, model, lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "c1"))
    run.processAllAvailable()
    run.stop()
    assert {(r.text, r.label) for r in seen} == {("football team", "__label__sport"), ("warm bread", "__label__food")}
    counts = live.count_stream(lines).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    counts.processAllAvailable()
    counts.stop()
    assert {tuple(r) for r in spark.sql("select * from counts").collect()} == {("football", 1), ("team", 1), ("warm", 1), ("bread", 1)}


def test_blocks_of_many_labels(spark):
    rand = np.random.default_rng(5)
    out, h = rand.random((2500, 3)), rand.random((4, 3))
    output = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(out)], "row int, vec array<double>")
    hid = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(h)], "doc_id int, hidden array<double>")
    z = scoring.logits(hid, output, 2500, 3)
    p = scoring.label_probabilities(z, LossKind.SOFTMAX, n_rows=2500).select("doc_id", F.explode("scores").alias("s")).groupBy("doc_id").agg(F.sum("s.p").alias("t"), F.max(F.struct("s.p", "s.label_id")).alias("m")).collect()
    e = np.exp(h @ out.T)
    for r in p:
        assert r.t == pytest.approx(1) and r.m.label_id == e[r.doc_id].argmax() and r.m.p == pytest.approx(e[r.doc_id].max() / e[r.doc_id].sum())
    assert math.isclose(e[0].sum(), e[0].sum())


def test_paths_of_many_labels(spark):
    rand, n, dim = np.random.default_rng(6), 2100, 3
    tokens = spark.createDataFrame([(0, "word", 1, 0), *((1 + k, f"__label__{k:04}", 1, 1) for k in range(n))], "id int, token string, count long, entry_type byte")
    p = Params.supervised(dim=dim, loss=LossKind.HS, minn=0, maxn=0, bucket=0)
    paths = training.huffman_paths([n - k for k in range(n)])
    out, h = rand.normal(size=(n, dim)), rand.normal(size=dim)
    model = scoring.Model(
        p,
        vocabulary.Vocabulary(tokens, 1, n, n + 1, p),
        spark.createDataFrame([(0, h.tolist())], "fid long, vec array<double>"),
        spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(out)], "row int, vec array<double>"),
        spark.createDataFrame([(k, a, c) for k, (a, c) in enumerate(paths)], "label_id int, path array<int>, code array<boolean>"),
    )
    f = 1 / (1 + np.exp(-(out @ h)))
    want = [math.exp(sum(math.log((f[k] if c else 1 - f[k]) + 1e-5) for k, c in zip(*x, strict=True))) for x in paths]
    got = scoring.predict(spark.createDataFrame([(7, "word")], "doc_id long, text string"), model, k=3).orderBy("rank").collect()
    assert [int(r.label[-4:]) for r in got] == sorted(range(n), key=lambda k: -want[k])[:3]
    assert [r.prob for r in got] == pytest.approx([want[int(r.label[-4:])] + 1e-5 for r in got], rel=1e-3)


def test_pruned_model_reads_its_ngram_rows(spark):
    docs = spark.createDataFrame([(k, f"__label__{k % 2} " + ("red apple pie red" if k % 2 else "blue sea wave blue")) for k in range(20)] + [(20, "zebra apple"), (21, "")], "doc_id long, text string")
    full = training.train(docs, Params.supervised(dim=4, epoch=1, lr=0.5, thread=2, minn=2, maxn=3, word_ngrams=2, bucket=500))
    cutoff = 150
    pruned = quantization.prune_model(full, cutoff)
    v, n, m = pruned.vocabulary, full.vocabulary.nwords, pruned.vocabulary.nwords
    old = {r.token: r.id for r in full.vocabulary.words().collect()}
    new = {old[r.token]: r.id for r in v.words().collect()} | {n + r.bucket: m + r.new_id for r in v.prune.collect()}
    assert len(new) == cutoff

    def lines(of):
        return {r.doc_id: r.fids for r in features.line_features(docs, of).collect()}

    was, got = lines(full.vocabulary), lines(v)
    assert any(x not in new for x in was[20]) and any(new.get(x, 0) >= m for x in was[20])
    assert got == {k: [new[x] for x in ids if x in new] for k, ids in was.items()}
    vecs = {r.fid: r.vec for r in pruned.input.collect()}
    of = {r.fid: r.vec for r in full.input.collect()}
    assert all(vecs[b] == of[a] for a, b in new.items())
    grams = features.ngram_strings(docs.limit(1).select(F.lit("apple").alias("token")), v).collect()
    whole = features.ngram_strings(docs.limit(1).select(F.lit("apple").alias("token")), full.vocabulary).collect()
    assert sorted((r.gram, r.fid) for r in grams) == sorted((r.gram, new[r.fid]) for r in whole if r.fid in new)
    again = quantization.quantize(full, cutoff=cutoff, retrain_on=docs, epoch=1)
    assert again.model.input.count() == cutoff and scoring.predict(docs, again.as_model()).count() > 0
