"""SQL functions with a model agree with the DataFrame calls."""

import pytest
from pyspark.sql import functions as F

from lexivec.functions import registered
from lexivec.operators import neighbors, scoring, training, vocabulary
from lexivec.params import LossKind, Params

TEXTS = ["football team", "warm bread  \t butter", "", None, "unknownword", "the </s> bread", "__label__food game", "big big won"]


@pytest.fixture(scope="module")
def toy(spark):
    sport, food = "__label__sport the team won the big football game", "__label__food bake the bread with fresh warm butter"
    return spark.createDataFrame([(k, sport if k % 2 else food) for k in range(40)], "doc_id long, text string")


@pytest.mark.parametrize("loss", [LossKind.SOFTMAX, LossKind.HS])
def test_predictions_by_lateral_join(spark, toy, loss):
    m = training.train(toy, Params.supervised(dim=4, epoch=2, lr=0.5, thread=1, loss=loss, minn=2, maxn=3, bucket=60, word_ngrams=2))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.createOrReplaceTempView("asked")
    registered.register_model(spark, m, "one")
    for k, threshold in ((2, 0.0), (1, 0.4)):
        got = {(r.doc_id, r.rank): (r.label, r.prob) for r in spark.sql(f"SELECT doc_id, p.* FROM asked, LATERAL one_predict(text, {k}, {threshold}D) p").collect()}
        want = {(r.doc_id, r.rank): (r.label, pytest.approx(r.prob)) for r in scoring.predict(docs, m, k, threshold).collect()}
        assert got == want and got
    got = {r.doc_id: r.v for r in spark.sql("SELECT doc_id, one_sentence_vector(text) AS v FROM asked").collect()}
    assert got == {r.doc_id: pytest.approx(r.vec) for r in scoring.sentence_vectors(docs, m).collect()}


def test_neighbours_and_vectors_of_words(spark, toy):
    m = training.train(toy, Params.unsupervised("skipgram", dim=4, epoch=2, min_count=1, minn=2, maxn=3, bucket=60, thread=1, t=1.0))
    registered.register_model(spark, m, "two")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").createOrReplaceTempView("asked")
    got = {r.doc_id: r.v for r in spark.sql("SELECT doc_id, two_sentence_vector(text) AS v FROM asked").collect()}
    assert got == {r.doc_id: pytest.approx(r.vec) for r in scoring.sentence_vectors(spark.table("asked"), m).collect()}
    words = spark.createDataFrame([("football",), ("bread",), ("footballs",), ("zq",), ("__label__food",)], "token string")
    words.createOrReplaceTempView("words")
    vectors = {r.token: r.v for r in spark.sql("SELECT token, two_word_vector(token) AS v FROM words").collect()}
    assert vectors == {r.token: pytest.approx(r.vec) for r in scoring.word_vectors(words, m).collect()}
    table = neighbors.normalized(scoring.word_vectors(m.vocabulary.words().select("token"), m), "token", "vec")
    asked = neighbors.normalized(scoring.word_vectors(words.where("token <> 'zq'"), m), "token", "vec").select(F.col("token").alias("query"), "vec", F.array("token").alias("banned"))
    want = {(r.query, r["rank"]): (r.token, pytest.approx(r.sim, abs=1e-9)) for r in neighbors.nearest(asked, table, 3, "token").collect()}
    got = {(r.query, r["rank"]): (r.token, r.sim) for r in spark.sql("SELECT w.token AS query, n.* FROM words w, LATERAL two_nn(w.token, 3) n WHERE w.token <> 'zq'").collect()}
    assert got == want
    assert spark.sql("SELECT * FROM two_nn(CAST(NULL AS STRING), 3)").count() == 0 and spark.sql("SELECT * FROM two_nn('bread', 100)").count() == m.vocabulary.nwords - 1


def test_large_models_have_their_views_only(spark, toy, monkeypatch):
    m = training.train(toy, Params.supervised(dim=4, epoch=1, thread=1))
    monkeypatch.setattr(vocabulary, "BROADCAST_ENTRIES", 0)
    registered.register_model(spark, m, "big")
    assert spark.table("big_labels").count() == 2 and spark.table("big_words").count() == m.vocabulary.nwords
    with pytest.raises(Exception, match="big_predict"):
        spark.sql("SELECT * FROM big_predict('a', 1, 0D)").collect()
