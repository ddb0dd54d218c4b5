import io

from pyspark.sql import functions as F

from lexivec import cli
from lexivec.functions import registered
from lexivec.functions import text as T
from lexivec.operators import training
from lexivec.params import Params


def run(spark, *args):
    out = io.StringIO()
    assert cli.main(list(args), spark, out) == 0
    return out.getvalue().splitlines()


def test_command_line(spark, tmp_path):
    data = tmp_path / "train.txt"
    data.write_text("".join("__label__sport football team game\n__label__food warm bread butter\n" for _ in range(20)))
    model = str(tmp_path / "m")
    run(spark, "supervised", "-input", str(data), "-output", model, "-dim", "6", "-epoch", "6", "-lr", "0.5", "-thread", "1")
    asked = tmp_path / "ask.txt"
    asked.write_text("football game\n\nwarm butter\n")
    assert run(spark, "predict", f"{model}.bin", str(asked)) == ["__label__sport", "", "__label__food"]
    assert run(spark, "predict-prob", f"{model}.bin", str(asked), "2")[0].startswith("__label__sport ")
    assert run(spark, "test", f"{model}.bin", str(data)) == ["N\t40", "P@1\t1", "R@1\t1"]
    assert run(spark, "test-label", f"{model}.bin", str(data))[0].startswith("F1-Score : 1.000000")
    assert len(run(spark, "print-word-vectors", f"{model}.bin", str(asked))) == 4 and len(run(spark, "print-sentence-vectors", f"{model}.bin", str(asked))) == 3
    assert len(run(spark, "nn", f"{model}.bin", "football", "3")) == 3 and len(run(spark, "analogies", f"{model}.bin", "football", "game", "bread", "2")) == 2
    assert "dim 6" in run(spark, "dump", f"{model}.bin", "args") and len(run(spark, "dump", f"{model}.bin", "output")) == 2
    run(spark, "quantize", f"{model}.bin", str(data), f"{model}.ftz", "-qnorm")
    assert run(spark, "predict", f"{model}.ftz", str(asked)) == ["__label__sport", "", "__label__food"]
    assert run(spark, "print-ngrams", f"{model}.bin", "football")[0].startswith("football ")
    assert cli.main(["supervised", "-input", str(asked), "-output", model], spark) == 1
    assert cli.normalize(["-wordNgrams", "2", "-", "--x", "-1"]) == ["--wordNgrams", "2", "-", "--x", "-1"]


def test_sql_names(spark):
    registered.register_text(spark)
    words = spark.createDataFrame([("café",), ("a",), (None,)], "w string")
    words.createOrReplaceTempView("w")
    got = {r.w: r.h for r in spark.sql("select w, tv_hash(w) h from w").collect()}
    assert got == {r.w: r.h for r in words.select("w", F.when(F.col("w").isNotNull(), T.token_hash("w")).alias("h")).collect()}
    assert spark.sql("select tv_tokens('a\\tb  c') t").first().t == ["a", "b", "c"]
    grams = spark.sql("select w, gram from w, lateral tv_ngrams(w, 3, 4) where w = 'café' order by pos").collect()
    assert [r.gram for r in grams] == words.where("w = 'café'").select(T.char_ngrams("w", 3, 4).alias("g")).first().g
    docs = spark.createDataFrame([(k, "a b c") for k in range(5)], "doc_id long, text string")
    model = training.train(docs, Params.unsupervised("cbow", dim=4, epoch=1, min_count=1, minn=0, maxn=0, bucket=0, thread=1))
    registered.register_model(spark, model)
    assert spark.sql("select count(*) n from tv_words").first().n == 4
    assert len(spark.sql("select tv_word_vector('a') v").first().v) == 4
