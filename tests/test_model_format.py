"""Binary model files as a data source, and Parquet folders, of plain and quantized models."""

import os

import pytest
from pyspark.sql import functions as F

from lexivec.operators import quantization, scoring, training
from lexivec.params import Params
from lexivec.sources import binary, model_format


@pytest.fixture(scope="module")
def toy(spark):
    sport, food = "__label__sport the team won the big football game", "__label__food bake the bread with fresh warm butter"
    return spark.createDataFrame([(k, sport if k % 2 else food) for k in range(40)], "doc_id long, text string")


@pytest.fixture(scope="module")
def models(toy):
    plain = training.train(toy, Params.supervised(dim=6, epoch=2, lr=0.5, thread=1, minn=2, maxn=3, bucket=300))
    return {"plain": plain, "quantized": quantization.quantize(plain, 2, qnorm=True, qout=True), "pruned": quantization.quantize(plain, 4, cutoff=40, qnorm=False)}


def listed(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("kind", ["plain", "quantized", "pruned"])
def test_files_written_by_tasks_are_those_written_row_by_row(spark, toy, models, kind, tmp_path):
    m = models[kind]
    binary.save_binary(m, str(tmp_path / "a.bin"))
    model_format.write_model(m, str(tmp_path / "b.bin"))
    assert (tmp_path / "a.bin").read_bytes() == (tmp_path / "b.bin").read_bytes()
    assert sorted(os.listdir(tmp_path)) == ["a.bin", "b.bin"]
    model_format.write_model(models["plain"], str(tmp_path / "b.bin"))  # replaced
    back = binary.load_binary(spark, str(tmp_path / "b.bin"))
    assert listed(scoring.predict(toy, back).select("doc_id", "label")) == listed(scoring.predict(toy, models["plain"]).select("doc_id", "label"))


@pytest.mark.parametrize("kind", ["plain", "quantized", "pruned"])
def test_tables_of_a_file(spark, models, kind, tmp_path, monkeypatch):
    path = str(tmp_path / "m.bin")
    binary.save_binary(models[kind], path)
    model_format.register(spark)
    loaded = binary.load_binary(spark, path)
    m = loaded.model if kind != "plain" else loaded
    read = lambda table: spark.read.format("lexivec").option("table", table).load(path)
    assert listed(read("input")) == listed(m.input.select("fid", "vec")) and listed(read("output")) == listed(m.output.select("row", "vec"))
    assert listed(read("entries")) == listed(m.vocabulary.entries.select("id", "token", "count", "entry_type"))
    assert read("prune").count() == (m.vocabulary.prune.count() if m.vocabulary.prune is not None else 0)
    if kind == "plain":
        with pytest.raises(Exception, match="isn't quantized"):
            read("input_codes").collect()
    else:
        assert listed(read("input_codes").select("row", "codes")) == listed(loaded.input.codes.select("fid", "codes"))
        assert read("input_codes").where("norm is null").count() == (0 if kind == "quantized" else read("input_codes").count())
    with pytest.raises(Exception, match="no table"):
        read("other").collect()


def test_ranges_filters_and_columns(spark, models, tmp_path):
    path = str(tmp_path / "m.bin")
    binary.save_binary(models["plain"], path)
    schema = model_format.StructType.fromDDL("row long, vec array<float>")
    reader = model_format.ModelReader(path, "input", schema)
    assert len(reader.partitions()) == 1 and reader.matrix.rows == models["plain"].input.count()
    each, binary.READ_ROWS = binary.READ_ROWS, 50
    try:
        n = reader.matrix.rows
        assert [(p.start, p.end) for p in reader.partitions()] == [(k, min(k + 50, n)) for k in range(0, n, 50)]
        wanted = [model_format.GreaterThan(("row",), 99), model_format.LessThanOrEqual(("row",), 160), model_format.EqualTo(("other",), 3)]
        assert list(reader.pushFilters(wanted)) == wanted
        assert [(p.start, p.end) for p in reader.partitions()] == [(100, 150), (150, 161)]
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 61
        assert list(reader.pushFilters([model_format.EqualTo(("row",), 5)])) and [(p.start, p.end) for p in reader.partitions()] == [(0, 0)]
    finally:
        binary.READ_ROWS = each
    few = model_format.ModelReader(path, "input", model_format.StructType.fromDDL("row long"))
    few.matrix.at = 10**12  # vectors aren't read
    assert next(few.read(few.partitions()[0])).num_rows == few.matrix.rows
    model_format.register(spark)
    got = spark.read.format("lexivec").option("table", "input").load(path).where("row >= 7 and row < 9")
    assert listed(got) == listed(models["plain"].input.where("fid in (7, 8)").select("fid", "vec"))


def test_a_failed_write_leaves_no_file_and_a_repeated_attempt_no_rows(spark, models, tmp_path):
    path = str(tmp_path / "m.bin")
    rows = model_format.model_rows(models["plain"])
    broken = rows.withColumn("count", F.when((F.col("section") == 0) & (F.col("row") == 3), F.raise_error(F.lit("broken"))).otherwise(F.col("count")))
    model_format.register(spark)
    with pytest.raises(Exception, match="broken"):
        broken.repartitionByRange(3, "section", "row").sortWithinPartitions("section", "row").write.format("lexivec").option("facts", "{}").mode("append").save(path)
    assert not os.path.exists(path)
    # the same task twice: the part of the first attempt is there, but isn't in the commit
    binary.save_binary(models["plain"], str(tmp_path / "want.bin"))
    p = models["plain"].params
    v = models["plain"].vocabulary
    facts = {"params": model_format.base64.b64encode(binary.pack_params(p)).decode(), "dim": p.dim, "nwords": v.nwords, "nlabels": v.nlabels, "ntokens": v.ntokens, "pruned": False}
    writer = model_format.ModelWriter(path, facts)
    table = rows.orderBy("section", "row").toArrow()
    halves = [table.slice(0, 20), table.slice(20)]
    writer.write(iter(halves[0].to_batches()))
    second, first = writer.write(iter(halves[1].to_batches())), writer.write(iter(halves[0].to_batches()))
    writer.commit([second, None, first])
    assert open(path, "rb").read() == open(tmp_path / "want.bin", "rb").read()


@pytest.mark.parametrize("kind", ["plain", "quantized", "pruned"])
def test_parquet_folders(spark, toy, models, kind, tmp_path):
    m, path = models[kind], str(tmp_path / "folder")
    binary.save(m, path)
    back = binary.load(spark, path)
    assert type(back) is type(m)
    if kind == "plain":
        assert listed(back.input) == listed(m.input)
    else:
        assert listed(back.input.codes) == listed(m.input.codes) and back.bytes() == m.bytes() and (back.output is None) == (m.output is None)
    whole = lambda x: x if kind == "plain" else x.as_model()
    assert listed(scoring.predict(toy, whole(back))) == listed(scoring.predict(toy, whole(m)))
