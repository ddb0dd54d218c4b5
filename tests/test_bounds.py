"""What Python workers and readers hold doesn't grow with the input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexivec import rng, storage
from lexivec.functions import text as T
from lexivec.operators import features, quantization, training
from lexivec.operators.vocabulary import Vocabulary
from lexivec.params import Params
from lexivec.plans import queries
from lexivec.sources import binary, model_format


def batches_of(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    return df.mapInArrow(run, "rows long, bytes long").collect()


def test_batches_are_bounded_by_rows_and_by_bytes(spark, sf):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for k in keys:
        spark.conf.unset(k)
    queries.read(spark, sf, "documents")
    many = batches_of(spark.range(5000).repartition(1))
    assert sum(r.rows for r in many) == 5000 and max(r.rows for r in many) <= storage.BATCH_ROWS
    for k in keys:
        spark.conf.unset(k)
    long = spark.range(40).repartition(1).select("id", F.repeat(F.lit("a b "), 1 << 18).alias("text"))
    features.map_lists(long, [F.col("id")], T.tokens("text"), lambda lists: [lists], "fids array<string>")
    found = batches_of(long)
    assert sum(r.rows for r in found) == 40 and max(r.bytes for r in found) <= storage.BATCH_BYTES + (2 << 20)
    spark.conf.set(keys[0], "7")
    storage.small_batches(spark)
    assert spark.conf.get(keys[0]) == "7"
    spark.conf.unset(keys[0])


def test_a_dictionary_is_read_by_ranges(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"__label__{k % 3} w{k} w{k} ü{k}x") for k in range(200)], "doc_id long, text string")
    monkeypatch.setattr(training, "_lines", None)  # without epochs no line is read
    m = training.train(docs, Params.supervised(dim=4, epoch=0, min_count=1))
    path = str(tmp_path / "m.bin")
    model_format.write_model(m, path)
    monkeypatch.setattr(binary, "READ_ROWS", 64)
    reader = model_format.ModelReader(path, "entries", model_format.StructType.fromDDL(model_format._SCHEMAS["entries"]))
    parts = reader.partitions()
    assert len(parts) == -(-m.vocabulary.size // 64)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    wanted = sorted(map(tuple, m.vocabulary.entries.select("id", "token", "count", "entry_type").collect()))
    assert [tuple(r.values()) for r in rows] == wanted
    assert len(model_format.ModelReader(path, "input", model_format.StructType.fromDDL("row long")).partitions()) == -(-m.input.count() // 64)
    assert m.input.count() == m.vocabulary.nwords + m.params.bucket and m.output.count() == 3


def test_many_places_of_a_generator_are_those_of_one_after_the_other():
    seeds, places = np.array([0, 1, 7, rng.M, 9, 9]), np.array([1, 4096, 4097, 10**9 + 7, 2**41 + 5, 2])
    assert rng.uniform_at(seeds, places).tolist() == [rng.uniform(int(s), int(p), 1)[0] for s, p in zip(seeds, places, strict=True)]


def test_a_wave_fills_rounds_of_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(training.Waves, "_file", lambda *_: None)
    monkeypatch.setattr(training, "_needed", lambda lines, *_: lines)
    for thread, parts in ((cores + 1, 3 * cores), (1, 26 * cores - 1), (1, 10 * cores), (1, 1)):
        lines = spark.createDataFrame([], "part int, key long, ids array<bigint>, targets array<int>")
        p = Params.supervised(thread=thread, epoch=1)
        monkeypatch.setattr(training.Waves, "read", lambda self, name, at=None: spark.createDataFrame([], self._SCHEMAS[name]))
        w = training.Waves(lines, Vocabulary(lines, 1, 1, 1, p), parts, None)
        assert w.size % cores == 0 and w.size >= thread and w.count <= training.MOST_WAVES and (w.count - 1) * w.size < parts <= w.count * w.size


def test_a_loaded_dictionary_isnt_held_by_the_driver(spark, sf, tmp_path, monkeypatch):
    """Its entries and pairs were a list of the driver's, 300 bytes a word, and the file was written row by row there."""
    docs = spark.createDataFrame([(k, f"__label__{k % 3} w{k} w{k} ü{k}x") for k in range(200)], "doc_id long, text string")
    path = str(tmp_path / "m.bin")
    m = training.train(docs, Params.supervised(dim=4, epoch=0, min_count=1, minn=2, maxn=3, bucket=500))
    pruned = quantization.quantize(m, 2, cutoff=150)
    monkeypatch.setattr(binary, "READ_ROWS", 64)
    model_format.write_model(pruned, path)
    with monkeypatch.context() as own:
        own.setattr(type(spark), "createDataFrame", None)
        back = binary.load_binary(spark, path).model.vocabulary
        entries, pairs = back.entries.orderBy("id").collect(), back.prune.orderBy("bucket").collect()
    want = pruned.model.vocabulary
    assert entries == want.entries.orderBy("id").collect() and back.entries.rdd.getNumPartitions() == -(-want.size // 64) > 1
    assert pairs == want.prune.select("bucket", "new_id").orderBy("bucket").collect() and len(pairs) > 64
    assert (back.nwords, back.nlabels, back.ntokens) == (want.nwords, want.nlabels, want.ntokens)
    monkeypatch.setattr(binary, "save_binary", None)
    monkeypatch.setattr(queries, "_trained", lambda *_, **__: m)
    assert queries.model_round_trip(spark, sf).count() == 3
