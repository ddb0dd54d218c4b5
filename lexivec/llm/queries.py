"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, interactions, licenses, lm, mixing, pii, quality, simhash, sketch, suffixes, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its leaf and tokens, and copies: how often the production mix has it."""
    mixed = mixing.count_copies(_read(spark, sf_dir, "documents"), mixing.PRODUCTION)
    return mixed.select(F.col("id").alias("doc_id"), "leaf.domain", "leaf.lang", "leaf.source", "tokens", "copies")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, read back from WARC archives: payload size and digest, record type, what it refers to."""
    found = warc.round_trip(_read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of conversation -1, read back from its windows."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.windows(rows.unionByName(own)))
    one = F.struct(
        "place",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"),
    )
    whole = back.groupBy("conv_id").agg(F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sort_array(F.collect_list(one)).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("w", lambda w: w[name]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data of every document."""
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in pii.KINDS if k not in pii.BASE),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes and runs of every document, and the digest of what is left."""
    cut = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases in every document, and the labels of phrases and rules."""
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    base = F.transform("base", lambda b: b["label"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("labels"))), ",").alias("labels"),
        F.greatest("weight", F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the cascade's verdict."""
    return quality.assess(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and how alike they are."""
    d = sketch.edited_pairs(_read(spark, sf_dir, "documents"))
    return d.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.as_text(F.col("sketch")).alias("fingerprint"),
        sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        sketch.likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
        sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        sketch.containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of every document and the bytes decoded from them, as digests."""
    import public_tokenizers

    found = bpe.round_trip(_read(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, by language."""
    return interactions.audit(interactions.cells(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from the others of its language, and the terms by which it stands out."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's log10 probability, by counts of words and by a model trained on four fifths of the documents."""
    import public_tokenizers

    coding = lm.Coding(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return lm.score(_read(spark, sf_dir, "documents"), coding).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_mixing_sources": op2_mixing_sources,
    "op3_warc": op3_warc,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_pii": op5_pii,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_source_divergence": op12_source_divergence,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing_sources": mixing.ORACLE, "op11_filter_interactions": interactions.ORACLE, "op12_source_divergence": divergence.ORACLE}
