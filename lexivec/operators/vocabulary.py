"""Vocabularies: counts, thresholds, ranks, sub-sampling, look-up and pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument
from ..functions import hashing as H
from ..functions import text as T
from ..params import ModelKind, Params
from ..storage import cut, small_batches

WORD, LABEL = 0, 1
#: Vocabularies up to this many entries (about 100 bytes each) are broadcast in look-ups; larger ones are joined by shuffle.
BROADCAST_ENTRIES = 500_000
#: Different tokens that a task counts before it gives them on.
COUNTED = 1_000_000


def explode_tokens(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), tokenizer=T.tokens) -> DataFrame:
    """A row (*keep, pos, token) for each token."""
    return docs.select(*keep, F.posexplode(tokenizer(text_col)).alias("pos", "token"))


def count_tokens(tokens: DataFrame, label_prefix: str = "__label__") -> DataFrame:
    """(token, count, entry_type) of a column ``token``; counted in each task first."""
    return _typed(tokens.groupBy("token").agg(F.count("*").alias("count")), label_prefix)


def _typed(counts: DataFrame, label_prefix: str) -> DataFrame:
    return counts.withColumn("entry_type", F.when(T.is_label("token", label_prefix), F.lit(LABEL)).otherwise(F.lit(WORD)).cast("byte"))


def count_lines(docs: DataFrame, label_prefix: str = "__label__", text_col: str = "text") -> DataFrame:
    """(token, count, entry_type) of texts, each a line that ends with </s>. Whole batches are taken apart and counted in tasks, which hold at most about COUNTED different tokens."""

    def summed(held: list[tuple[pa.Array, pa.Array]]) -> pa.Table:
        tokens, counts = zip(*held, strict=True)
        return pa.table({"token": pa.concat_arrays(tokens), "count": pa.concat_arrays(counts)}).group_by("token").aggregate([("count", "sum")]).rename_columns(["token", "count"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            words = T.token_lists(batch.column(0), "always").values
            n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
            held.append((words.dictionary.filter(pa.array(n > 0)), pa.array(n[n > 0])))
            size += len(held[-1][0])
            if size > COUNTED:
                whole = summed(held)
                held, size = [], 0
                if whole.num_rows > COUNTED // 2:
                    yield from whole.to_batches(50_000)
                else:
                    held, size = [(whole["token"].combine_chunks(), whole["count"].combine_chunks())], whole.num_rows
        if held:
            yield from summed(held).to_batches(50_000)

    small_batches(docs.sparkSession)
    each = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token string, count long")
    return _typed(each.groupBy("token").agg(F.sum("count").alias("count")), label_prefix)


def threshold(counts: DataFrame, min_count: int, min_count_label: int = 0) -> DataFrame:
    return counts.where(F.when(F.col("entry_type") == LABEL, F.col("count") >= min_count_label).otherwise(F.col("count") >= min_count))


def dense_index(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """df with ``name``: the place of each row in the order, from 0.

    Rows are ranged over partitions, numbered within each and shifted by the sizes of the
    partitions before, so no task holds more than its range. The order must be total.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a partition
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (own + F.col("_before")).alias(name))


def rank(counts: DataFrame) -> DataFrame:
    """counts with ``id``: words before labels, frequent ones first, ties by token."""
    return dense_index(counts, [F.col("entry_type"), F.col("count").desc(), F.col("token")]).select(F.col("id").cast("int").alias("id"), "token", "count", "entry_type")


@dataclass
class Lookup:
    """A small vocabulary in tasks: the token of id k is at place k."""

    held: Broadcast
    nwords: int
    params: Params

    def ids(self, tokens: pa.Array) -> np.ndarray:
        """The ids of tokens, -1 for unknown ones."""
        return pc.index_in(tokens, value_set=self.held.value[0]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def hashed(self, offsets: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of the row ids of buckets; if the model is pruned, without those that are gone."""
        pruned = self.held.value[1]
        if pruned is None:
            return offsets, buckets + self.nwords
        own, new = pruned
        at = np.searchsorted(own, buckets).clip(max=max(len(own) - 1, 0))
        good = own[at] == buckets if len(own) else np.zeros(len(buckets), bool)
        return H.kept(offsets, (new[at] if len(own) else buckets) + self.nwords, good)

    def subwords(self, tokens: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, row ids): each token's own if it is known, then its n-grams'; the end of line has none of these."""
        p = self.params
        own = np.concatenate(([0], np.cumsum(ids >= 0))), ids[ids >= 0]
        if p.bucket <= 0 or p.maxn <= 0:
            return own
        of, h = H.char_ngrams(tokens, p.minn, p.maxn)
        eos = pc.equal(tokens, T.EOS).to_numpy(zero_copy_only=False)
        good = ~eos[of]
        counts = np.bincount(of[good], minlength=len(tokens))
        return H.joined([own, self.hashed(np.concatenate(([0], np.cumsum(counts))), h[good] % p.bucket)])


@dataclass
class PartLookup(Lookup):
    """The entries of a part's own tokens, from a vocabulary of any size that isn't pruned: tokens (held) and their ids."""

    own: np.ndarray

    def ids(self, tokens: pa.Array) -> np.ndarray:
        at = pc.index_in(tokens, value_set=self.held).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.concatenate((self.own, [-1])).astype(np.int64)[at]

    def hashed(self, offsets: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return offsets, buckets + self.nwords


@dataclass
class Vocabulary:
    """entries: id, token, count, entry_type; stats: one row of nwords, nlabels, ntokens, size.

    prune: None, or a table (bucket, new_id) of the hashed n-grams kept.
    """

    entries: DataFrame
    nwords: int
    nlabels: int
    ntokens: int
    params: Params
    prune: DataFrame | None = None

    @property
    def size(self) -> int:
        return self.nwords + self.nlabels

    def words(self) -> DataFrame:
        return self.entries.where(F.col("entry_type") == WORD)

    def labels(self) -> DataFrame:
        """label_id (from 0), token, count."""
        return self.entries.where(F.col("entry_type") == LABEL).select((F.col("id") - self.nwords).alias("label_id"), "token", "count")

    def id_of(self, token: str) -> int | None:
        row = self.entries.where(F.col("token") == token).select("id").first()
        return row[0] if row else None

    def for_tasks(self) -> Lookup | None:
        """Tokens and pruned buckets as arrays for all tasks, if there are at most BROADCAST_ENTRIES of each; else None."""
        if self.size > BROADCAST_ENTRIES or (self.prune is not None and self.prune.limit(BROADCAST_ENTRIES + 1).count() > BROADCAST_ENTRIES):
            return None
        spark = self.entries.sparkSession
        own = self.entries.select("id", "token").toArrow().sort_by("id").combine_chunks()
        if own.num_rows and own["id"][-1].as_py() != own.num_rows - 1:
            return None
        pairs = None if self.prune is None else self.prune.select(F.col("bucket").cast("long"), F.col("new_id").cast("long")).toArrow().sort_by("bucket")
        pruned = None if pairs is None else (pairs["bucket"].to_numpy(), pairs["new_id"].to_numpy())
        return Lookup(spark.sparkContext.broadcast((own["token"].combine_chunks(), pruned)), self.nwords, self.params)

    def for_lookup(self) -> DataFrame:
        """(token, id, entry_type), to be broadcast if it is small."""
        own = self.entries.select("token", "id", "entry_type")
        return F.broadcast(own) if self.size <= BROADCAST_ENTRIES else own


def build(docs: DataFrame, params: Params, text_col: str = "text", tokenizer=T.tokens) -> Vocabulary:
    """The vocabulary of a corpus: exact counts, thresholds of params, ids by rank.

    Each document is one line and ends with an end-of-line token, as lines in training do.
    """
    if tokenizer is T.tokens:
        made = count_lines(docs, params.label, text_col)
    else:
        made = count_tokens(explode_tokens(docs, text_col, tokenizer=lambda c: F.concat(tokenizer(c), F.array(F.lit(T.EOS)))), params.label)
    counts = cut(made)
    ntokens = counts.agg(F.sum("count")).first()[0] or 0
    entries = cut(rank(threshold(counts, params.min_count, params.min_count_label)))
    sizes = dict(entries.groupBy("entry_type").count().collect())  # two rows
    if not sizes:
        raise InvalidArgument("empty vocabulary: lower min_count")
    return Vocabulary(entries, sizes.get(WORD, 0), sizes.get(LABEL, 0), ntokens, params)


def keep_probability(count, ntokens, t: float):
    """Chance to keep a word in sub-sampling: sqrt(t / f) + t / f of its frequency f; may exceed 1."""
    ratio = F.lit(float(t)) / (count / ntokens)
    return F.sqrt(ratio) + ratio


def cumulated(table: DataFrame, id_col: str, value: str, block: int = 4096) -> DataFrame:
    """table with ``below``: the sum of ``value`` over all smaller ids. Sums of blocks of ids are summed up first, so no task gets more than a block of rows, or a row a block."""
    dealt = table.withColumn("_block", F.floor(F.col(id_col) / block))
    sums = dealt.groupBy("_block").agg(F.sum(value).alias("_held"))
    before = sums.select("_block", F.coalesce(F.sum("_held").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return dealt.withColumn("_inside", inside).join(before, "_block").withColumn("below", F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def negative_chances(entries: DataFrame) -> DataFrame:
    """(id, chance, low, high): the chance that an entry (id, count) is drawn as a negative, by the square root of its count, and its part of 0 to 1."""
    rooted = cut(entries.select("id", F.sqrt("count").alias("root")))
    total = rooted.agg(F.sum("root")).first()[0] or 1.0
    c = cumulated(rooted, "id", "root")
    return c.select("id", (F.col("root") / total).alias("chance"), (F.col("below") / total).alias("low"), ((F.col("below") + F.col("root")) / total).alias("high"))


def subsample(tokens: DataFrame, vocabulary: Vocabulary, seed: int = 0) -> DataFrame:
    """Rows (.., token) of in-vocabulary words that survive; all for supervised models."""
    if vocabulary.params.model == ModelKind.SUPERVISED:
        return tokens
    own = vocabulary.words().select("token", keep_probability(F.col("count"), F.lit(vocabulary.ntokens), vocabulary.params.t).alias("_p"))
    hint = F.broadcast(own) if vocabulary.size <= BROADCAST_ENTRIES else own
    return tokens.join(hint, "token").where(F.rand(seed) <= F.col("_p")).drop("_p")


def prune(vocabulary: Vocabulary, kept_rows: DataFrame) -> Vocabulary:
    """The vocabulary with the input rows of kept_rows (fid): its words, all labels, and the n-gram buckets renumbered.

    Words keep their order; buckets are numbered in the order of their ids.
    """
    nwords = vocabulary.nwords
    words = vocabulary.words().join(kept_rows.select(F.col("fid").alias("id")).distinct(), "id", "left_semi")
    entries = cut(rank(words.select("token", "count", "entry_type").unionByName(vocabulary.entries.where(F.col("entry_type") == LABEL).select("token", "count", "entry_type"))))
    buckets = kept_rows.where(F.col("fid") >= nwords).select((F.col("fid") - nwords).alias("bucket")).distinct()
    table = cut(dense_index(buckets, [F.col("bucket")], "new_id"))
    return Vocabulary(entries, words.count(), vocabulary.nlabels, vocabulary.ntokens, vocabulary.params, table)
