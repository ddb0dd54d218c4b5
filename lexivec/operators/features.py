"""From documents to arrays of feature ids: words, character n-grams, word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import hashing as H
from ..functions import text as T
from ..storage import cut, small_batches
from .vocabulary import BROADCAST_ENTRIES, WORD, Lookup, PartLookup, Vocabulary

#: Items (tokens or row ids) of the rows of a part that are looked up together in a large table, on average.
PART_ITEMS = 1_000_000
#: Bytes of a text for each of its tokens, about.
TOKEN_BYTES = 7


def with_hashed(rows: DataFrame, key: str, buckets: Column, vocabulary: Vocabulary, name: str) -> DataFrame:
    """rows with ``name``: row ids of an array of buckets, in its order; with a prune table renumbered, others dropped.

    The table may be large, so it is joined; each value of ``key`` must have one array.
    """
    if vocabulary.prune is None:
        return rows.withColumn(name, F.transform(buckets, lambda g: g + vocabulary.nwords))
    each = rows.select(F.col(key).alias("_key"), buckets.alias("_g")).dropDuplicates(["_key"]).select("_key", F.posexplode("_g").alias("_at", "bucket"))
    kept = each.join(vocabulary.prune.select("bucket", "new_id"), "bucket").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "new_id"))).alias("_kept"))
    ids = F.transform(F.coalesce("_kept", F.array().cast("array<struct<_at:int,new_id:bigint>>")), lambda x: x["new_id"].cast("long") + vocabulary.nwords)
    return rows.join(kept, F.col(key) == F.col("_key"), "left").withColumn(name, ids).drop("_key", "_kept")


def subwords(vocabulary: Vocabulary) -> DataFrame:
    """entries with ``subwords``: own id, then the ids of its character n-grams (none for the end of line)."""
    p = vocabulary.params
    grams = F.col("_grams")
    own = F.array(F.col("id").cast("long"))
    return with_hashed(vocabulary.entries, "token", T.ngram_ids("token", p.minn, p.maxn, p.bucket), vocabulary, "_grams").withColumn("subwords", F.when(F.col("token") == T.EOS, own).otherwise(F.concat(own, grams))).drop("_grams")


def subwords_of(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """tokens (.., token) with ``id`` (null if unknown) and ``subwords``; unknown tokens have their n-grams only."""
    p = vocabulary.params
    joined = tokens.join(vocabulary.for_lookup(), "token", "left")
    if p.maxn > 0:
        joined = with_hashed(joined, "token", T.ngram_ids("token", p.minn, p.maxn, p.bucket), vocabulary, "_grams")
    grams = F.col("_grams")
    own = F.when(F.col("id").isNotNull(), F.array(F.col("id").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ids = F.when(F.col("token") == T.EOS, own).otherwise(F.concat(own, grams))
    return joined.withColumn("subwords", ids if p.maxn > 0 else own).drop("_grams")


def ngram_strings(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(token, pos, gram, fid): the word itself if known, then its n-grams as text."""
    p = vocabulary.params
    joined = tokens.join(vocabulary.for_lookup(), "token", "left").withColumn("_grams", T.char_ngrams("token", p.minn, p.maxn)).withColumn("_hashes", T.token_hashes("_grams"))
    grams = F.zip_with("_grams", "_hashes", lambda g, h: F.struct(g.alias("gram"), (F.pmod(h, F.lit(max(p.bucket, 1)).cast("long")) + vocabulary.nwords).alias("fid")))
    own = F.when(F.col("id").isNotNull(), F.array(F.struct(F.col("token").alias("gram"), F.col("id").cast("long").alias("fid")))).otherwise(F.array().cast("array<struct<gram:string,fid:bigint>>"))
    every = F.when((F.col("token") == T.EOS) | F.lit(p.bucket <= 0), own).otherwise(F.concat(own, grams))
    rows = joined.select("token", F.posexplode(every).alias("pos", "g")).select("token", "pos", "g.gram", "g.fid")
    return rows if vocabulary.prune is None else apply_prune(rows, vocabulary.nwords, vocabulary.prune).select("token", "pos", "gram", "fid")


def apply_prune(features: DataFrame, nwords: int, table: DataFrame) -> DataFrame:
    """Rows (.., fid) with hashed ids renumbered by a prune table (bucket, new_id); others than words are dropped."""
    joined = features.join(table.select((F.col("bucket") + nwords).alias("fid"), "new_id"), "fid", "left")
    return joined.withColumn("fid", F.when(F.col("fid") < nwords, F.col("fid")).otherwise(F.col("new_id") + nwords)).where("fid is not null").drop("new_id")


def line_lists(lists: pa.Array, look: Lookup, eos: bool) -> tuple[pa.Array, pa.Array]:
    """(fids, labels) of lists of tokens, for a batch; each different token is looked up and taken apart once."""
    p, nwords = look.params, look.nwords
    offsets, words = H.list_parts(lists)
    coded = words.dictionary_encode()
    tokens, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    ids = look.ids(tokens)
    label = np.where(ids >= 0, ids >= nwords, pc.starts_with(tokens, p.label).to_numpy(zero_copy_only=False))
    at, subs = look.subwords(tokens, np.where(label, -1, ids))
    sizes = np.where(label, 0, np.diff(at))
    each = sizes[code]
    parts = [(np.concatenate(([0], np.cumsum(each)))[offsets], subs[H.ranges(at[:-1][code], each)])]
    if p.word_ngrams > 1 and p.bucket > 0:
        hashes = H.fnv1a(*H.utf8(tokens))
        own, rolled = H.kept(offsets, hashes[code], ~label[code])
        parts.append(look.hashed(*H.word_ngrams(own, rolled, p.word_ngrams, p.bucket)))
    if eos and (own := look.ids(pa.array([T.EOS]))[0]) >= 0:
        some = sum(np.diff(o) for o, _ in parts) > 0
        parts.append((np.concatenate(([0], np.cumsum(some))), np.full(int(some.sum()), own, np.int64)))
    known = (label & (ids >= nwords))[code]
    found = H.kept(offsets, (ids - nwords)[code], known)
    return H.to_lists(*H.joined(parts)), H.to_lists(found[0], found[1].astype(np.int32))


def map_lists(docs: DataFrame, keys: list[Column], tokens: Column, use, fields: str) -> DataFrame:
    """(keys as key, *use(lists of tokens, or what else the column has)) in batches of at most 1000 rows; no row is dropped, added or moved."""
    small_batches(docs.sparkSession)
    named = docs.select(F.struct(*keys).alias("key"), tokens.alias("tokens"))
    schema = f"key {named.schema['key'].dataType.simpleString()}, {fields}"
    names = ["key", *StructType.fromDDL(fields).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *use(part.column(1))], names=names)

    return named.mapInArrow(run, schema).select("key.*", *names[1:])


def by_parts(rows: DataFrame, key: list[Column], source: Column, items, table: DataFrame, use, fields: str, also: Column | None = None) -> DataFrame:
    """(key, *fields): use(rows (key, items) of a part, what its items have in the table) for all parts, all Arrow tables; table: (item, ..), an item once.

    For tables that no task can hold. items(source) is an array. Rows are dealt by the hash of
    key and source to parts of about PART_ITEMS items, and must be the same when they are
    read again; each different item of a part meets the table once, and a part
    gets what its own items have there: an item's repeats in a part aren't shuffled. also:
    an item that every part asks for.
    """
    named = rows.select(F.struct(*key).alias("key"), source.alias("source"))
    total = named.agg(F.sum(F.size(items(F.col("source"))))).first()[0] or 0
    parts = max(1, -(-int(total) // PART_ITEMS))
    dealt = named.withColumn("part", F.pmod(F.xxhash64("key", "source"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part")).select("part", "key", items(F.col("source")).alias("items"))
    asked = dealt.select("part", F.explode("items" if also is None else F.concat("items", F.array(also))).alias("item")).distinct()
    found = asked.join(table, "item").withColumnRenamed("part", "of").repartitionById(parts, F.col("of"))
    schema = StructType([named.schema["key"], *StructType.fromDDL(fields).fields])
    return dealt.groupBy("part").cogroup(found.groupBy("of")).applyInArrow(use, schema)


def by_lookups(docs: DataFrame, keys: list[Column], text: Column, tokens, end: str, vocabulary: Vocabulary, use, fields: str) -> DataFrame:
    """map_lists for a vocabulary that is too large for tasks and not pruned: use(lists of tokens(text), look-up of their part).

    Texts are dealt to parts as in by_parts. tokens: None, which takes texts apart in tasks
    as T.token_lists does with ``end``; or a function of a column.
    """
    names, nwords, params = ["key", *StructType.fromDDL(fields).names], vocabulary.nwords, vocabulary.params

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        look = PartLookup(found["item"].combine_chunks(), nwords, params, found["id"].to_numpy())
        lists = lambda b: T.token_lists(b.column("source"), end) if tokens is None else b.column("items")
        made = [pa.RecordBatch.from_arrays([b.column("key"), *use(lists(b), look)], names=names) for b in rows.to_batches(1000)]
        return pa.Table.from_batches(made)

    table = vocabulary.entries.select(F.col("token").alias("item"), F.col("id").cast("long").alias("id"))
    if tokens is not None:
        return by_parts(docs, keys, text, tokens, table, run, fields, F.lit(T.EOS)).select("key.*", *names[1:])
    small_batches(docs.sparkSession)
    named = docs.select(F.struct(*keys).alias("key"), text.alias("source"))
    size = named.agg(F.sum(F.octet_length("source"))).first()[0] or 0
    parts = max(1, -(-int(size) // (PART_ITEMS * TOKEN_BYTES)))
    dealt = named.withColumn("part", F.pmod(F.xxhash64("key", "source"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has one part, or a few small ones
        seen: dict[int, pa.Array] = {}
        for batch in batches:
            of = batch.column(0).to_numpy()
            for part in np.unique(of).tolist():
                own = T.token_lists(batch.column(1).filter(pa.array(of == part)), "unless").values.dictionary
                seen[part] = pc.unique(pa.concat_arrays([seen[part], own])) if part in seen else own
        for part, own in seen.items():
            for start in range(0, len(own), 50_000):
                some = own.slice(start, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), some], names=["part", "item"])

    asked = dealt.select("part", "source").mapInArrow(ask, "part int, item string")
    found = asked.join(table, "item").withColumnRenamed("part", "of").repartitionById(parts, F.col("of"))
    schema = StructType([named.schema["key"], *StructType.fromDDL(fields).fields])
    return dealt.select("part", "key", "source").groupBy("part").cogroup(found.groupBy("of")).applyInArrow(run, schema).select("key.*", *names[1:])


def line_features(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", eos: bool = True, eos_in_ngrams: bool = False, tokenizer=T.tokens) -> DataFrame:
    """(id_col, fids array<bigint>, labels array<int>), a row for each row of docs: features in the order of its tokens, then word n-grams.

    Tokens that look like labels give label ids if known; unknown words give n-grams only.
    With ``eos`` the end-of-line row is added if the document has any feature (training
    adds it always, and with eos_in_ngrams its hash takes part in word n-grams). Null
    texts have no tokens; null and repeated ids are rows of their own. A small vocabulary
    is looked up in each task, without a shuffle; for a large one each part of the rows
    gets the entries of its own tokens; with a large prune table tokens are joined and rows
    are put together again by their own numbers.
    """
    listed = lambda c: F.concat(tokenizer(c), F.array(F.lit(T.EOS))) if eos_in_ngrams else tokenizer(c)
    tokens, plain, end = listed(text_col), tokenizer is T.tokens, "always" if eos_in_ngrams else ""
    look = vocabulary.for_tasks()
    if look is not None:
        add = eos and not eos_in_ngrams
        return map_lists(docs, [F.col(id_col)], F.col(text_col) if plain else tokens, lambda lists: line_lists(T.token_lists(lists, end) if plain else lists, look, add), "fids array<bigint>, labels array<int>")
    if vocabulary.prune is None:
        add = eos and not eos_in_ngrams
        return by_lookups(docs, [F.col(id_col)], F.col(text_col), None if plain else listed, end, vocabulary, lambda lists, own: line_lists(lists, own, add), "fids array<bigint>, labels array<int>")
    return _joined_features(docs.select(F.col(id_col).alias("_id"), tokens.alias("_tokens")), vocabulary, eos and not eos_in_ngrams).withColumnRenamed("_id", id_col)


def _joined_features(named: DataFrame, vocabulary: Vocabulary, eos: bool) -> DataFrame:
    p, nwords = vocabulary.params, vocabulary.nwords
    rows = named.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_id", F.posexplode_outer("_tokens").alias("pos", "token"))
    if p.word_ngrams > 1 and p.bucket > 0:
        rows = rows.withColumn("_hash", T.token_hash("token"))
    known = subwords_of(rows, vocabulary)
    label = F.coalesce(F.col("entry_type") != WORD, T.is_label("token", p.label), F.lit(False))
    # a text without tokens has one row, of a null token, which is no word
    word = ~label & F.col("token").isNotNull()
    hashed = F.when(word, F.col("_hash")) if p.word_ngrams > 1 and p.bucket > 0 else F.lit(None).cast("bigint")
    each = F.struct("pos", F.when(word, F.col("subwords")).alias("ids"), hashed.alias("hash"), F.when(label & F.col("id").isNotNull(), F.col("id") - nwords).alias("label"))
    lines = known.groupBy("_row").agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(each)).alias("w"))
    pick = lambda name: F.filter(F.transform("w", lambda x: x[name]), lambda x: x.isNotNull())
    ids = F.flatten(pick("ids"))
    if p.word_ngrams > 1 and p.bucket > 0:
        lines = with_hashed(cut(lines), "_row", T.word_ngram_ids(pick("hash"), p.word_ngrams, p.bucket), vocabulary, "_spans")
        ids = F.concat(ids, "_spans")
    made = lines.select("_id", ids.alias("fids"), pick("label").alias("labels"))
    if eos and (own := vocabulary.id_of(T.EOS)) is not None:
        made = made.withColumn("fids", F.when(F.size("fids") > 0, F.concat("fids", F.array(F.lit(own).cast("long")))).otherwise(F.col("fids")))
    return made


def context_pairs(lines: DataFrame, window: int, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, pos, center, context) of arrays of word ids within a fixed window, the centre left out."""
    # each place of a line has its own short list, so no row carries the whole line
    ids = F.col(ids_col)
    near = lambda i: F.concat(F.slice(ids, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), F.slice(ids, i + 2, F.lit(window)))
    spread = lines.select(id_col, F.posexplode(F.transform(ids, lambda x, i: F.struct(x.alias("center"), near(i).alias("near")))).alias("pos", "_at"))
    return spread.select(id_col, "pos", F.col("_at.center").alias("center"), F.explode("_at.near").alias("context"))


__all__ = ["BROADCAST_ENTRIES", "apply_prune", "by_lookups", "by_parts", "context_pairs", "line_features", "line_lists", "map_lists", "ngram_strings", "subwords", "subwords_of", "with_hashed"]
