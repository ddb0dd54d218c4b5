"""Registered queries over the driver's tables, each with the same result in DuckDB SQL where SQL can say it.

Trained weights can't be told in SQL, so scoring is checked on a model that is made from
the tables: input row h is the embedding of vec_id h, a token's row is its hash modulo the
number of embeddings, and a label's output row is the mean embedding of its label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..operators import features, frequent, kernels, metrics, neighbors, quantization, scoring, training, vocabulary
from ..params import LossKind, Params
from ..storage import fresh_dir, small_batches, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM, BUCKET, MINN, MAXN, MIN_COUNT, LABELS = 64, 100_000, 3, 6, 5, 10


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; documents of a small file, which may be a single split, are dealt to all cores."""
    small_batches(spark)
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(found) if table == "documents" else found


# --- pieces of SQL -----------------------------------------------------------------

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\f\r]+'), lambda x: x <> '')"
TOKENS = f"d AS (SELECT doc_id, CASE WHEN list_contains({_SPLIT}, '</s>') THEN {_SPLIT}[1:list_position({_SPLIT}, '</s>')] ELSE {_SPLIT} END AS t FROM documents)"
EACH = f"{TOKENS}, e AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM d)"
COUNTS = f"{EACH}, c AS (SELECT token, count(*)::BIGINT AS count FROM (SELECT token FROM e UNION ALL SELECT '</s>' FROM documents) GROUP BY token)"
VOCAB = f"{COUNTS}, v AS (SELECT (row_number() OVER (ORDER BY count DESC, token) - 1)::INT AS id, token, count FROM c WHERE count >= {MIN_COUNT})"


def sql_hash(x: str) -> str:
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex({x}), {at}, 1)) - 1)"
    byte = f"({digit('2 * i - 1')} * 16 + {digit('2 * i')})"
    return f"list_reduce(list_prepend({T.FNV_START}::BIGINT, list_transform(range(1, strlen({x}) + 1), lambda i: {byte}::BIGINT)), lambda h, b: (xor(h, CASE WHEN b > 127 THEN b | 4294967040 ELSE b END) * {T.FNV_PRIME}) & 4294967295)"


_MARKED = "'<' || token || '>'"
GRAMS = (
    f"g AS (SELECT token, id, i, n, substr({_MARKED}, i, n) AS gram FROM (SELECT token, id, unnest(range(1, length(token) + 3)) AS i FROM v), range({MINN}, {MAXN + 1}) r(n) WHERE i + n - 1 <= length(token) + 2)"
)
HASHED = f"h AS (SELECT token, {sql_hash('token')} AS hash FROM (SELECT DISTINCT token FROM e))"


def vocab(spark: SparkSession, sf_dir: str, **given) -> vocabulary.Vocabulary:
    p = Params.supervised(**{"min_count": MIN_COUNT, "dim": DIM, **given})
    return vocabulary.build(read(spark, sf_dir, "documents"), p)


# --- tokens and vocabulary -----------------------------------------------------------


@query(f"WITH {TOKENS} SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM d")
def tokenize(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
t AS (SELECT doc_id, k, list_concat(list_filter(regexp_split_to_array(line, '[ \t\v\f\x00\r]+'), lambda x: x <> '')[1:1024], CASE WHEN k < n - 1 THEN ['</s>'] ELSE [] END) AS t FROM l)
SELECT doc_id, sum(len(t))::INT AS n_tokens, md5(array_to_string(flatten(list(t ORDER BY k)), ' ')) AS tokens_md5 FROM t GROUP BY doc_id""")
def tokenize_corpus(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", T.corpus_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""")
def tokenize_simple(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", T.simple_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH {EACH} SELECT token, count(*)::BIGINT AS n FROM e GROUP BY token")
def token_counts(spark, sf_dir):
    return vocabulary.count_tokens(vocabulary.explode_tokens(read(spark, sf_dir, "documents"))).select("token", F.col("count").alias("n"))


@query(f"WITH {COUNTS} SELECT token, count AS n FROM c WHERE count >= {MIN_COUNT} AND token <> '</s>'")
def vocab_threshold(spark, sf_dir):
    counts = vocabulary.count_tokens(vocabulary.explode_tokens(read(spark, sf_dir, "documents")))
    return vocabulary.threshold(counts, MIN_COUNT).select("token", F.col("count").alias("n"))


@query(f"WITH {VOCAB} SELECT id, token, count AS n FROM v")
def vocab_rank(spark, sf_dir):
    return vocab(spark, sf_dir).entries.select("id", "token", F.col("count").alias("n"))


@query(f"WITH {VOCAB} SELECT (SELECT count(*) FROM v)::BIGINT AS nwords, 0::BIGINT AS nlabels, (SELECT sum(count) FROM c)::BIGINT AS ntokens")
def dict_stats(spark, sf_dir):
    v = vocab(spark, sf_dir)
    return spark.createDataFrame([(v.nwords, v.nlabels, v.ntokens)], "nwords long, nlabels long, ntokens long")


@query(f"WITH {EACH} SELECT token, count(*)::BIGINT AS n, starts_with(token, '__label__') AS is_label FROM (SELECT '__label__' || lang AS token FROM documents WHERE lang IS NOT NULL UNION ALL SELECT token FROM e) GROUP BY token HAVING count(*) >= {MIN_COUNT} OR starts_with(token, '__label__')")
def label_split(spark, sf_dir):
    docs = labelled(read(spark, sf_dir, "documents"))
    counts = vocabulary.threshold(vocabulary.count_tokens(vocabulary.explode_tokens(docs)), MIN_COUNT)
    return counts.select("token", F.col("count").alias("n"), (F.col("entry_type") == vocabulary.LABEL).alias("is_label"))


def labelled(docs: DataFrame, column: str = "lang") -> DataFrame:
    """docs with the label of a column put before the text."""
    return docs.withColumn("text", F.concat_ws(" ", F.concat(F.lit("__label__"), F.col(column)), "text"))


@query(f"WITH {EACH}, c AS (SELECT token, count(*)::BIGINT AS count FROM e GROUP BY token) SELECT token, count FROM c WHERE count > (SELECT sum(count) FROM c) / 200")
def frequent_tokens(spark, sf_dir):
    """Tokens that are over a two-hundredth of all: found with 800 counters a task, then counted."""
    tokens = vocabulary.explode_tokens(read(spark, sf_dir, "documents"))
    near = frequent.frequent(tokens, 800)  # at most 800 tokens
    counts = tokens.join(F.broadcast(near.select("token")), "token").groupBy("token").agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(tokens.agg(F.count("*").alias("total")))).where("count > total / 200").select("token", "count")


@query(f"WITH {VOCAB}, s AS (SELECT sum(count)::DOUBLE AS n FROM c) SELECT token, round(sqrt(1e-4 / (count / n)) + 1e-4 / (count / n), 6) AS p FROM v, s")
def keep_probability(spark, sf_dir):
    v = vocab(spark, sf_dir)
    return v.words().select("token", F.round(vocabulary.keep_probability(F.col("count"), F.lit(v.ntokens), 1e-4), 6).alias("p"))


@query(f"WITH {VOCAB}, z AS (SELECT id, sqrt(count) AS r, sum(sqrt(count)) OVER () AS z, sum(sqrt(count)) OVER (ORDER BY id) AS upto FROM v) SELECT id, round(r / z, 9) AS chance, round(upto / z, 6) AS high FROM z")
def ns_table(spark, sf_dir):
    """The distribution that training draws negatives from."""
    found = vocabulary.negative_chances(vocab(spark, sf_dir).words())
    return found.select("id", F.round("chance", 9).alias("chance"), F.round("high", 6).alias("high"))


@query(f"WITH {VOCAB}, k AS (SELECT id, token, count FROM v WHERE count >= 20 OR token = '</s>') SELECT (row_number() OVER (ORDER BY count DESC, token) - 1)::INT AS new_id, token FROM k")
def prune_words(spark, sf_dir):
    v = vocab(spark, sf_dir)
    kept = v.words().where((F.col("count") >= 20) | (F.col("token") == T.EOS)).select(F.col("id").cast("long").alias("fid"))
    return vocabulary.prune(v, kept).words().select(F.col("id").alias("new_id"), "token")


# --- hashes and n-grams --------------------------------------------------------------


@query(f"WITH {EACH}, {HASHED} SELECT token, hash FROM h")
def token_hash(spark, sf_dir):
    tokens = vocabulary.explode_tokens(read(spark, sf_dir, "documents")).select("token").distinct()
    return tokens.select("token", T.token_hash("token").alias("hash"))


@query(f"WITH {VOCAB}, {GRAMS} SELECT v.token, count(gram)::INT AS n, md5(coalesce(string_agg(gram, ' ' ORDER BY i, n), '')) AS grams_md5 FROM v LEFT JOIN g USING (token) GROUP BY v.token")
def char_ngrams(spark, sf_dir):
    grams = vocab(spark, sf_dir).words().select("token", T.char_ngrams("token", MINN, MAXN).alias("g"))
    return grams.select("token", F.size("g").alias("n"), F.md5(F.array_join("g", " ").cast("binary")).alias("grams_md5"))


@query(f"WITH {VOCAB}, {GRAMS}, s AS (SELECT token, i, n, ({sql_hash('gram')} % {BUCKET} + (SELECT count(*) FROM v))::BIGINT AS fid FROM g WHERE token <> '</s>') SELECT v.token, (count(fid) + 1)::INT AS n, (v.id + coalesce(sum(fid), 0))::BIGINT AS sum_ids FROM v LEFT JOIN s USING (token) GROUP BY v.token, v.id")
def subwords(spark, sf_dir):
    own = features.subwords(vocab(spark, sf_dir, minn=MINN, maxn=MAXN, bucket=BUCKET)).select("token", "subwords")
    return own.select("token", F.size("subwords").alias("n"), F.aggregate("subwords", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ids"))


@query(f"WITH {VOCAB}, o AS (SELECT DISTINCT token, 0 AS id FROM e ANTI JOIN v USING (token)), {GRAMS.replace('FROM v)', 'FROM o)')}, s AS (SELECT token, ({sql_hash('gram')} % {BUCKET} + (SELECT count(*) FROM v))::BIGINT AS fid FROM g) SELECT o.token, count(fid)::INT AS n, coalesce(sum(fid), 0)::BIGINT AS sum_ids FROM o LEFT JOIN s USING (token) GROUP BY o.token")
def subwords_oov(spark, sf_dir):
    v = vocab(spark, sf_dir, minn=MINN, maxn=MAXN, bucket=BUCKET)
    tokens = vocabulary.explode_tokens(read(spark, sf_dir, "documents")).select("token").distinct()
    own = features.subwords_of(tokens, v).where("id is null")
    return own.select("token", F.size("subwords").alias("n"), F.aggregate("subwords", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ids"))


@query(f"WITH {VOCAB}, {GRAMS}, b AS (SELECT {sql_hash('gram')} % {BUCKET} AS b, count(*) AS load FROM (SELECT DISTINCT gram FROM g) GROUP BY 1) SELECT load::BIGINT AS load, count(*)::BIGINT AS n_buckets FROM b GROUP BY load")
def bucket_load(spark, sf_dir):
    grams = vocab(spark, sf_dir).words().select(F.explode(T.char_ngrams("token", MINN, MAXN)).alias("gram")).distinct()
    load = grams.groupBy(F.pmod(T.token_hash("gram"), F.lit(BUCKET)).alias("b")).agg(F.count("*").alias("load"))
    return load.groupBy("load").agg(F.count("*").alias("n_buckets"))


_SIGNED = "(CASE WHEN hash >= 2147483648 THEN hash - 4294967296 ELSE hash END)"
_ROLL = "18446744073709551616"
SPANS = f"""x AS (SELECT doc_id, pos, {_SIGNED}::HUGEINT AS a, lead({_SIGNED}) OVER w::HUGEINT AS b, lead({_SIGNED}, 2) OVER w::HUGEINT AS c FROM e JOIN h USING (token) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
two AS (SELECT doc_id, pos, (((a * {T.NGRAM_MULTIPLIER} + b) % {_ROLL}) + {_ROLL}) % {_ROLL} AS r, c FROM x WHERE b IS NOT NULL),
s AS (SELECT doc_id, (r % {BUCKET})::BIGINT AS id, 2 AS n FROM two UNION ALL SELECT doc_id, ((((r * {T.NGRAM_MULTIPLIER} + c) % {_ROLL}) + {_ROLL}) % {_ROLL} % {BUCKET})::BIGINT, 3 FROM two WHERE c IS NOT NULL)"""


@query(f"WITH {EACH}, {HASHED}, {SPANS} SELECT doc_id, count(id)::INT AS n, coalesce(sum(id), 0)::BIGINT AS sum_ids, coalesce(max(id), -1)::BIGINT AS max_id FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id")
def word_ngrams(spark, sf_dir):
    g = read(spark, sf_dir, "documents").select("doc_id", T.word_ngram_ids(T.token_hashes(T.tokens("text")), 3, BUCKET).alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ids"), F.coalesce(F.array_max("g"), F.lit(-1)).alias("max_id"))


@query(f"""WITH {VOCAB}, {HASHED}, {SPANS}, f AS (SELECT doc_id, id::BIGINT AS fid FROM e JOIN v USING (token) UNION ALL SELECT doc_id, id + (SELECT count(*) FROM v) FROM s WHERE n = 2),
n AS (SELECT doc_id, count(*) AS k, sum(fid) AS s FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(k + 1, 0)::INT AS n, coalesce(s + (SELECT id FROM v WHERE token = '</s>'), 0)::BIGINT AS sum_ids FROM documents LEFT JOIN n USING (doc_id)""")
def line_features(spark, sf_dir):
    v = vocab(spark, sf_dir, word_ngrams=2, bucket=BUCKET)
    f = features.line_features(read(spark, sf_dir, "documents"), v)
    return f.select("doc_id", F.size("fids").alias("n"), F.aggregate("fids", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ids"))


@query(f"""WITH {VOCAB}, w AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM e JOIN v USING (token)),
x AS (SELECT a.id AS center, b.id AS context FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p - 2 AND a.p + 2 AND a.p <> b.p)
SELECT center, count(*)::BIGINT AS n, sum(context)::BIGINT AS sum_contexts FROM x GROUP BY center""")
def window_pairs(spark, sf_dir):
    v = vocab(spark, sf_dir)
    known = vocabulary.explode_tokens(read(spark, sf_dir, "documents"), keep=("doc_id",)).join(v.for_lookup(), "token")
    lines = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("w")).select("doc_id", F.transform("w", lambda x: x["id"]).alias("ids"))
    return features.context_pairs(lines, 2).groupBy("center").agg(F.count("*").alias("n"), F.sum("context").cast("long").alias("sum_contexts"))


@query("""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n FROM documents)
SELECT doc_id, round(greatest(0.0, 0.1 * (1 - (sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n) / (sum(n) OVER (PARTITION BY source))::DOUBLE)), 6) AS lr FROM d""")
def lr_schedule(spark, sf_dir):
    """The rate at which each line of a source would be trained on in one epoch, a part for each source."""

    @F.arrow_udf(DoubleType())
    def rate(share: pa.Array) -> pa.Array:
        return pa.array(training.learning_rate(0.1, 0, 1, share.to_numpy(zero_copy_only=False)))

    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.size(T.tokens("text")).cast("long").alias("n"))
    part = Window.partitionBy("source")
    done = F.sum("n").over(part.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    shares = d.select("doc_id", (F.coalesce(done, F.lit(0)) / F.sum("n").over(part)).alias("share"))
    return shares.select("doc_id", F.round(rate("share"), 6).alias("lr"))


# --- scoring on the tables' model -------------------------------------------------------


def table_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(lines (doc_id, fids), input (fid, vec), output (row, vec), rows of input)."""
    own = read(spark, sf_dir, "embeddings")
    n = own.count()
    lines = read(spark, sf_dir, "documents").select("doc_id", F.transform(T.token_hashes(T.tokens("text")), lambda h: F.pmod(h, F.lit(n).cast("long"))).alias("fids"))
    output = own.where("label is not null").groupBy(F.col("label").alias("row")).agg(V.mean_of("embedding", DIM).alias("vec"))
    return lines, own.select(F.col("vec_id").alias("fid"), F.col("embedding").alias("vec")), output, n


_FIDS = f"{EACH}, {HASHED}, f AS (SELECT doc_id, hash % (SELECT count(*) FROM embeddings) AS fid, count(*) AS n FROM e JOIN h USING (token) GROUP BY ALL), m AS (SELECT vec_id AS fid, label, unnest(range(1, {DIM + 1})) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_HIDDEN = f"{_FIDS}, hid AS (SELECT doc_id, j, sum(n * x) / sum(n) AS x FROM f JOIN m USING (fid) GROUP BY doc_id, j), hh AS (SELECT doc_id, j, coalesce(x, 0) AS x FROM documents CROSS JOIN (SELECT unnest(range(1, {DIM + 1})) AS j) LEFT JOIN hid USING (doc_id, j))"
_LOGITS = f"{_HIDDEN}, o AS (SELECT label AS label_id, j, avg(x) AS x FROM m WHERE label IS NOT NULL GROUP BY label, j), z AS (SELECT doc_id, label_id, sum(hh.x * o.x) AS z FROM hh JOIN o USING (j) GROUP BY doc_id, label_id)"
_SOFTMAX = f"{_LOGITS}, mx AS (SELECT doc_id, max(z) AS top FROM z GROUP BY doc_id), sx AS (SELECT doc_id, label_id, exp(z - top) AS ex FROM z JOIN mx USING (doc_id)), p AS (SELECT doc_id, label_id, ex / sum(ex) OVER (PARTITION BY doc_id) AS p FROM sx)"


def table_scores(spark, sf_dir, loss=LossKind.SOFTMAX) -> DataFrame:
    lines, table, output, n = table_model(spark, sf_dir)
    h = scoring.hidden(lines, table, DIM, rows=n)
    return scoring.label_probabilities(scoring.logits(h, output, LABELS, DIM), loss, n_rows=LABELS)


@query(f"WITH {_HIDDEN} SELECT doc_id, round(sum(x), 6) AS total, round(sqrt(sum(x * x)), 6) AS length, round(max(x), 6) AS most FROM hh GROUP BY doc_id")
def hidden_mean(spark, sf_dir):
    lines, table, _, n = table_model(spark, sf_dir)
    h = scoring.hidden(lines, table, DIM, rows=n)
    return h.select("doc_id", F.round(F.aggregate("hidden", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.norm(F.col("hidden")), 6).alias("length"), F.round(F.array_max("hidden"), 6).alias("most"))


@query(f"WITH {_LOGITS} SELECT doc_id, label_id::INT AS label_id, round(z, 6) AS z FROM z")
def logits(spark, sf_dir):
    lines, table, output, n = table_model(spark, sf_dir)
    z = scoring.logits(scoring.hidden(lines, table, DIM, rows=n), output, LABELS, DIM)
    return z.select("doc_id", F.explode("z").alias("s")).select("doc_id", F.col("s.row").cast("int").alias("label_id"), F.round("s.z", 6).alias("z"))


@query(f"WITH {_SOFTMAX} SELECT doc_id, label_id::INT AS label_id, round(p, 6) AS p FROM p")
def softmax_probabilities(spark, sf_dir):
    s = table_scores(spark, sf_dir).select("doc_id", F.explode("scores").alias("s"))
    return s.select("doc_id", F.col("s.label_id").cast("int").alias("label_id"), F.round("s.p", 6).alias("p"))


@query(f"WITH {_LOGITS} SELECT doc_id, label_id::INT AS label_id, round(CASE WHEN z < -8 THEN 0 WHEN z > 8 THEN 1 ELSE 1 / (1 + exp(-(floor(round(z + 8, 9) * 32) / 32 - 8))) END, 6) AS p FROM z")
def ova_probabilities(spark, sf_dir):
    lines, table, output, n = table_model(spark, sf_dir)
    z = scoring.logits(scoring.hidden(lines, table, DIM, rows=n), output, LABELS, DIM)
    rounded = z.withColumn("z", F.transform("z", lambda s: F.struct(s["row"].alias("row"), (F.round(s["z"] + 8, 9) - 8).alias("z"))))
    s = scoring.label_probabilities(rounded, LossKind.OVA, n_rows=LABELS).select("doc_id", F.explode("scores").alias("s"))
    return s.select("doc_id", F.col("s.label_id").cast("int").alias("label_id"), F.round("s.p", 6).alias("p"))


#: Label counts of 2 ** (10 - k), whose Huffman tree is a chain: label k turns right at node 8 - k and left at all above.
CHAIN = [2 ** (LABELS - k) for k in range(LABELS)]


@query(f"WITH {_LOGITS}, hf AS (SELECT doc_id, label_id AS node, 1 / (1 + exp(-z)) AS f FROM z WHERE label_id < {LABELS - 1}) SELECT doc_id, k::INT AS label_id, round(exp(sum(ln(CASE WHEN node = {LABELS - 2} - k THEN f ELSE 1 - f END + 1e-5))), 6) AS p FROM hf JOIN range({LABELS}) l(k) ON node >= {LABELS - 2} - k GROUP BY doc_id, k")
def hs_probabilities(spark, sf_dir):
    """Hierarchical softmax over a chain; the inner nodes' rows are those of the labels."""
    lines, table, output, n = table_model(spark, sf_dir)
    z = scoring.logits(scoring.hidden(lines, table, DIM, rows=n), output.where(F.col("row") < LABELS - 1), LABELS - 1, DIM)
    found = scoring.path_probabilities(z, training.path_table(spark, np.array(CHAIN)))
    return found.select("doc_id", F.col("label_id").cast("int").alias("label_id"), F.round("p", 6).alias("p"))


def table_predictions(spark, sf_dir, k: int, threshold: float = 0.0) -> DataFrame:
    best = table_scores(spark, sf_dir).select("doc_id", scoring.top_k(F.transform("scores", lambda s: F.struct(F.round(s["p"], 9).alias("p"), s["label_id"].cast("int").alias("label_id"))), k, threshold).alias("predictions"))
    return best.select("doc_id", F.posexplode("predictions").alias("rank", "s")).select("doc_id", "rank", F.col("s.label_id").alias("label_id"), F.col("s.p").alias("p"))


_RANKED = f"{_SOFTMAX}, r AS (SELECT doc_id, label_id::INT AS label_id, round(p, 9) AS p, (row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, label_id DESC) - 1)::INT AS rank FROM p)"


@query(f"WITH {_RANKED} SELECT doc_id, rank, label_id, round(p + 1e-5, 6) AS prob FROM r WHERE rank < 3")
def predict_top3(spark, sf_dir):
    return table_predictions(spark, sf_dir, 3).select("doc_id", "rank", "label_id", F.round(F.col("p") + V.LOG_SHIFT, 6).alias("prob"))


@query(f"WITH {_RANKED} SELECT doc_id, rank, label_id, round(p + 1e-5, 6) AS prob FROM r WHERE p >= 0.1")
def predict_threshold(spark, sf_dir):
    return table_predictions(spark, sf_dir, LABELS, 0.1).select("doc_id", "rank", "label_id", F.round(F.col("p") + V.LOG_SHIFT, 6).alias("prob"))


@query(f"WITH {VOCAB}, {GRAMS}, m AS (SELECT vec_id AS fid, unnest(range(1, {DIM + 1})) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT token, id % (SELECT count(*) FROM embeddings) AS fid FROM v UNION ALL SELECT token, {sql_hash('gram')} % {BUCKET} % (SELECT count(*) FROM embeddings) FROM g WHERE token <> '</s>'), a AS (SELECT token, fid, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT token, j, sum(n * x) / sum(n) AS x FROM a JOIN m USING (fid) GROUP BY token, j) SELECT token, round(sum(x), 6) AS total, round(sqrt(sum(x * x)), 6) AS length FROM w GROUP BY token")
def word_vectors(spark, sf_dir):
    """Mean of the rows of a word and its n-grams, folded to the embeddings."""
    v = vocab(spark, sf_dir, minn=MINN, maxn=MAXN, bucket=BUCKET)
    table = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), F.col("embedding").alias("vec"))
    n = table.count()
    fold = lambda x: F.pmod(F.when(x >= v.nwords, x - v.nwords).otherwise(x), F.lit(n).cast("long"))
    lines = features.subwords(v).select("token", F.transform("subwords", fold).alias("fids"))
    w = scoring.hidden(lines, table, DIM, "token", rows=n)
    return w.select("token", F.round(F.aggregate("hidden", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.norm(F.col("hidden")), 6).alias("length"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, (list_position(embedding, list_max(embedding)) - 1)::INT AS place FROM embeddings")
def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("length"), V.argmax(F.col("embedding")).alias("place"))


_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


@query(f"WITH {_UNIT}, s AS (SELECT a.vec_id AS query, b.vec_id, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 10")
def nearest_neighbors(spark, sf_dir):
    """The stated query set, ids divisible by 50, against all vectors."""
    table = neighbors.normalized(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    asked = table.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), "vec", F.array("vec_id").alias("banned"))
    return neighbors.nearest(asked, table, 10, "vec_id").select("query", "vec_id", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {_UNIT}, q AS (SELECT a.vec_id AS query, list_transform(range(1, {DIM + 1}), lambda i: a.v[i] - b.v[i] + c.v[i]) AS v FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 50 = 0), n AS (SELECT query, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM q), s AS (SELECT query, b.vec_id, list_dot_product(n.v, b.v) AS sim FROM n JOIN u b ON b.vec_id NOT BETWEEN query AND query + 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 5")
def analogies(spark, sf_dir):
    table = neighbors.normalized(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    triples = table.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    asked = neighbors.analogy_queries(triples, table, "vec_id")
    return neighbors.nearest(asked, table, 5, "vec_id").select("query", "vec_id", F.round("sim", 6).alias("sim"), "rank")


# --- evaluation ----------------------------------------------------------------------

_GOLD = "gold AS (SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END::INT AS label_id FROM documents)"


def table_gold(spark, sf_dir) -> DataFrame:
    code = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return read(spark, sf_dir, "documents").select("doc_id", code.alias("label_id"))


_CONFUSION = f"{_RANKED}, {_GOLD}, c AS (SELECT label_id, count(r.doc_id) AS predicted, count(g.doc_id) AS gold, count(*) FILTER (r.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS hits FROM (SELECT * FROM r WHERE rank < 3) r FULL JOIN gold g USING (doc_id, label_id) GROUP BY label_id)"


@query(f"WITH {_CONFUSION} SELECT label_id, predicted::BIGINT AS predicted, gold::BIGINT AS gold, hits::BIGINT AS hits, round(hits / nullif(predicted, 0), 6) AS precision, round(hits / nullif(gold, 0), 6) AS recall, round(2 * hits / nullif(predicted + gold, 0), 6) AS f1 FROM c")
def eval_per_label(spark, sf_dir):
    counts = metrics.confusion(table_predictions(spark, sf_dir, 3), table_gold(spark, sf_dir))
    return metrics.per_label(counts).select("label_id", "predicted", "gold", "hits", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query(f"WITH {_CONFUSION}, s AS (SELECT sum(hits)::DOUBLE AS h, sum(gold)::DOUBLE AS g, (SELECT count(*) FROM documents) AS n FROM c) SELECT n::BIGINT AS n, round(h / (3 * n), 6) AS precision, round(h / g, 6) AS recall, round(2 * h / (g + 3 * n), 6) AS f1 FROM s")
def eval_micro(spark, sf_dir):
    gold = table_gold(spark, sf_dir)
    found = metrics.micro(metrics.confusion(table_predictions(spark, sf_dir, 3), gold), gold.count(), 3, LABELS)
    return found.select("n", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query(f"WITH {_SOFTMAX}, {_GOLD}, q AS (SELECT doc_id, label_id::INT AS label_id, round(p, 6) AS p FROM p), t AS (SELECT q.label_id, p AS threshold, count(g.doc_id) AS tp, count(*) AS n FROM q LEFT JOIN gold g USING (doc_id, label_id) GROUP BY ALL), a AS (SELECT *, sum(tp) OVER w AS tps, sum(n) OVER w AS ns FROM t WINDOW w AS (PARTITION BY label_id ORDER BY threshold DESC)), n AS (SELECT label_id, count(*) AS gold FROM gold GROUP BY label_id) SELECT label_id, threshold, round(tps / ns, 6) AS precision, round(tps / gold, 6) AS recall FROM a JOIN n USING (label_id) WHERE tps - tp < gold")
def pr_curve(spark, sf_dir):
    s = table_scores(spark, sf_dir).select("doc_id", F.explode("scores").alias("s")).select("doc_id", F.col("s.label_id").cast("int").alias("label_id"), F.round("s.p", 6).alias("p"))
    return metrics.curve(s, table_gold(spark, sf_dir)).select("label_id", "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_RANKED}, {_GOLD}, c AS (SELECT doc_id, label_id, r.doc_id AS p, g.doc_id AS g FROM (SELECT * FROM r WHERE rank < 3) r FULL JOIN gold g USING (doc_id, label_id)), x AS (SELECT lang, source, label_id, p, g FROM c JOIN documents USING (doc_id)), s AS (SELECT lang, source, label_id, grouping(lang, source, label_id)::INT AS level, count(p) AS predicted, count(g) AS gold, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS hits FROM x GROUP BY CUBE (lang, source, label_id)) SELECT lang, source, label_id, level, predicted::BIGINT AS predicted, gold::BIGINT AS gold, hits::BIGINT AS hits, round(hits / nullif(predicted, 0), 6) AS precision, round(hits / nullif(gold, 0), 6) AS recall, round(2 * hits / nullif(predicted + gold, 0), 6) AS f1 FROM s")
def eval_grouped(spark, sf_dir):
    """Hits of the three best labels by language, source, label and all their combinations."""
    found = metrics.grouped(table_predictions(spark, sf_dir, 3), table_gold(spark, sf_dir), read(spark, sf_dir, "documents"), ["lang", "source"])
    return found.select("lang", "source", "label_id", "level", "predicted", "gold", "hits", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query(f"WITH t AS (SELECT unnest(list_filter({_SPLIT}, lambda x: x <> '</s>')) AS token FROM documents), e AS (SELECT token FROM t UNION ALL SELECT '__label__' || lang FROM documents UNION ALL SELECT '</s>' FROM documents), c AS (SELECT token, count(*)::BIGINT AS count, (starts_with(token, '__label__'))::TINYINT AS kind FROM e GROUP BY token) SELECT token, count, kind FROM c WHERE count >= 2 OR kind = 1")
def saved_dictionary(spark, sf_dir):
    """The dictionary of a trained model, from the file that the data source wrote and read."""
    from ..sources import model_format

    path = fresh_dir(spark, "model") + ".bin"
    model_format.write_model(_trained(spark, sf_dir, epoch=0), path)
    return spark.read.format("lexivec").option("table", "entries").load(path).select("token", "count", "kind")


@query(f"WITH {_GOLD} SELECT label_id, count(*)::BIGINT AS support FROM gold GROUP BY label_id")
def label_support(spark, sf_dir):
    return table_gold(spark, sf_dir).groupBy("label_id").agg(F.count("*").alias("support"))


# --- one step of training -----------------------------------------------------------------

_TABLE_SIGMOID = "CASE WHEN z < -8 THEN 0 WHEN z > 8 THEN 1 ELSE 1 / (1 + exp(-(floor((z + 8) * 32) / 32 - 8))) END"
_TABLE_LOG = "CASE WHEN q > 1 THEN 0 ELSE ln((floor(q * 512) + 1e-5) / 512) END"
RATE = 0.1


def step_sql(rows: str) -> str:
    """rows: doc_id, label_id, w (what is wanted), f (what is found), q (whose logarithm is the loss; null: none)."""
    return f"""WITH {_SOFTMAX}, {_GOLD}, r AS ({rows}), a AS (SELECT doc_id, label_id, {RATE} * (w - f) AS a, CASE WHEN q IS NULL THEN 0 ELSE {_TABLE_LOG} END AS l FROM r),
g AS (SELECT doc_id, j, sum(a * o.x) AS g FROM a JOIN o USING (label_id) GROUP BY doc_id, j), gl AS (SELECT doc_id, sqrt(sum(g * g)) AS length FROM g GROUP BY doc_id),
hl AS (SELECT doc_id, sqrt(sum(x * x)) AS h FROM hh GROUP BY doc_id), al AS (SELECT doc_id, -sum(l) AS loss, sqrt(sum(a * a)) AS a FROM a GROUP BY doc_id)
SELECT doc_id, round(loss, 6) AS loss, round(length, 6) AS gradient, round(a * h, 6) AS moved FROM al JOIN gl USING (doc_id) JOIN hl USING (doc_id) WHERE h > 0"""


def _step(spark, sf_dir, loss: LossKind) -> DataFrame:
    """One step of the training kernel on each document's hidden vector and its language: loss, length of the gradient, length of the output rows' change."""
    lines, table, output, n = table_model(spark, sf_dir)
    h = scoring.hidden(lines, table, DIM, rows=n).join(table_gold(spark, sf_dir), "doc_id")
    own = output.orderBy("row").collect()  # LABELS rows
    out = np.array([r.vec for r in own], np.float64)
    paths = {k: (np.array(a), np.array(c, np.float64)) for k, (a, c) in enumerate(training.huffman_paths(CHAIN))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, target in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wi, wo = np.array([v]), out.copy()
                step = kernels.Step(wi, wo, loss, False, (0,), 1, np.array([(target + 1) % LABELS]), paths)
                step.update(np.zeros(1, np.int64), np.array([target]), RATE)
                rows.append((step.total, float(np.linalg.norm(wi[0] - v)), float(np.linalg.norm(wo - out))))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], names=["doc_id", "loss", "gradient", "moved"])

    made = h.where(V.norm(F.col("hidden")) > 0).select("doc_id", "hidden", "label_id").mapInArrow(run, "doc_id long, loss double, gradient double, moved double")
    return made.select("doc_id", *(F.round(x, 6).alias(x) for x in ("loss", "gradient", "moved")))


@query(step_sql("SELECT p.doc_id, p.label_id, (p.label_id = g.label_id)::INT AS w, p AS f, CASE WHEN p.label_id = g.label_id THEN p END AS q FROM p JOIN gold g USING (doc_id)"))
def step_softmax(spark, sf_dir):
    return _step(spark, sf_dir, LossKind.SOFTMAX)


_SIGMOIDS = f"SELECT z.doc_id, z.label_id, {{}} AS w, {_TABLE_SIGMOID} AS f, CASE WHEN {{}} = 1 THEN {_TABLE_SIGMOID} ELSE 1 - {_TABLE_SIGMOID} END AS q FROM z JOIN gold g USING (doc_id)"
_TARGET = "(z.label_id = g.label_id)::INT"


@query(step_sql(_SIGMOIDS.format(_TARGET, _TARGET)))
def step_ova(spark, sf_dir):
    return _step(spark, sf_dir, LossKind.OVA)


@query(step_sql(_SIGMOIDS.format(_TARGET, _TARGET) + f" WHERE z.label_id IN (g.label_id, (g.label_id + 1) % {LABELS})"))
def step_ns(spark, sf_dir):
    """One negative: the next label."""
    return _step(spark, sf_dir, LossKind.NS)


_RIGHT = f"(z.label_id = {LABELS - 2} - g.label_id)::INT"


@query(step_sql(_SIGMOIDS.format(_RIGHT, _RIGHT) + f" WHERE z.label_id < {LABELS - 1} AND z.label_id >= {LABELS - 2} - g.label_id"))
def step_hs(spark, sf_dir):
    """Paths of a chain."""
    return _step(spark, sf_dir, LossKind.HS)


# --- quantization ---------------------------------------------------------------------


@query("SELECT vec_id AS fid FROM (SELECT vec_id, row_number() OVER (ORDER BY round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE * (1 + vec_id % 7)))), 6) DESC, vec_id) AS r FROM embeddings) WHERE r <= 100")
def select_rows(spark, sf_dir):
    """The hundred longest rows, lengths made unequal by the id; a top-k report."""
    scaled = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double") * (1 + F.col("vec_id") % 7))), 6).alias("n"))
    return scaled.orderBy(F.desc("n"), "fid").limit(100).select("fid")


@query("WITH s AS (SELECT vec_id, unnest(range(32)) AS m, unnest(list_transform(range(32), lambda i: embedding[2 * i + 1: 2 * i + 2])) AS sub FROM embeddings), b AS (SELECT m, vec_id AS code, sub FROM s WHERE vec_id < 256), d AS (SELECT s.vec_id, s.m, b.code, (s.sub[1]::DOUBLE - b.sub[1]::DOUBLE) * (s.sub[1]::DOUBLE - b.sub[1]::DOUBLE) + (s.sub[2]::DOUBLE - b.sub[2]::DOUBLE) * (s.sub[2]::DOUBLE - b.sub[2]::DOUBLE) AS d FROM s JOIN b USING (m)) SELECT vec_id, m::INT AS m, min_by(code, (d, code))::INT AS code FROM d GROUP BY vec_id, m")
def pq_assign(spark, sf_dir):
    """Codes by a fixed codebook: the sub-vectors of the first 256 embeddings."""
    own = read(spark, sf_dir, "embeddings")
    subs = own.select("vec_id", F.posexplode(F.array(*(F.slice("embedding", 2 * m + 1, 2) for m in range(DIM // 2)))).alias("m", "sub"))
    book = subs.where("vec_id < 256").groupBy("m").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").cast("int").alias("code"), F.col("sub").alias("centroid")))).alias("book"))
    return subs.join(F.broadcast(book), "m").select("vec_id", "m", quantization.assign(F.col("sub"), F.col("book")).alias("code"))


_CODES = "s AS (SELECT vec_id, unnest(range(32)) AS m, unnest(list_transform(range(32), lambda i: embedding[2 * i + 1: 2 * i + 2])) AS sub FROM embeddings), b AS (SELECT m, vec_id AS code, sub FROM s WHERE vec_id < 256), d AS (SELECT s.vec_id, s.m, b.code, (s.sub[1]::DOUBLE - b.sub[1]::DOUBLE) * (s.sub[1]::DOUBLE - b.sub[1]::DOUBLE) + (s.sub[2]::DOUBLE - b.sub[2]::DOUBLE) * (s.sub[2]::DOUBLE - b.sub[2]::DOUBLE) AS d FROM s JOIN b USING (m)), c AS (SELECT vec_id, m, min_by(code, (d, code)) AS code, min(d) AS d FROM d GROUP BY vec_id, m)"


def _books(spark, sf_dir) -> list[np.ndarray]:
    """A fixed codebook, 256 rows: the sub-vectors of the first embeddings."""
    rows = read(spark, sf_dir, "embeddings").where("vec_id < 256").orderBy("vec_id").select("embedding").collect()
    whole = np.array([r.embedding for r in rows], np.float32)
    return [whole[:, s : s + n] for s, n in quantization.pieces(DIM, 2)]


@query(f"WITH {_CODES} SELECT vec_id, md5(string_agg(code::VARCHAR, ',' ORDER BY m)) AS codes_md5 FROM c GROUP BY vec_id")
def pq_encode(spark, sf_dir):
    own = quantization.encode(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), F.col("embedding").alias("vec")), _books(spark, sf_dir))
    code = lambda m: F.conv(F.substring(F.hex("codes"), 2 * m + 1, 2), 16, 10)
    return own.select(F.col("fid").alias("vec_id"), F.md5(F.array_join(F.array(*map(code, range(DIM // 2))), ",").cast("binary")).alias("codes_md5"))


@query(f"WITH {_CODES} SELECT vec_id, round(sqrt(sum(d)), 5) AS lost FROM c GROUP BY vec_id")
def pq_decode(spark, sf_dir):
    """How far each vector is from what its codes stand for."""
    own, books = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), F.col("embedding").alias("vec")), _books(spark, sf_dir)
    back = quantization.decode(quantization.encode(own, books), books).select("fid", F.col("vec").alias("back"))
    return own.join(back, "fid").select(F.col("fid").alias("vec_id"), F.round(V.norm(V.add(F.col("vec").cast("array<double>"), F.col("back").cast("array<double>"), -1.0)), 5).alias("lost"))


# --- training: rows only ------------------------------------------------------------------


def train_lines(spark, sf_dir) -> DataFrame:
    return labelled(read(spark, sf_dir, "documents")).select("doc_id", "text")


def _trained(spark, sf_dir, **given):
    return training.train(train_lines(spark, sf_dir), Params.supervised(**{"dim": 10, "epoch": 2, "lr": 0.5, "thread": 8, "min_count": 2, **given}))


@query()
def train_supervised(spark, sf_dir):
    """The language of documents, learned and predicted: doc_id, rank, label, prob."""
    model = _trained(spark, sf_dir)
    return scoring.predict(read(spark, sf_dir, "documents"), model)


def _losses(spark, model) -> DataFrame:
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(model.losses)], "epoch int, loss double")


@query()
def train_ova(spark, sf_dir):
    return _losses(spark, _trained(spark, sf_dir, loss=LossKind.OVA))


@query()
def train_ns(spark, sf_dir):
    return _losses(spark, _trained(spark, sf_dir, loss=LossKind.NS))


@query()
def train_hs(spark, sf_dir):
    return _losses(spark, _trained(spark, sf_dir, loss=LossKind.HS))


def _vectors(spark, sf_dir, kind: str) -> DataFrame:
    p = Params.unsupervised(kind, dim=10, epoch=1, thread=8, minn=0, maxn=0, bucket=0, ws=2, neg=3)
    return training.train(read(spark, sf_dir, "documents"), replace(p, lr=0.05)).input


@query()
def train_skipgram(spark, sf_dir):
    return _vectors(spark, sf_dir, "skipgram")


@query()
def train_cbow(spark, sf_dir):
    return _vectors(spark, sf_dir, "cbow")


@query()
def quantize_model(spark, sf_dir):
    return quantization.quantize(_trained(spark, sf_dir)).input.codes


@query()
def autotune_model(spark, sf_dir):
    """The baseline and up to three proposals of a search: trials, score."""
    from ..operators import search

    docs = train_lines(spark, sf_dir)
    # lines are split by their text, so that copies stay on one side
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    p = replace(Params.supervised(dim=8, epoch=1, lr=0.5, thread=8, min_count=2), autotune_duration=60)
    found = search.autotune(docs.where(~held), docs.where(held), p, most_trials=4)
    return spark.createDataFrame([(found.trials, float(found.score))], "trials int, score double")


@query()
def model_round_trip(spark, sf_dir):
    """The rows of a trained model's output, saved to a binary file and loaded again: row, vec."""
    from ..sources import binary, model_format

    path = fresh_dir(spark, "model") + ".bin"
    model_format.write_model(_trained(spark, sf_dir, epoch=1), path)
    return binary.load_binary(spark, path).output


@query("""WITH RECURSIVE size AS (SELECT (max(vec_id) + 1) * 16 AS n FROM embeddings),
s(b, k, x) AS (SELECT b, 1::BIGINT, CASE WHEN b = 0 THEN 1 ELSE b END::BIGINT * 48271 % 2147483647 FROM range(10) r(b) UNION ALL SELECT b, k + 1, x * 48271 % 2147483647 FROM s, size WHERE k < n // 10 + CASE WHEN b = 9 THEN n % 10 ELSE 0 END),
m AS (SELECT b * (n // 10) + k - 1 AS place, x FROM s, size)
SELECT vec_id::INT AS fid, (place % 16)::INT AS j, round(((x - 1) / 2147483646.0::DOUBLE * 2 - 1) / 16, 6) AS x FROM m JOIN embeddings ON vec_id = place // 16""")
def initial_matrix(spark, sf_dir):
    """The start of an input matrix of 16 columns with a row for each embedding, seed 0."""
    own = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"))
    rows = training.initial_rows(own, own.agg(F.max("row")).first()[0] + 1, 16, 0, exact=True)
    return rows.select(F.col("row").cast("int").alias("fid"), F.posexplode("vec").alias("j", "x")).select("fid", "j", F.round("x", 6).alias("x"))


_EVENTS = "SELECT epoch(start)::BIGINT AS start, event_type, count(*)::BIGINT AS n, count(*) FILTER (value >= 50)::BIGINT AS hits, round(count(*) FILTER (value >= 50) / count(*), 6) AS precision FROM ({}) GROUP BY ALL"


def _meter(events: DataFrame, **given) -> DataFrame:
    from ..streaming import operators

    m = operators.window_meter(events, "ts", F.col("value") >= 50, by=("event_type",), **given)
    return m.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "hits", F.round("precision", 6).alias("precision"))


@query(_EVENTS.format("SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS start FROM events WHERE ts IS NOT NULL"))
def meter_tumbling(spark, sf_dir):
    return _meter(read(spark, sf_dir, "events"))


@query(_EVENTS.format("SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS start FROM events, range(2) r(k) WHERE ts IS NOT NULL"))
def meter_sliding(spark, sf_dir):
    return _meter(read(spark, sf_dir, "events"), slide="5 minutes")


@query(SQL["meter_tumbling"])
def meter_stream(spark, sf_dir):
    """meter_tumbling as a stream over the table's files, run to its end."""
    where = fresh_dir(spark, "meter")
    table = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(table).schema
    live = spark.readStream.schema(schema).parquet(f"{table}*")
    out = _meter(live.withColumn("ts", F.col("ts").cast("timestamp")))
    run = out.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")
