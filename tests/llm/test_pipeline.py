import base64
import hashlib

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from lexivec.llm import mixing, pii, quality, similar


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute(sf):
    tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    docs = docs[[all(not r.rejects(quality.Measures(t.encode())) for r in quality.RULES) for t in docs.text]].sort_values("doc_id").reset_index(drop=True)
    sets, group = [shingles(t) for t in docs.text], list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if root(i) != root(j) and len(sets[i] & sets[j]) >= similar.LIKENESS * len(sets[i] | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    docs = docs[[root(i) == i for i in range(len(docs))]].copy()
    docs["text"] = [pii.redact(t, pii.spans(t)) for t in docs.text]
    db = duckdb.connect()
    db.register("documents", docs)
    copies = dict(db.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall())
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = own.encode_ordinary(t)
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        out += [row] * copies[i]
    return sorted(out)


def test_run_matches_brute_force(spark, sf):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == brute(sf)


def test_stages_keep_columns_and_take_edge_rows(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, None, None, None), (1, " ".join(f"w{k}" for k in range(80)), "en", "src1", 3), (None, " ".join(f"w{k}" for k in range(80)), None, None, None), (2, " ".join(f"w{k}" for k in range(80)), "en", "src1", 3), (3, "", "", "", 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == schema.names
        docs.collect()
