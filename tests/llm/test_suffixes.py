import hashlib
import random

from lexivec.llm import queries, suffixes

SPAN = suffixes.SPAN


def windows(suffix):
    """The windows of an anchor, the first first."""
    n = suffix[-1]
    whole = suffix[len(suffix) - 1 - n : -1][::-1] + suffix[: len(suffix) - 1 - n]
    return [whole[i : i + SPAN] for i in range(len(whole) - SPAN + 1)]


def brute(rows):
    first = {}
    key = lambda i: suffixes._LAST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - SPAN + 1):
            w = b[k : k + SPAN]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - SPAN + 1):
            if first[b[k : k + SPAN]] < key(i):
                gone[k : k + SPAN] = [True] * SPAN
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def own(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = own(queries.op6_suffix_dedup(spark, sf))
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_edge_rows_and_many_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    passages = ["".join(rng.choice("ab \né") for _ in range(n)) for n in (20, 49, 50, 51, 60, 120, 400, 90)] + ["a" * 300, "ab" * 100]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [(None, passages[6]), (None, passages[6]), (7, rows[3][1]), (7, passages[5]), (500, None), (501, ""), (502, passages[6] * 3)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert own(queries.op6_suffix_dedup(spark, str(tmp_path))) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = suffixes.remove_repeats(docs, part_bytes=5000).collect()
    assert sorted(((r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == want
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    for hot in (0, 3):
        got = suffixes.remove_repeats(docs, part_bytes=5000, hot_contexts=hot).collect()
        assert sorted(((r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == want


def test_hot_anchors_are_dealt_by_window():
    rng = random.Random(12)
    phrase = b"a phrase that very many documents have"
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(30)) + phrase + bytes(rng.choice(b"abcdefgh") for _ in range(30)) for _ in range(200)]
    part = suffixes.Part(list(range(200)), texts)
    own, several, contexts = part.hashes()
    assert several.any() and max(contexts[several]) >= 6
    edges = suffixes.bucket_edges(own, 8)
    bits = {b: 2 * suffixes.np.packbits(several[s:e]).tobytes() for b, (s, e) in enumerate(zip(edges, edges[1:], strict=False))}
    _, first, found, bucket = part.shared(bits, 8)
    assert {len(windows(s)) for s in found} == {1}
    assert all(windows(s)[0] == part.data[f : f + SPAN] for s, f in zip(found, first.tolist(), strict=True))
    assert set(bucket.tolist()) == set(range(8))


def test_parts_of_several_blocks_in_any_row_order(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(13)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = suffixes.remove_repeats(docs, part_bytes=400_000).collect()
    assert sorted(((r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows)


def test_blocks(monkeypatch):
    rng = random.Random(10)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (3000, 10, 0, 700, 49, 50)]
    want = {w for t in texts for k in range(len(t) - SPAN + 1) for w in [t[k : k + SPAN]]}
    for block in (suffixes.BLOCK, 200):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        part = suffixes.Part(list(range(6)), texts)
        found = set()
        for p, f, z in zip(part.place.tolist(), part.first.tolist(), part.last.tolist(), strict=True):
            found |= set(windows(part.data[p : z + SPAN] + part.data[f:p][::-1] + bytes((p - f,))))
        assert found == want


def test_merge_and_front_coding():
    rng = random.Random(11)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 60))}) for _ in range(7)]
    coded = [suffixes.front_code(r) for r in runs]
    assert [suffixes.front_decode(*c) for c in coded] == runs
    got = list(suffixes.merge([(r, c[0]) for r, c in zip(runs, coded, strict=True)]))
    assert [g[0] for g in got] == sorted(x for r in runs for x in r)
    for a, b in zip(got, got[1:], strict=False):
        assert b[1] == suffixes.shared_prefix(a[0], b[0], 0)
    assert list(suffixes.merge([([], b"")])) == []


def test_verdicts_are_the_smallest_documents_of_equal_windows():
    rng = random.Random(13)
    pieces = [bytes(rng.choice(b"ab\0") for _ in range(n)) for n in (16, 20, 30, 60)]
    texts = [b"".join(rng.choice(pieces) for _ in range(rng.randint(2, 8))) for _ in range(60)]
    runs, told = [], {}
    for k in range(3):
        ids = list(range(k, 60, 3))
        part = suffixes.Part(ids, [texts[i] for i in ids])
        least = {}
        for d, x in zip(part.doc.tolist(), part._suffixes(part.place, part.first, part.last), strict=True):
            least[x] = min(least.get(x, 99), ids[d])
        keys = sorted(least)
        runs.append((keys, suffixes.front_code(keys)[0], suffixes.np.array([least[x] for x in keys])))
        for x in keys:
            for w in windows(x):
                told[w] = min(told.get(w, 99), least[x])
    runs.append(([], b"", suffixes.np.empty(0, suffixes.np.int64)))
    found = suffixes.verdicts(runs)
    for (keys, *_), (sizes, values) in zip(runs, found, strict=True):
        at = 0
        for x, n in zip(keys, sizes.tolist(), strict=True):
            want = [told[w] for w in windows(x)]
            assert values[at : at + n].tolist() == (want[:1] if len(set(want)) == 1 else want)
            at += n
        assert at == len(values)
