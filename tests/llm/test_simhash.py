import random

import numpy as np
import xxhash

from lexivec.llm import simhash
from lexivec.llm.components import connected_components


def brute_fp(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows, distance=3):
    fps = {}
    for i, t in rows:
        fps.setdefault(brute_fp(t), []).append(i)
    keys = list(fps)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for k in keys:
        ids = [i for i in fps[k] if i is not None]
        if ids:
            least[find(k)] = min([least.get(find(k), ids[0]), *ids])
    return sorted(((i, k, least.get(find(k))) for k in keys for i in fps[k]), key=str)


def own(df):
    return sorted(((r.id, r.fp % 2**64, r.component) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert own(simhash.near_duplicates(docs)) == brute_components(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one two"), (6, "é   x y"), (7, "word " * 20000)]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, fp int, component int")
    assert own(simhash.near_duplicates(docs)) == brute_components(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_find_every_pair_and_hot_anchors(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(400):
        x = centre
        for k in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << k
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")

    def groups(pairs):
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        out = {}
        for x in fps:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    want = groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    for chunk in (simhash.ANCHOR_CHUNK, 40):
        got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, chunk=chunk).collect()]
        assert groups(got) == want


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(10**9), 100)
    pairs = list(zip(nodes, nodes[1:], strict=False)) + [(1, 1), (2, 3), (3, 2), (2, 3)]
    links = spark.createDataFrame(pairs, "a long, b long")
    for more in ({}, {"last_links": 0}, {"last_links": 20}):
        got = {r.node: r.label for r in connected_components(links, **more).collect()}
        assert len({got[x] for x in nodes}) == 1 and got[2] == got[3] and 1 not in got and got[2] != got[nodes[0]]
    assert connected_components(links.limit(0)).count() == 0


def test_components_of_a_chain_in_the_order_of_its_ids(spark):
    links = spark.range(3000).selectExpr("id as a", "id + 1 as b")
    got = connected_components(links, max_rounds=20, last_links=0)
    assert got.count() == 3001 and got.select("label").distinct().count() == 1
