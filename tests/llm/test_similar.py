import random

import numpy as np
import pytest

from lexivec.llm import similar


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return out


def made_pairs(seed, n=300):
    """(rows, pairs (id of the copy: similarity)): texts and copies with some words changed."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))] for _ in range(n)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    near = {}
    for k in range(n):
        copy = " ".join(edited(rng, base[k], max(1, len(base[k]) * rng.choice([5, 10, 15, 20, 22, 30]) // 1000)))
        near[1000 + k] = jaccard(rows[k][1], copy)
        rows.append((1000 + k, copy))
    return rows, near


def check(spark, rows, near):
    """Pairs are linked if and only if they are similar; a few of the similar ones may not meet."""
    gone = {r.id for r in similar.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    high = [i for i, j in near.items() if j >= similar.LIKENESS]
    edge = [i for i in high if near[i] <= 0.85]
    assert len(high) > 0.3 * len(near) and len(edge) > 0.1 * len(near)
    assert gone <= set(high)
    assert len(gone) >= 0.97 * len(high) and sum(i in gone for i in edge) >= 0.95 * len(edge)


def test_pairs_of_at_least_the_similarity_are_caught_and_no_others(spark):
    check(spark, *made_pairs(12))


def with_repeats(seed, n=200):
    """As made_pairs, but texts say some lines and words again, and copies say them more or less often."""
    rng = random.Random(seed)
    rows, near = [], {}
    for k in range(n):
        lines = [[f"w{rng.randrange(3000)}" for _ in range(10)] for _ in range(rng.randint(15, 40))]
        extra = lambda: [x for line in rng.sample(lines, 2) for x in [line] * rng.choice([0, 1, 3, 6, 12])] + [[rng.choice("-=#")] * rng.choice([0, 5, 40, 150])]  # noqa: B023, E731
        copy = [edited(rng, line, 1) if rng.random() < rng.choice([0.05, 0.15, 0.25]) else line for line in lines]
        text = lambda x: "\n".join(" ".join(line) for line in x)
        rows += [(k, text(lines + extra())), (1000 + k, text(copy + extra()))]
        near[1000 + k] = jaccard(rows[-2][1], rows[-1][1])
    return rows, near


def test_the_same_for_texts_that_repeat_themselves(spark):
    check(spark, *with_repeats(13))


@pytest.mark.parametrize("run", [40, 60, 100, 190])
def test_a_repeated_word_makes_no_copies(spark, run):
    rng = random.Random(run)
    rows = [(k, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(200)), *["-"] * run])) for k in range(40)]
    assert similar.copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("first", "second"), [(0, 3), (0, 6), (0, 12), (1, 6), (2, 12)])
def test_a_repeated_line_hides_no_copies(spark, first, second):
    rng = random.Random(first * 100 + second)
    rows, n = [], 60
    for k in range(n):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(30)]
        more = " ".join(f"w{rng.randrange(10**6)}" for _ in range(10))
        rows += [(k, "\n".join(lines + [more] * first)), (1000 + k, "\n".join(lines + [more] * second))]
        assert jaccard(rows[-2][1], rows[-1][1]) >= 0.9
    gone = {r.id for r in similar.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone <= {*range(1000, 1000 + n)} and len(gone) >= 0.97 * n


def test_short_texts_of_few_shingles(spark):
    rng = random.Random(21)
    rows, near = [], {}
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(24, 34))]
        other = words + [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 7))]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(other))]
        near[1000 + k] = jaccard(rows[-2][1], rows[-1][1])
    check(spark, rows, near)


def test_groups_and_edge_rows(spark):
    rng = random.Random(14)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    rows = [(7, text)] + [(2000 + k, f" {text.upper()}") for k in range(50)] + [(None, text), (3000, None), (3001, ""), (3001, "other words on their own"), (3002, "few words"), (7, text)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, node int, id int")
    gone = {r.id for r in similar.copies(docs).collect()}
    assert gone == {*range(2000, 2050), 3001}
    kept = similar.keep_one(docs)
    # the clean text that shares an id with a copy stays
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(7, text), (None, text), (3000, None), (3001, "other words on their own"), (3002, "few words")}
    assert kept.count() == 6
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_a_large_group_is_proved_in_chunks(spark):
    rng = random.Random(15)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    other = [f"v{rng.randrange(3000)}" for _ in range(200)]
    rows = [(k, " ".join(edited(rng, words, 2))) for k in range(120)] + [(200 + k, " ".join(edited(rng, other, 1))) for k in range(5)] + [(300, " ".join(words[:100] + other[:100]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    each = similar.fingerprints(docs, "doc_id", "text", 5)
    distinct = similar.cut(each.selectExpr("monotonically_increasing_id() as node", "*"))
    of = {r.node: r.id for r in distinct.collect()}
    for chunk in (16, 1024):
        groups = {}
        for r in similar.chains(docs, distinct, "doc_id", "text", 5, chunk=chunk).collect():
            groups.setdefault(r.label, []).append(of[r.node])
        assert sorted(sorted(g) for g in groups.values()) == [list(range(120)), list(range(200, 205))]


def test_proof_leaves_out_no_pair_that_joins_chains():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(pool[k : k + 100]) for k in range(0, 60, 4)] + [np.unique(pool[300 + k : 400]) for k in range(3)]
    fps = np.zeros((len(sets), 4), np.uint64)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar.proved(fps, sets):
        assert similar.alike(sets[a], sets[b])
        parent[find(a)] = find(b)
    full = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    for i in range(len(sets)):
        for j in range(i):
            assert not full(i, j) or find(i) == find(j)
            assert full(i, j) == similar.alike(sets[i], sets[j])


def test_blocks_meet_at_one_bit():
    x = np.repeat(np.arange(1 << similar.WIDTH), similar.WIDTH + 1)
    y = x ^ np.tile([0, *(1 << k for k in range(similar.WIDTH))], 1 << similar.WIDTH)
    at, anchor, home = similar.block_anchors(x)
    homes = {int(i): int(a) for i, a, h in zip(at, anchor, home, strict=True) if h}
    ya, yb, _ = similar.block_anchors(y)
    of = {}
    for i, a in zip(ya.tolist(), yb.tolist(), strict=True):
        of.setdefault(i, set()).add(a)
    assert all(homes[i] in of[i] for i in range(len(x)))


def test_anchor_links_join_groups():
    rng = np.random.default_rng(4)
    for n in (50, 5000):
        centre = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
        fps = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (n // 3, 4)).astype(np.uint64)) for c in centre])
        links = similar.anchor_links(fps, np.arange(len(fps)), 40)
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        assert len({find(k) for k in range(len(fps))}) == 3 and len(links) == len(fps) - 3


def test_sets_of_the_similarity_meet():
    rng = np.random.default_rng(22)
    met = bits = 0
    for n in (20, 100, 500):
        for _ in range(500):
            own = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
            x, y = own[:n], own  # n of n + n / 4 shingles: a similarity of 0.8
            fx, fy = (np.frombuffer(similar.fingerprint(v), np.uint64)[None] for v in (x, y))
            met += similar.met_before(fx, fy, similar.minima(x)[None], similar.minima(y)[None], similar.BLOCKS)[0]
            bits += int(np.bitwise_count(fx ^ fy).sum()) <= similar.MAX_BITS
    assert met >= 0.985 * 1500 and bits >= 0.999 * 1500


@pytest.mark.parametrize(("chunk", "edits"), [(8, 40), (4096, 40), (4096, 12)])
def test_pairs_told_once_connect_what_meets(spark, chunk, edits):
    """Links of the first meeting alone give the components of all that meet within the distance, hot anchors included."""
    rng = np.random.default_rng(7)
    bits = [rng.random(similar.BITS) < 0.5 for _ in range(3)]
    rows = []
    for k in range(150):
        own = bits[k % 3].copy()
        own[rng.choice(similar.BITS, int(rng.integers(0, edits)), replace=False)] ^= True
        rows.append(np.packbits(own).tobytes())
    fps = np.frombuffer(b"".join(rows), np.uint64).reshape(-1, 4)
    n, near = len(fps), 45
    keys = rng.integers(0, 3, (n, similar.BLOCKS)).astype(np.uint32)
    keys[rng.random(n) < 0.7] = 1
    table = spark.createDataFrame([(k, *map(int, fps[k].view(np.int64)), bytearray(keys[k].tobytes())) for k in range(n)], "node long, f0 long, f1 long, f2 long, f3 long, minima binary")
    links = [(r.a, r.b) for r in similar.candidates(table, near=near, chunk=chunk).collect()]
    spread = np.unpackbits(fps.view(np.uint8).reshape(n, -1), axis=1)
    meets, must = set(), set()
    for b in range(similar.BLOCKS):
        words = spread[:, b * similar.WIDTH : (b + 1) * similar.WIDTH].astype(np.int64) @ (1 << np.arange(similar.WIDTH))
        at, anchor, home = similar.block_anchors(words)
        for i, a in zip(at[home].tolist(), anchor[home].tolist(), strict=True):
            meets |= {(i, j) for j in at[anchor == a].tolist() if i != j and keys[i, b] == keys[j, b]}
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    must = {(i, j) for i, j in meets if apart[i, j] <= near}
    assert all((i, j) in must or (j, i) in must for i, j in links)

    def components(pairs):
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        groups = {}
        for x in range(n):
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    assert components(links) == components(must) and len(components(must)) < n
    # members of tight groups are at up to four anchors of each of nine blocks, and give fewer links than there are blocks
    assert edits > 12 or len(links) < 9 * n
