import random
import re

import numpy as np
import pytest
import xxhash

from agrolith.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits=4):
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    keys = sorted(up)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                up[root(b)] = root(a)
    return {f: root(f) for f in up}


def brute(docs):
    fps = [(i, fingerprint(t)) for i, t in docs]
    roots = components([f for _, f in fps])
    low = {}
    for i, f in fps:
        if i is not None:
            low[roots[f]] = min(low.get(roots[f], i), i)
    return sorted((repr(i), f"{f:016x}", low.get(roots[f])) for i, f in fps)


def found(df):
    return sorted((repr(r["doc_id"]), r["fp"], r["component_id"])
                  for r in df.select("doc_id", simhash.hex_fp(df["fp"]).alias("fp"), "component_id").collect())


def make(rng, n):
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            t = rng.choice(docs)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((i, " ".join(t)))
        else:
            docs.append((i, " ".join(rng.choices(words, k=rng.choice([3, 30, 120, 300])))))
    return docs


@pytest.mark.parametrize("shard_rows", [8, 8192])
def test_equals_brute_force(spark, shard_rows):
    docs = make(random.Random(5), 220) + [(500, None), (501, ""), (502, " \n"), (503, "One two"), (503, "one TWO"), (None, "one two"), (504, "É é x y z")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, fp string, component_id int")
    got = simhash.near_duplicates(df, "doc_id", "text", shard_rows=shard_rows)
    assert found(got) == brute(docs)


@pytest.mark.parametrize("max_shards", [1, 2])
def test_overfull_shards_are_cut_level_by_level(spark, max_shards):
    """A top tree far too small for the rows: the same components as the plain comparison of all pairs."""
    docs = make(random.Random(8), 260)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(simhash.near_duplicates(df, shard_rows=6, max_shards=max_shards)) == brute(docs)


@pytest.mark.parametrize("spread_bits", [64, 3])
def test_cut_again(spark, spread_bits):
    """Close pairs still meet, scattered shards are no more overfull, a dense one stays whole, copies stay few."""
    rng = random.Random(21)
    base = rng.getrandbits(64)
    near = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    points = {near(base, rng.randrange(spread_bits)) if spread_bits < 64 else rng.getrandbits(64) for _ in range(1500)}
    points |= {near(p, rng.randrange(1, 5)) for p in sorted(points)[:400]}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(points)]
    masks, radius = simhash.block_masks(3), 1
    routed = spark.createDataFrame([(t, 0, p) for t in range(3) for p in signed], "tree int, leaf bigint, fp bigint")
    rows = simhash.cut_again(routed, masks, radius, 20, max_cut=8, piece_rows=300).collect()
    shards = {}
    for r in rows:
        shards.setdefault((r["tree"], r["leaf"]), set()).add(r["fp"] & (1 << 64) - 1)
    met = {(a, b) for s in shards.values() for a in s for b in s if a < b and (a ^ b).bit_count() <= 4}
    want = {(a, b) for a in points for b in points if a < b and (a ^ b).bit_count() <= 4}
    assert met == want and len(want) > 300
    if spread_bits == 64:
        assert max(map(len, shards.values())) < 600 and len(shards) > 30 and len(rows) < 8 * len(routed.collect())


@pytest.mark.parametrize("radius,blocks", [(4, 1), (2, 2), (1, 3)])
def test_every_close_pair_meets_in_a_leaf(radius, blocks):
    rng = random.Random(11)
    seeds = [rng.getrandbits(64) for _ in range(150)]
    points = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for s in seeds for _ in range(4)})
    arr = np.array(points, np.uint64)
    met = set()
    for mask in simhash.block_masks(blocks):
        for _, rows in simhash.VantageTree(arr[::3], mask, radius, 64, 2).route(arr):
            rows = sorted(rows.tolist())
            met.update((a, b) for k, a in enumerate(rows) for b in rows[k + 1:])
    for i, a in enumerate(points):
        for j in range(i + 1, len(points)):
            if (a ^ points[j]).bit_count() <= 4:
                assert (i, j) in met


def test_long_chain_and_hot_fingerprint(spark):
    """A chain of links over many shards is one component; equal fingerprints count once."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99}
    df = spark.createDataFrame([(i, "same text over and over again") for i in range(300)] + [(300, "other words are in here now")], "doc_id bigint, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {0, 300}


def test_keep_one(spark):
    rows = [(5, "a b c d e", "x"), (3, "a b c d e", "y"), (3, "a b c d e", "y"), (9, None, "z"), (None, "", "z"), (7, "q r s t u v", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=repr)
    assert got == sorted([(3, "a b c d e", "y"), (9, None, "z"), (7, "q r s t u v", None)], key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_long_text_goes_in_blocks(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(5000))
    want = fingerprint(text)
    monkeypatch.setattr(simhash, "_HASH_BLOCK", 100)
    assert simhash.fingerprint(text) == want


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op2_simhash(spark, SF).collect()
    assert sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == brute(docs)


def test_a_dense_region_needs_no_list_of_pairs():
    """Thousands of fingerprints around one: each is met once; the result is that of the plain comparison."""
    import time
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    flips = lambda n: sum(1 << b for b in rng.sample(range(64), n))
    points = np.unique(np.array([centre ^ flips(rng.choice([1, 2, 3])) for _ in range(20_000)] + [rng.getrandbits(64) for _ in range(500)], np.uint64))
    began = time.process_time()
    up = simhash.link_shard(points, simhash.block_masks(3)[0], 1, 4)
    assert time.process_time() - began < 60
    small = np.sort(rng.sample(points.tolist(), 300))
    up = simhash.link_shard(np.array(small, np.uint64), simhash.block_masks(1)[0], 4, 4, leaf_rows=50)
    want = components([int(p) for p in small])
    groups = {}
    for i, p in enumerate(small):
        groups.setdefault(want[int(p)], []).append(i)
    assert all(len({int(up[i]) for i in g}) == 1 for g in groups.values())
    assert len({int(u) for u in up}) == len(groups)
