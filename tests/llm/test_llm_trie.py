import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from agrolith.llm import queries, trie

SF = "/root/testdata/sf0.001"
KIND = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Every prefix as a tuple; totals by walking all prefixes."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(turns.get(c - int(c % 100), [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if seqs[c] == p).encode()).hexdigest()) for p, m in nodes.items())


def same(spark, rows, **kw):
    got = trie.prefix_trie(spark.createDataFrame(rows, KIND).withColumn("depth", F.lit("x")).withColumn("rep", F.lit(1)).repartition(6), **kw).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    return got


def forest(seed, n, long=0):
    """Conversations over few texts, so that prefixes are shared, with equal ones and a long one."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", ""]) if t > 1 else "user", rng.choice(["hé", "b", "", "ccc"]) if t else "hello"))
    rows += [(n + 7, t, "user", "x" * (t % 5)) for t in range(long)] + [(n + 8, t, "user", "x" * (t % 5) if t < long - 3 else "y") for t in range(long)]
    return rows


@pytest.mark.parametrize("shard", [4, 200, 1 << 15])
def test_equals_brute_force(spark, shard):
    same(spark, forest(shard, 260, 60), shard=shard)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = forest(5, 120, 90)
    same(spark, rows, shard=64)


def test_a_group_of_equal_conversations_larger_than_a_piece(spark):
    rows = [(c, 0, "user", "same") for c in range(3000)]
    got = same(spark, rows)
    assert max(r["n_convs"] for r in got) == 3000


def test_decompose_on_a_path_and_a_star():
    for parent in ([-1, *range(999)], [-1] + [0] * 999):
        gained = [[0] * 1000]
        trie.decompose(parent, [[1] * 1000], gained, list(range(1000)))
        want = [1] * 1000
        for v in range(999, 0, -1):
            want[parent[v]] += want[v]
        assert gained[0] == want


def test_edge_cases(spark):
    assert trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", None), (1, 0, None, "user"), (1, 0, "user", None), (2, 5, "user", "z" * 100_000),
            (-3, 0, "a", "b"), (100, 1, "r", "t"), (100, 0, "r", "s"), (101, 0, "x", "y"), (199, 3, "q", "q")]
    # ties in turn: role first, then the hash; here the roles differ or the rows are equal
    same(spark, rows, shard=2)
    assert len(trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "a")], KIND)).collect()) == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in queries.op11_trie(spark, SF).collect()) == brute(rows)
