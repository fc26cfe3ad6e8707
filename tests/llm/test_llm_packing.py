import random
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from agrolith.llm import packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 3), min_size=1, max_size=6), st.integers(1, 12))
def test_knapsack_equals_enumeration(values, capacity):
    best, items = packing.knapsack(np.array(values), capacity)
    want = max(sum(values[i] for i in c) for n in range(capacity + 1) for c in combinations_with_replacement(range(len(values)), n)
               if sum(i + 1 for i in c) <= capacity)
    assert abs(best - want) < 1e-9 and sum(items) <= capacity


def test_plan_covers_the_demand_with_few_sequences():
    rng = random.Random(2)
    for _ in range(5):
        demand = np.zeros(64, np.int64)
        for _ in range(rng.choice([1, 40, 5000])):
            demand[min(63, int(rng.lognormvariate(2.5, 0.8)))] += 1
        plan = packing.solve(demand, 64)
        got = Counter()
        for sizes, uses in zip(plan.sizes, plan.uses):
            assert sum(sizes) <= 64 and uses > 0
            for s in sizes:
                got[s] += uses
        assert got == Counter({i + 1: int(c) for i, c in enumerate(demand) if c})
        least = sum((i + 1) * c for i, c in enumerate(demand)) / 64
        assert sum(plan.uses) <= 1.05 * least + 2 or max(i + 1 for i, c in enumerate(demand) if c) > 32
    assert packing.solve(np.zeros(8, np.int64), 8).sizes == []


def check(rows, texts, plain, length=2048):
    """Pieces tile the documents, sequences are gapless and not too long."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = plain.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and 0 < r["length"] <= length
            cut = ids[at:at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_seq)


def test_query_packs_everything_tightly(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_packing(spark, SF).collect()
    n = check(rows, texts, plain)
    assert n <= 1.05 * sum(r["length"] for r in rows) / 2048 + 1


def test_edge_cases_and_hot_class(spark, plain):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b\x85   中文"), (4, "word " * 5000), (None, "no id")] + [(100 + i, "the same few words") for i in range(200)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, cls int, length int")
    got = packing.pack(df, "doc_id", "text", rank_rows=20).collect()
    check(got, dict(rows), plain)
    twice = spark.createDataFrame([(1, "equal"), (1, "equal")], "doc_id bigint, text string")
    assert sorted(r["offset"] for r in packing.pack(twice).collect()) == [0, len(plain.encode("equal").ids) + 1]
    none = packing.pack(df.limit(0), "doc_id", "text")
    assert none.count() == 0 and none.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
