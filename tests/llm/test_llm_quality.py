import random
import re

import numpy as np
import pyarrow as pa
import pytest

from agrolith.llm import quality, queries

M = 1 << 64


def grams_by_hand(text, buckets):
    """Buckets of the 1- and 2-grams, token by token with Python integers."""
    data = (text or "").encode()
    base, mix = int(quality._BASE), int(quality._MIX)
    hs, last = [], None
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t\n\x0b\x0c\r ]+", data):
        t = m[0]
        h = sum((c + 1) * pow(base, i, M) for i, c in enumerate(re.sub(rb"[A-Z]", lambda x: x[0].lower(), t))) % M
        h = (h ^ (h >> 29)) * mix % M
        caps = len(t) > 1 and re.fullmatch(rb"[A-Z]+", t)
        hs.append(int(quality._AGAIN) if h == last else h ^ int(quality._CAPS) if caps else h)
        last = h
    pairs = [(a * int(quality._PAIR) + b) % M for a, b in zip(hs, hs[1:])]
    return sorted((((h ^ (h >> 32)) * mix % M) >> 40) & (buckets - 1) for h in hs + pairs)


def test_hashing_equals_plain_integers(monkeypatch):
    rng = random.Random(4)
    texts = ["", None, " \n", "One ONE one", "a!! b!! c", "É é ÉÉ x", "z"] + ["".join(rng.choices("abAB !é\n", k=rng.randrange(80))) for _ in range(60)]
    texts += [" ".join(rng.choices(["a", "B", "BB", "c!", "!!", "dd", "x" * 200], k=400)) for _ in range(4)] + ["y" * 1000, " " * 900, "z z " * 300]
    monkeypatch.setattr(quality, "_BLOCK", 150)
    grams = quality.Grams(256)
    got = {}
    for rows, data, starts, goes_on in quality.blocks(pa.array(texts)):
        bucket, doc = grams.of(data, starts, goes_on)
        for b, d in zip(bucket.tolist(), doc.tolist()):
            got.setdefault(int(rows[d]), []).append(b)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == grams_by_hand(t, 256), t


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [rng.gauss(0, 1) ** 5 for _ in range(3000)] + [0.25] * 1000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = sorted(values, reverse=True)
    for k in (1, 7, 900, 2000, 4000, 9999):
        assert quality.kth_largest(df, "v", k) == want[min(k, 4000) - 1]
    assert quality.kth_largest(df, "v", 0) is None and quality.kth_largest(df.limit(0), "v", 3) is None


def test_labelled_documents(spark):
    """Labels of other documents than those that trained the model: good ones stay, poor ones go."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.resample(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert len(got) > 100
    assert got[got.quality == 1].kept.mean() >= 0.98 and got[got.quality == 0].kept.mean() <= 0.1


@pytest.fixture(scope="module")
def small(spark):
    good, bad = "alpha beta gamma delta words of a good text", "!!! ### $$$ junk"
    rows = [(i, f"{good} number {i}" if i % 4 else f"{bad} {i} " * 3) for i in range(80)] + [(200, None), (201, ""), (202, " "), (3, f"{good} number 3"), (None, good)]
    docs = spark.createDataFrame([(i, t, 0.0, i) for i, t in rows], "doc_id bigint, text string, log_weight double, n bigint")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)] + [(None, 1), (5, None), (9999, 1)], "doc_id bigint, quality int")
    return docs, labels


def test_resample_and_keep(spark, small):
    docs, labels = small
    got = quality.resample(docs, labels).collect()
    assert len(got) == docs.count()
    kept = sorted((r["doc_id"] for r in got if r["kept"]), key=repr)
    assert set(range(80)) - {i for i in range(80) if i % 4 == 0} <= set(kept) | {None} and not any(i in kept for i in (200, 201, 202, 0, 4, 8))
    same = quality.keep(docs, labels)
    assert same.columns == docs.columns and sorted((r["doc_id"] for r in same.collect()), key=repr) == kept
    by_key = sorted((r["gumbel_key"] for r in got if r["gumbel_key"] is not None), reverse=True)
    ten = [r for r in quality.resample(docs, labels, k=10).collect() if r["kept"]]
    assert all(r["gumbel_key"] >= by_key[9] - 1e-9 for r in ten) and len(ten) >= 10


def test_keep_sends_texts_once_and_gets_numbers_back(spark, small):
    """The rows stay in the JVM: no operator hands them through the Python worker and back."""
    docs, labels = small
    plan = quality.keep(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1


def test_without_labels_or_rows(spark, small):
    docs, labels = small
    got = quality.resample(docs, labels.limit(0)).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {200, 201, 202}
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert quality.keep(docs.limit(0), labels).count() == 0


def test_noise_is_gumbel(spark):
    """Of two equal-weight halves, k falls about evenly; a weight of 1 more gives e times the chance."""
    n = 4000
    key = [r["g"] for r in spark.range(n).selectExpr(f"-ln(-ln((shiftrightunsigned(xxhash64(id, 42), 11) + 0.5) / {float(1 << 53)!r})) AS g").collect()]
    assert abs(np.mean(key) - 0.5772) < 0.08 and abs(np.std(key) - 1.2825) < 0.08


def test_query_returns_every_document(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op6_quality(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
