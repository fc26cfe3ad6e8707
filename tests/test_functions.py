import duckdb

from agrolith.functions import (argmax, hash_bucket, null_tokens_to_null, round_half_even, softmax,
                                strip_all, title_case)
from agrolith.functions.topics import insight_topic


def test_title_case_hard_names(spark):
    names = ["côte d'ivoire", "GUINEA-BISSAU", " Bolivia (plurinational State of) ", "rice, paddy", "a1b"]
    want = [n.strip().title() for n in names]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string")
           .select(title_case("n").alias("t")).collect()]
    assert got == want


def test_round_half_even_ties(spark):
    import pandas as pd
    vals = [0.00125, 0.00015, 2.5, 0.5, 1.5]
    want = pd.Series(vals).round(4).tolist()
    got = [r.v for r in spark.createDataFrame([(v,) for v in vals], "x double")
           .select(round_half_even("x", 4).alias("v")).collect()]
    assert got == want
    got0 = [r.v for r in spark.createDataFrame([(v,) for v in vals], "x double")
            .select(round_half_even("x", 0).alias("v")).collect()]
    assert got0 == pd.Series(vals).round(0).tolist()


def test_null_tokens_and_strip(spark):
    df = spark.createDataFrame([("NA",), ("  12 ",), ("..",), ("",), ("NaN",), (None,)], "s string")
    out = [r.v for r in df.select(null_tokens_to_null("s").alias("v")).collect()]
    assert out == [None, "  12 ", "..", None, None, None]
    assert df.select(strip_all("s").alias("v")).collect()[1].v == "12"


def test_hash_bucket_matches_duckdb(spark):
    keys = list(range(50))
    got = [r.b for r in spark.createDataFrame([(k,) for k in keys], "k bigint")
           .select(hash_bucket(42, "k", 1000).alias("b")).orderBy("k").collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute(
        "SELECT (('0x' || substr(md5('42|' || CAST(k AS VARCHAR)), 1, 8))::UBIGINT % 1000) FROM range(50) t(k) ORDER BY k").fetchall()]
    assert got == want


def test_softmax_argmax(spark):
    r = spark.createDataFrame([([1.0, 3.0, 2.0],)], "a array<double>") \
        .select(softmax("a").alias("p"), argmax("a").alias("i")).first()
    assert abs(sum(r.p) - 1) < 1e-12 and r.i == 1 and r.p[1] == max(r.p)


def test_topic_rule_order(spark):
    texts = ["Heavy RAIN and heat", "heat wave", "hybrid model", "yield potential", "nothing here"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string")
           .select(insight_topic("x").alias("t")).collect()]
    assert got == ["rain", "temperature", "model", "yield", "general"]
