import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from agrolith.llm import queries, urls

SF = "/root/testdata/sf0.001"


def rule_by_hand(host, path):
    best = None
    for v, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (v, h + p)
    return best


def glob_by_hand(glob, host, path):
    h, p, tail = urls.parse_glob(glob)
    turn = lambda text, dot: "".join(f"{dot}*" if c == "*" else dot if c == "?" else re.escape(c) for c in text)
    return re.fullmatch(turn(h, "[^\xff]") + "\xff" + turn(p, "[^\xff]") + (".*" if tail else ""), "." + host + "\xff" + path, re.S) is not None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc.-*x", max_size=12), st.text("/abc*.1", max_size=12)), min_size=1, max_size=8),
       st.lists(st.text("ab.*?/", min_size=1, max_size=9), min_size=1, max_size=12))
def test_automaton_equals_regular_expressions(places, globs):
    auto = urls.Automaton.of([urls.parse_glob(g) for g in globs])
    got = auto.run([b"." + h.encode() + b"\xff" + p.encode() for h, p in places])
    for i, (h, p) in enumerate(places):
        for j, g in enumerate(globs):
            assert got[i, j] == glob_by_hand(g, h, p), (g, h, p)


def test_rules_and_edge_cases(spark):
    rows = [(1, "http://EXAMPLE.org/es/x"), (2, "https://a.example.org/en/12?q#f"), (3, "http://x.org"), (4, "http://x.org/"), (5, None), (6, ""),
            (7, "no scheme.org/"), (8, "http://a.com/de/1"), (9, "http://com/fr/"), (10, "http://notexample.org/es/"), (11, "http://a.net/x.org/"),
            (12, "http://cheap-pills.example.net/a"), (12, "http://cheap-pills.example.net/a"), (None, "http://é.org/" + "ä" * 50_000),
            (13, "x://h?://other.org/"), (14, "http://a.com:80/fr/")]
    df = spark.createDataFrame([(a, b, "clash", "clash") for a, b in rows], "page_id bigint, url string, host string, verdict string")
    got = urls.filter_urls(df, "page_id", "url").collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("example.org", "/es/x", "example.org/es/", "block")
    assert by[2]["rule"] == "example.org/en/1" and by[2]["path"] == "/en/12"
    assert by[3]["rule"] is None and by[4]["rule"] == "org/"
    for i in (5, 6, 7):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"], by[i]["verdict"]) == ("", "", None, "allow")
    assert by[8]["verdict"] == "block" and by[9]["rule"] == "com/fr/" and by[10]["rule"] == "org/" and by[11]["rule"] is None
    assert by[12]["verdict"] == "block" and by[12]["rule"] is None
    assert by[None]["rule"] == "org/" and len(by[None]["path"]) == 50_001
    assert by[13]["host"] == "h" and by[14]["host"] == "a.com:80" and by[14]["rule"] is None
    for r in got:
        hand = rule_by_hand(r["host"], r["path"])
        assert r["rule"] == (hand and hand[1])
    assert urls.filter_urls(df.limit(0), "page_id", "url").count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    s = queries.op10_urls(spark, SF).toPandas()
    d = con.execute(queries.ORACLE["op10_urls"]).df()
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].where(f.notna(), None).itertuples(index=False)))
    assert key(s) == key(d)
