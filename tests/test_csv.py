import os

import pytest

from agrolith.operators.integrate import merge_sources
from agrolith.sources.csv import load_named, read_csv_strings, read_csv_tree, write_csv
from agrolith.sources.landing import land_tables


def test_csv_sources_and_sinks(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/in/sub")
    with open(f"{tmpdir_path}/in/a.csv", "w") as f:
        f.write("Item Code, Value ,Unit\n1,NA,t\n2,3.5,t\n")
    with open(f"{tmpdir_path}/in/sub/B.CSV", "w") as f:
        f.write("x\n1\n")
    df = read_csv_strings(spark, f"{tmpdir_path}/in/a.csv")
    assert [r[1] for r in df.collect()] == [None, "3.5"]
    got = load_named(spark, {"a": f"{tmpdir_path}/in/a.csv", "gone": f"{tmpdir_path}/missing.csv"})
    assert list(got) == ["a"] and got["a"].columns == ["item_code", "value", "unit"]
    write_csv(got["a"], f"{tmpdir_path}/out")
    back = read_csv_strings(spark, f"{tmpdir_path}/out")
    assert back.columns == ["item_code", "value", "unit"] and back.count() == 2
    paths = land_tables(got, f"{tmpdir_path}/land")
    land_tables(got, f"{tmpdir_path}/land")  # second landing leaves the table as it is
    assert spark.read.parquet(paths["a"]).count() == 2


def test_csv_tree_by_header_with_bad_files_reported(spark, tmpdir_path):
    files = {"a.csv": "Item Code, Value\n1,NA\n2,\"x,y\"\n", "sub dir/b.CSV": "Item Code, Value\n3\nItem Code, Value\n", "c.csv": "k,k,z\n1,2,3\n",
             "wide.csv": "p,q\n1,2\n1,2,3\n", "empty.csv": "", "blank.csv": "\n", "note.txt": "a,b\n", "bytes.csv": b"p,q\n\xff\xfe,1\n"}
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{tmpdir_path}/t/{name}"), exist_ok=True)
        with open(f"{tmpdir_path}/t/{name}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    groups, report = read_csv_tree(spark, f"{tmpdir_path}/t")
    got = {tuple(g.columns): (g.files, sorted(tuple(r)[:-1] for r in g.rows.collect())) for g in groups}
    # short lines end in nulls, a line equal to the header is data, repeated names get a number
    assert got[("Item Code", " Value")] == (2, sorted([("1", None), ("2", "x,y"), ("3", None), ("Item Code", " Value")], key=str)) or \
        sorted(got[("Item Code", " Value")][1], key=str) == sorted([("1", None), ("2", "x,y"), ("3", None), ("Item Code", " Value")], key=str)
    assert got[("k", "k.1", "z")] == (1, [("1", "2", "3")]) and len(groups) == 2
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in report.collect()}
    assert errors == {"a.csv": None, "b.CSV": None, "c.csv": None, "wide.csv": "expected 2 fields, saw 3", "empty.csv": "no columns",
                      "blank.csv": "no columns", "bytes.csv": "not UTF-8"}


def test_many_files_are_one_scan_a_header(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/m")
    for i in range(300):
        with open(f"{tmpdir_path}/m/{i}.csv", "w") as f:
            f.write(f"a,b\n{i},x\n" if i % 2 else f"a,c\n{i},y\n")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    groups, _ = read_csv_tree(spark, f"{tmpdir_path}/m")
    assert jobs() - before < 30  # far fewer than files
    assert [(g.columns, g.files, g.rows.count()) for g in groups] == [(["a", "b"], 150, 150), (["a", "c"], 150, 150)]


def test_a_missing_required_table_stops_the_job(spark, tmpdir_path):
    """the named file is absent, so its table is not loaded, and the integration says which."""
    for n in ("yield", "rainfall", "temp"):
        with open(f"{tmpdir_path}/{n}.csv", "w") as f:
            f.write("Area,Item,Year,Value\nx,y,2000,1\n")
    frames = load_named(spark, {n: f"{tmpdir_path}/{n}.csv" for n in ("yield", "rainfall", "temp", "pesticides")})
    assert set(frames) == {"yield", "rainfall", "temp"}
    with pytest.raises(RuntimeError, match="pesticides"):
        merge_sources(frames)
