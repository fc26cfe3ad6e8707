import math
import re
from collections import Counter

import duckdb

from agrolith.llm import licenses, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(["Words of a document that go on for a while and say nothing of rights."] * 4)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def segments(text):
    """The candidates of one text."""
    speaks = lambda t: any(x in t for x in licenses.TRIGGERS)
    text = low(text or "")
    if not speaks(text):
        return set()
    clean = lambda x: re.sub(r"[ \t\r]+", " ", re.sub(licenses.CLOSING_MARKS, "", re.sub(licenses.OPENING_MARKS, "", x, count=1)))
    paras = [p for p in re.split(r"\n\n+", "\n".join(clean(x) for x in text.split("\n"))) if p]
    out = []
    for p in paras:
        if not speaks(p):
            continue
        out += [x for x in re.split(r"\n|[.;!?][ \t]+", p) if speaks(x)]
        sent = re.split(r"[.;!?][ \t]+", p.replace("\n", " "))
        out += [" ".join(sent[i:i + k]) for i in range(len(sent)) for k in range(1, 5) if any(map(speaks, sent[i:i + k]))]
    out += [" ".join(paras[i:i + k]).replace("\n", " ") for i in range(len(paras)) if speaks(paras[i]) for k in range(1, 7)]
    out.append(" ".join(paras).replace("\n", " "))
    known = {w for _, t in licenses.TEMPLATES for w in re.findall(licenses.TOKENS, low(t))}
    half = lambda x: 2 * sum(w in known for w in re.findall(licenses.TOKENS, x)) >= len(re.findall(licenses.TOKENS, x))
    return {x.strip(" ") for x in out if half(x)} - {""}


def brute(docs):
    """(license, score, covers half) declared by each text."""
    segs = {i: segments(text) for i, (_, _, text) in enumerate(docs)}
    toks = lambda s: re.findall(licenses.TOKENS, s)
    count = Counter(s for v in segs.values() for s in v)
    tem = [(n, Counter(toks(low(t)))) for n, t in licenses.TEMPLATES]
    df = Counter()
    for s, c in count.items():
        df.update({t: c for t in set(toks(s))})
    for _, c in tem:
        df.update(c.keys())
    n = sum(count.values()) + len(tem)
    vec = lambda c: {t: f * (math.log((n + 1) / (df[t] + 1)) + 1) for t, f in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    tw = [(name, vec(c)) for name, c in tem]
    best = {}
    for s in count:
        have, v = set(toks(s)), vec(Counter(toks(s)))
        for name, w in tw:
            if all(have & set(g) for g in licenses.MUST.get(name, ())) and not have & set(licenses.MUST_NOT.get(name, ())):
                score = round(sum(v[t] * w[t] for t in v if t in w) / (norm(v) * norm(w)), 4)
                if score >= licenses.MIN_SCORE:
                    best[s] = min(best.get(s, (0, "")), (-score, name))
    out = {}
    for i, mine in segs.items():
        found = [(best[s], len(toks(s))) for s in mine if s in best]
        if found:
            (score, name), _ = min(found)
            covered = max(k for (_, x), k in found if x == name)
            out[i] = (name, -score, 2 * covered >= len(toks(low(docs[i][2]))))
    return out


DOCS = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0. " + LONG), (2, "a/b/c/x.txt", LONG), (3, "a/b/COPYING", LONG + "\nReleased under the MIT License."),
    (4, "a/b/y.txt", None), (5, "z/q.txt", ""), (6, None, "Licensed under CC BY-NC 4.0."), (7, "a/b/c/x.txt", LONG + "\nLicensed under CC BY-NC 4.0. More"),
    (8, "top.txt", LONG), (9, "d/e/f.txt", "This work is licensed under the GNU General Public License, version 3."), (10, "d/e/g/h/i", LONG), (11, "d/ee/j", LONG),
    (2, "a/b/c/x.txt", LONG), (12, "k/l", "LICENSED UNDER THE MIT license agreement copyright " + "other " * 40), (None, "a//b/m", "x " * 100),
]


def test_declared_and_nearest_directory(spark):
    df = spark.createDataFrame([(*r, "c") for r in DOCS], "doc_id bigint, path string, text string, license string")
    got = licenses.scan(df).collect()
    assert len(got) == len(DOCS)
    by = {r["doc_id"]: r for r in got}
    for i, (name, score, _) in brute(DOCS).items():
        r = by[DOCS[i][0]]
        assert (r["license"], r["status"]) == (name, "declared") and abs(r["score"] - score) < 2e-4
    assert sum(r["status"] == "declared" for r in got) == len(brute(DOCS))
    place = lambda i: (by[i]["license"], by[i]["status"], by[i]["inherited_from"])
    assert place(2) == ("MIT", "inherited", "a/b") and place(4) == ("MIT", "inherited", "a/b") and place(None) == ("MIT", "inherited", "a/b")
    assert place(10) == ("GPL-3.0", "inherited", "d/e") and place(11) == (None, "none", None) and place(8) == (None, "none", None)
    assert place(6) == ("CC-BY-NC-4.0", "declared", None) and place(5) == (None, "none", None)
    assert licenses.scan(df.limit(0)).count() == 0


#: Headers as they stand in files, by licence.
GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"),
       "AGPL-3.0": ("Affero General", "3")}
HEADERS = {k: f"""This {'program' if 'L' != k[0] else 'library'} is free software{';' if v[0] == '2' else ':'} you can redistribute it and/or modify it under the terms of the
GNU {t} Public License as published by the Free Software Foundation{';' if v[0] == '2' else ','} either version {v} of the License, or (at your option)
any later version.""" for k, (t, v) in GNU.items()} | {
    "Apache-2.0": licenses._APACHE, "MIT": licenses._MIT, "BSD-2-Clause": licenses._BSD + licenses._BSD_END,
    "BSD-3-Clause": licenses._BSD + licenses._BSD_NAME + licenses._BSD_END, "MPL-2.0": licenses._MPL, "ISC": licenses._ISC, "Unlicense": licenses._UNLICENSE}
TITLES = {"GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n    Version 2, June 1991", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007",
          "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999", "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007",
          "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007", "MPL-2.0": "Mozilla Public License Version 2.0\n====",
          "Apache-2.0": "        Apache License\n    Version 2.0, January 2004\n  http://www.apache.org/licenses/"}
CODE = "\n\nint main(void) {\n  return compute(1, 2);\n}\n" * 5


def wrapped(text, mark, width=60):
    import textwrap
    return "\n".join(mark + x for x in textwrap.wrap(" ".join(text.split()), width))


def test_headers_of_every_licence_wrapped_commented_and_on_one_line(spark):
    rows, want = [], {}
    for name, text in HEADERS.items():
        for mark in ("", "# ", "// ", " * ", None):
            body = " ".join(text.split()) if mark is None else wrapped(text, mark)
            if mark == " * ":
                body = "/*\n * Copyright (C) 2020 Someone\n *\n" + body + "\n */"
            want[len(rows)] = name
            rows.append((len(rows), f"p{len(rows)}/src/x.c", body + CODE))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert {i: r["license"] for i, r in got.items()} == want and all(r["status"] == "declared" for r in got.values())
    for i, (name, score, _) in brute(rows).items():
        assert got[i]["license"] == name and abs(got[i]["score"] - score) < 2e-4


def test_whole_licence_files_of_any_length_are_inherited(spark):
    """Long files by their name and title, short licences by what they cover; posts that only mention one set nothing."""
    body = ("\n\nThe precise terms and conditions for copying, distribution and modification follow. You may convey covered works under this License."
            " The licensee accepts the license of each contributor.") * 120
    rows, want = [], {}
    for name in [*TITLES, "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"]:
        text = TITLES[name] + body if name in TITLES else "Copyright (c) 2021 A. Person\n\n" + wrapped(HEADERS[name], "", 76)
        rows.append((len(rows), f"{name}/LICENSE" if name in TITLES else f"{name}/terms.txt", text))
        rows.append((len(rows), f"{name}/deep/er/x.txt", LONG))
        want[len(rows) - 1] = (name, "inherited", name)
    rows.append((900, "post/a.txt", LONG + " Licensed under the Apache License, Version 2.0."))
    rows.append((901, "post/b.txt", LONG))
    want |= {900: ("Apache-2.0", "declared", None), 901: (None, "none", None)}
    got = {r["doc_id"]: (r["license"], r["status"], r["inherited_from"]) for r in
           licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert {i: got[i] for i in want} == want


def test_root_and_hot_sentence(spark):
    rows = [(i, f"d{i % 3}/{i}", LONG + "\nReleased under the MIT License.") for i in range(300)] + [(300, "LICENSE", "Licensed under CC BY 4.0."), (301, "e/f/g", LONG)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert all(got[i]["license"] == "MIT" for i in range(300))
    assert (got[301]["license"], got[301]["inherited_from"]) == ("CC-BY-4.0", "")


def test_query_is_native_and_equals_sql(spark):
    df = queries.op1_licenses(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    d = con.execute(queries.ORACLE["op1_licenses"]).df()
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(str).replace({"nan": "None", "NaN": "None", "<NA>": "None"}).itertuples(index=False)))
    assert key(df.toPandas()) == key(d)
