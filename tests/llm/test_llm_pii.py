import hashlib
import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from agrolith.llm import pii, queries

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_by_hand(text):
    out = []
    for rank, kind in enumerate(("email", "ip", "card", "phone")):
        for m in re.finditer(queries.OP3_PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


CASES = [
    None, "", "no data", "mail a.b@c.de, a@b.c.@d.e and x@y", "a@b.c@d.ef+g@h.i.", "ip 1.2.3.4.5.6.7.8 or 300.1.1.1 or 007.0.0.255 1.2.3", "😀 10.0.0.1 é a@b.cd",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "1 4111111111111111", "41111111111111111111111", "4111111111111111 2", "phone +1 (706) 555-3138 and +49 30 123",
    "+1+1 706 555 3138 +", "IBAN GB82 WEST 1234 5698 7654 32 ok", "account DE89370400440532013000.", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "123-45-6789",
    "a@b." + "c." * 5000 + "d", "9" * 20000, "1.2." * 5000, "x" * 30000 + "@", "+1" + " " * 9000, "4111 1111 1111 1111\n5500 0000 0000 0004",
]


def test_equals_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(CASES)] + [(3, CASES[3], "clash")], "doc_id bigint, text string, spans string")
    got = pii.scan(df, "doc_id", "text").collect()
    assert len(got) == len(CASES) + 1
    for r in got:
        want = base_by_hand(CASES[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(line(want).encode()).hexdigest(), (CASES[r["doc_id"]] or "")[:80]
        for k, n in (("email", r["n_email"]), ("ip", r["n_ip"]), ("card", r["n_card"]), ("phone", r["n_phone"])):
            assert n == sum(w[3] == k for w in want)
    by = {r["doc_id"]: r["spans"] for r in got}
    assert "iban:5:32" in by[13] and "iban:" in by[14] and "iban" not in by[15]
    assert "ssn:4:15" in by[16] and "ssn" not in by[17]  # context decides
    assert pii.scan(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab1234567890.@+- (é\n", max_size=60), min_size=30, max_size=30))
def test_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.scan(df, "doc_id", "text").collect():
        assert r["base_sha256"] == hashlib.sha256(line(base_by_hand(texts[r["doc_id"]])).encode()).hexdigest(), texts[r["doc_id"]]


def test_redact(spark):
    rows = [(1, "a@b.cd 😀 and 10.0.0.1!", 7), (2, None, 7), (3, "", 7), (4, "plain", 7), (5, "+4111111111111111x", 7), (6, "call +4917612345678", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    got = pii.redact(df, "text")
    assert got.columns == df.columns
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by == {1: "[EMAIL] 😀 and [IP]!", 2: None, 3: "", 4: "plain", 5: "+[CARD]x", 6: "call [PHONE]"}
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    s = queries.op3_pii(spark, SF).toPandas()
    d = con.execute(queries.ORACLE["op3_pii"]).df()
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(str).itertuples(index=False)))
    assert key(s) == key(d)


LISTS = [
    "SSNs: 123-45-6789 and 234-56-7890.", "000-12-3456 234-56-7890 is an ssn", "ssn 123-45-6789 " + "x" * 29 + " 234-56-7890", "ssn 123-45-6789 " + "x" * 16 + " 234-56-7890",
    "SSN\n123-45-6789\n234-56-7890\n345-67-8901\n456-78-9012", "345-67-8901, 234-56-7890 é😀 ssn", "insurance: a@b.cd 123-45-6789, 10.0.0.1 234-56-7890 é",
    "BE68 5390 0754 7034 100 euro", "BE68 5390 0754 7034 EURO", "BE68 5390 0754 7034 GB82 WEST 1234 5698 7654 32 12", "DE89370400440532013000 DE89370400440532013000",
    "MT84MALT011000012345MTLCAST001S", "NO93 8601 1117 947", "NO93 8601 1117 948", "BE68 5390 0754 7035 100", "AT12 GB82 WEST 1234 5698 7654 32 AT12GB82WEST12345698765432",
]


def numbers_by_hand(text):
    """Security numbers with their context cut from the whole text, account numbers found by a walk over the starts."""
    out = []
    for m in re.finditer("[0-9]{3}-[0-9]{2}-[0-9]{4}", text):
        near = text[max(0, m.start() - 40):m.start()] + " " + text[m.end():m.end() + 40]
        if re.search("ssn|social security|insurance", near.lower()) and not re.search("^(000|666|9)|-00-|-0000$", m[0]):
            out.append((m.start(), 5, m.end(), "ssn"))
    at = 0
    while at < len(text):
        size = {"BE": 16, "GB": 22, "DE": 22, "MT": 31, "NO": 15}.get(text[at:at + 2])
        flat, end = "", at
        while size and end < len(text) and len(flat) < size and (text[end].isascii() and (text[end].isupper() or text[end].isdigit()) or text[end] == " "):
            flat += text[end].strip()
            end += 1
        if size and len(flat) == size and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
            out.append((at, 4, end, "iban"))
            at = end
        else:
            at += 1
    return out


def test_lists_of_numbers(spark):
    """Context reaches across neighbouring matches; account numbers end at their country's length."""
    df = spark.createDataFrame(list(enumerate(LISTS)), "doc_id bigint, text string")
    by = {r["doc_id"]: r["spans"] for r in pii.scan(df, "doc_id", "text").collect()}
    for i, text in enumerate(LISTS):
        assert by[i] == line(sorted(base_by_hand(text) + numbers_by_hand(text))), text
    counts = [by[i].count("ssn") for i in range(7)] + [by[i].count("iban") for i in range(7, len(LISTS))]
    assert counts == [2, 1, 1, 2, 4, 2, 2, 1, 1, 2, 2, 1, 1, 0, 0, 2]
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df, "text").collect()}
    assert redacted[0] == "SSNs: [SSN] and [SSN]." and redacted[8] == "[IBAN] EURO"


def test_twin_reads_the_context_of_lists_from_the_whole_text(spark):
    import duckdb
    texts = ["SSNs: 123-45-6789, 234-56-7890 and 345-67-8901.", "123-45-6789 " + "x" * 60 + " 234-56-7890 social security", "no 123-45-6789 here", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(df, "doc_id", "text").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    d = con.execute(queries.ORACLE["op3_pii"]).df()
    assert dict(zip(d["doc_id"], d["spans"])) == got
    assert got[0].count("ssn") == 3 and got[1].count("ssn") == 1 and got[2] == ""


def made_numbers(rng, country, size):
    """A valid account number, in groups of four or without."""
    body = "".join(rng.choices("0123456789ABCXYZ", k=size - 4))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    flat = f"{country}{check:02d}{body}"
    return flat if rng.random() < 0.4 else " ".join(flat[i:i + 4] for i in range(0, size, 4))


def test_twin_finds_the_same_account_numbers(spark):
    """Lists of account numbers of every country, cut short, run together and in other words: operator and twin agree on each span."""
    rng = random.Random(6)
    known = [(c, n) for n, cs in pii.IBAN_LENGTHS.items() for c in cs.split()]
    texts = list(LISTS)
    for c, n in known + [("ZZ", 20), ("QQ", 24), ("QQ", 23)] * 4:
        parts = []
        for _ in range(rng.randrange(1, 5)):
            x = made_numbers(rng, c, n) if rng.random() < 0.7 else made_numbers(rng, *rng.choice(known))
            cut = rng.random()
            parts.append(x[:-rng.randrange(1, 9)] if cut < 0.15 else x[rng.randrange(1, 9):] if cut < 0.25 else x)
        texts.append(rng.choice(["", "pay to ", "é😀 AB12", "X"]) + rng.choice([" ", "", ", ", " 12 ", " AND "]).join(parts) + rng.choice(["", ".", " 1", " EURO"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(df, "doc_id", "text").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    twin = dict(con.execute(queries.ORACLE["op3_pii"]).df()[["doc_id", "spans"]].itertuples(index=False))
    assert [(t, twin[i]) for i, t in enumerate(texts) if twin[i] != got[i]] == [(t, got[i]) for i, t in enumerate(texts) if twin[i] != got[i]]
    assert sum(x.count("iban") for x in got.values()) > 100
