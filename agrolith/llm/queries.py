"""The registered queries of this package and their SQL twins.

Each ``opN_<name>`` applies one operator, with production parameters, to its
whole table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from agrolith.llm import bpe, html, kmeans, licenses, packing, pii, quality, rules, simhash, topk, toxicity, trie, urls
from agrolith.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / language / hundred of the id / id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(
        "/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.floor(F.col("doc_id") / 100).cast("string"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return licenses.scan(docs, "doc_id", "text", "path")


def _op1_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quote, xs)) + "]"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = ", ".join(f"({i}, {quote(n)}, {quote(t.translate(str.maketrans(upper, lower)))})" for i, (n, t) in enumerate(licenses.TEMPLATES))
    speaks = lambda c: "(" + " OR ".join(f"contains({c}, {quote(t)})" for t in licenses.TRIGGERS) + ")"
    fits = " ".join(f"WHEN {quote(n)} THEN " + " AND ".join(
        [f"list_has_any(tokens, {listed(g)})" for g in licenses.MUST.get(n, ())] + [f"NOT list_has_any(tokens, {listed(licenses.MUST_NOT.get(n, ()))})"] * (n in licenses.MUST_NOT)
        or ["true"]) for n in sorted({n for n, _ in licenses.TEMPLATES}))
    runs = lambda parts, most: (
        f"flatten(list_transform(range(1, len({parts}) + 1), lambda i: list_transform(range(1, least({most}, len({parts}) - i + 1) + 1), "
        f"lambda k: struct_pack(a := {speaks(parts + '[i]')}, s := len(list_filter({parts}[i:i + k - 1], lambda p: {speaks('p')})) > 0, "
        f"t := array_to_string({parts}[i:i + k - 1], ' ')))))")
    return rf"""
WITH tem(t, license, text) AS (VALUES {rows}),
base AS (SELECT doc_id, coalesce(text, '') AS text,
    coalesce(source, '') || '/' || coalesce(lang, '') || '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) AS dir FROM documents),
low AS (SELECT doc_id, translate(text, '{upper}', '{lower}') AS low FROM base),
lin AS (SELECT doc_id, low, list_transform(string_split(low, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x,
    '{licenses.OPENING_MARKS}', ''), '{licenses.CLOSING_MARKS}', ''), '[ 	
]+', ' ', 'g')) AS lines FROM low WHERE {speaks('low')}),
par AS (SELECT doc_id, low, list_filter(string_split_regex(array_to_string(lines, chr(10)), '

+'), lambda p: p <> '') AS ps FROM lin),
joi AS (SELECT doc_id, list_transform(ps, lambda p: replace(p, chr(10), ' ')) AS ps FROM par),
spo AS (SELECT doc_id, unnest(list_filter(ps, lambda p: {speaks('p')})) AS p FROM par),
sen AS (SELECT doc_id, string_split_regex(replace(p, chr(10), ' '), '{licenses.SENTENCES}') AS s FROM spo),
seg AS (
  SELECT doc_id, unnest(string_split_regex(p, '
|{licenses.SENTENCES}')) AS seg, true AS one FROM spo
  UNION ALL SELECT doc_id, r.t, r.s FROM (SELECT doc_id, unnest({runs('s', licenses.SENTENCE_RUN)}) AS r FROM sen)
  UNION ALL SELECT doc_id, r.t, r.a FROM (SELECT doc_id, unnest({runs('ps', licenses.PARAGRAPH_RUN)}) AS r FROM joi)
  UNION ALL SELECT doc_id, array_to_string(ps, ' '), true FROM joi),
voc AS (SELECT list(DISTINCT w) AS v FROM (SELECT unnest(regexp_extract_all(text, '{licenses.TOKENS}')) AS w FROM tem)),
can AS (SELECT DISTINCT doc_id, trim(seg, ' ') AS seg FROM seg WHERE one AND trim(seg, ' ') <> ''),
cand AS (SELECT doc_id, seg FROM can, voc WHERE 2 * len(list_filter(regexp_extract_all(seg, '{licenses.TOKENS}'), lambda w: list_contains(v, w)))
  >= len(regexp_extract_all(seg, '{licenses.TOKENS}'))),
segs AS (SELECT seg, count(*) AS c, regexp_extract_all(seg, '{licenses.TOKENS}') AS tokens FROM cand GROUP BY seg),
stok AS (SELECT seg, c, token, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT seg, c, unnest(tokens) AS token FROM segs) GROUP BY ALL),
ttok AS (SELECT t, license, token, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT t, license, unnest(regexp_extract_all(text, '{licenses.TOKENS}')) AS token FROM tem) GROUP BY ALL),
df AS (SELECT token, sum(c) AS df FROM (SELECT token, c FROM stok UNION ALL SELECT token, 1 FROM ttok) GROUP BY token),
idf AS (SELECT token, ln(((SELECT coalesce(sum(c), 0) + {len(licenses.TEMPLATES)} FROM segs) + 1) / (df + 1)) + 1 AS idf FROM df),
tw AS (SELECT t, license, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS tw FROM ttok JOIN idf USING (token)),
sw AS (SELECT seg, token, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY seg)) AS norm FROM stok JOIN idf USING (token)),
cos AS (SELECT seg, t, license, round(sum(w * tw) / any_value(norm), 4) AS score FROM sw JOIN tw USING (token) GROUP BY ALL),
fit AS (SELECT seg, license, max(score) AS score, any_value(len(tokens)) AS n FROM cos JOIN segs USING (seg)
  WHERE score >= {licenses.MIN_SCORE} AND CASE license {fits} END GROUP BY seg, license),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY seg ORDER BY score DESC, license) = 1),
met AS (SELECT doc_id, license, max(score) AS score, max(n) AS covered FROM cand JOIN best USING (seg) GROUP BY doc_id, license),
own AS (SELECT m.doc_id, license, score, 2 * covered >= len(regexp_extract_all(low, '{licenses.TOKENS}')) AS whole FROM met m JOIN low USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY m.doc_id ORDER BY score DESC, license) = 1),
marked AS (SELECT b.doc_id, b.dir, o.license, o.score, o.whole FROM base b LEFT JOIN own o USING (doc_id)),
files AS (SELECT array_to_string(list_filter(string_split(dir, '/'), lambda p: p <> ''), '/') AS at, license, score FROM marked
  WHERE license IS NOT NULL AND whole
  QUALIFY row_number() OVER (PARTITION BY array_to_string(list_filter(string_split(dir, '/'), lambda p: p <> ''), '/') ORDER BY score DESC, license) = 1),
parts AS (SELECT DISTINCT dir, list_filter(string_split(dir, '/'), lambda p: p <> '') AS ps FROM marked),
ups AS (SELECT dir, ps, unnest(range(0, len(ps) + 1)) AS up FROM parts),
near AS (SELECT u.dir, f.at, f.license, f.score FROM ups u JOIN files f ON f.at = array_to_string(u.ps[1:len(u.ps) - u.up], '/')
  QUALIFY row_number() OVER (PARTITION BY u.dir ORDER BY u.up) = 1)
SELECT m.doc_id, m.dir || '/' || CAST(m.doc_id AS VARCHAR) || '.txt' AS path, coalesce(m.license, n.license) AS license,
       coalesce(m.score, n.score) AS score,
       CASE WHEN m.license IS NOT NULL THEN 'declared' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS status,
       CASE WHEN m.license IS NULL THEN n.at END AS inherited_from
FROM marked m LEFT JOIN near n ON m.dir = n.dir
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fp(F.col("fp")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"), "doc_id", "text").drop("scores")


#: The plain patterns of the base kinds and of security numbers; account numbers are read by their country's length.
OP3_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def _op3_sql() -> str:
    kinds = {k.name: k for k in pii.KINDS}
    ranks = {k.name: i for i, k in enumerate(pii.KINDS)}
    found = " UNION ALL ".join(
        f"SELECT rid, text, '{k}' AS kind, {ranks[k]} AS rank, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces "
        f"FROM d WHERE regexp_matches(text, '{p}')" for k, p in OP3_PATTERNS.items())
    head = "[A-Z]{2}[0-9]{2}"
    sizes = ", ".join(f"'{c}': {n}" for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split())
    context = " ".join(f"WHEN '{k}' THEN regexp_matches(near, '{v.context}')" for k, v in kinds.items())
    scores = " ".join(f"WHEN '{k}' THEN {v.score}" for k, v in kinds.items())
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    turned = "(replace(hit, ' ', '')[5:] || replace(hit, ' ', '')[:4])"
    counts = ", ".join(f"CAST(count(s.kind) FILTER (s.kind = '{k}') AS BIGINT) AS n_{k}" for k, v in kinds.items() if v.base)
    line = "s.kind || ':' || s.a || ':' || s.b"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k AS ({found}),
heads AS (SELECT rid, text, unnest(string_split_regex(text, '{head}')[:-2]) AS before,
    unnest(range(1, len(regexp_extract_all(text, '{head}')) + 1)) AS i FROM d WHERE regexp_matches(text, '{head}')),
starts AS (SELECT rid, text, CAST(sum(length(before) + 4) OVER (PARTITION BY rid ORDER BY i) - 4 AS BIGINT) AS a FROM heads),
sized AS (SELECT *, substr(text, a + 1, 64) AS rest, MAP {{{sizes}}}[substr(text, a + 1, 2)] AS size FROM starts),
grouped AS (SELECT *, regexp_extract(rest, '^{head}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[0-9]{{1,3}})?') AS other FROM sized),
-- the characters of the country's length, cut from the groups of four and the shorter group behind them
accounts AS (SELECT rid, text, a, CASE WHEN size IS NULL THEN other ELSE coalesce(list_filter(
    list_transform(range(size, size + 12), lambda n: regexp_extract(left(rest, CAST(n AS INTEGER)), '^{head}(?: ?[A-Z0-9]{{4}})*(?: ?[A-Z0-9]{{1,3}})?$')),
    lambda x: length(replace(x, ' ', '')) = size AND right(x, 1) <> ' ')[1], '') END AS hit FROM grouped),
e AS (SELECT rid, text, kind, rank, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS before, unnest(pieces[2:len(hits) + 1]) AS after,
             unnest(range(1, len(hits) + 1)) AS i FROM k),
o AS (SELECT rid, text, kind, rank, hit, CAST(sum(length(before) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS b FROM e
  UNION ALL SELECT rid, text, 'iban', {ranks["iban"]}, hit, a + length(hit) FROM accounts WHERE hit <> ''),
p AS (SELECT *, lower(right(left(text, b - length(hit)), {pii.CONTEXT_CHARS}) || ' ' || substr(text, b + 1, {pii.CONTEXT_CHARS})) AS near FROM o),
v AS (SELECT rid, kind, rank, b - length(hit) AS a, b,
  CASE kind {scores} END + CASE WHEN CASE kind {context} END THEN {pii.CONTEXT_BONUS} ELSE 0 END AS score,
  CASE kind
    WHEN 'ip' THEN regexp_matches(hit, '^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]{{1,2}})(\.|$)){{4}}$')
    WHEN 'card' THEN length({digits}) BETWEEN 14 AND 19 AND
      list_sum(list_transform(range(1, length({digits}) + 1), lambda j:
        CASE WHEN j % 2 = 1 THEN CAST(reverse({digits})[j] AS INTEGER)
             ELSE 2 * CAST(reverse({digits})[j] AS INTEGER) - CASE WHEN CAST(reverse({digits})[j] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length({digits}) BETWEEN 10 AND 15
    WHEN 'iban' THEN list_reduce(list_transform(range(1, length({turned}) + 1), lambda j: ascii({turned}[j])),
        lambda acc, c: CASE WHEN c < 65 THEN (acc * 10 + c - 48) % 97 ELSE (acc * 100 + c - 55) % 97 END, 0) = 1
    WHEN 'ssn' THEN NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$')
    ELSE true END AS ok FROM p),
f AS (SELECT rid, kind, rank, a, b FROM v WHERE ok AND (rank < 4 OR score >= {pii.KEEP_SCORE})),
-- of account numbers that overlap the first stays
n AS (SELECT rid, list_reduce(list(struct_pack(b := b, kept := [struct_pack(a := a, b := b)]) ORDER BY a), lambda x, y:
    CASE WHEN y.kept[1].a >= x.b THEN struct_pack(b := y.b, kept := x.kept || y.kept) ELSE x END).kept AS kept FROM f WHERE kind = 'iban' GROUP BY rid),
s AS (SELECT * FROM f WHERE kind <> 'iban'
  UNION ALL SELECT rid, 'iban', {ranks["iban"]}, k.a, k.b FROM (SELECT rid, unnest(kept) AS k FROM n))
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({line}, ',' ORDER BY s.a, s.rank) FILTER (s.rank < 4), '')) AS base_sha256,
       coalesce(string_agg({line}, ',' ORDER BY s.a, s.rank) FILTER (s.kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY d.rid, d.doc_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("bigint"))
    vectors = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & finite).select("vec_id", scaled.alias("v"))
    return topk.top_k(vectors, "vec_id", "v", lambda i: i % 20 == 0, k=20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def _glob_sql(glob: str) -> str:
    """A regular expression over host || chr(10) || path for a glob without a rule."""
    import re
    host, path, tail = urls.parse_glob(glob)
    part = lambda text, any_: "".join(any_ + "*" if c == "*" else any_ if c == "?" else re.escape(c) for c in text)
    return "^" + part(host, "[^\\n]") + "\\n" + part(path, ".") + ("" if tail else "$")


def _op10_sql() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
            for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in urls.RULES)
    bad = " OR ".join(f"regexp_matches('.' || host || chr(10) || path, '{_glob_sql(g)}', 's')" for g in urls.BLOCK_GLOBS)
    return f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM u),
r AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM s)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN {bad} THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt ``conversations``, with their subtree totals."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END))) % 6 AS h FROM t),
r AS (
  SELECT i.c, t.pos AS d, t.role, t.text FROM ids i JOIN t ON t.c = i.c - i.c % 100 AND t.pos <= i.h
  UNION ALL
  SELECT i.c, t.pos - i.h + least(i.h, (SELECT count(*) FROM t b WHERE b.c = i.c - i.c % 100)), t.role, t.text FROM ids i JOIN t ON t.c = i.c AND t.pos > i.h),
p AS (
  SELECT c, d, length(text) AS chars, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS seq FROM r
  UNION ALL SELECT c, 0, 0, [] FROM ids),
len AS (SELECT c, max(d) AS n FROM p GROUP BY c),
n AS (
  SELECT d, seq, min(p.c) AS rep, count(*) AS n_convs, any_value(chars) AS chars,
         coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (p.d = len.n), '') AS ends
  FROM p JOIN len ON p.c = len.c GROUP BY d, seq),
through AS (SELECT p.c, p.d, n.rep FROM p JOIN n ON p.d = n.d AND p.seq = n.seq),
up AS (SELECT n.rep, n.d, a.rep AS parent FROM n LEFT JOIN through a ON a.c = n.rep AND a.d = n.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, up.parent, coalesce(kids.k, 0) AS k FROM n JOIN up ON n.rep = up.rep AND n.d = up.d
      LEFT JOIN kids ON kids.parent = n.rep AND kids.d = n.d),
sums AS (
  SELECT a.rep, a.d, sum(CASE WHEN v.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((v.n_convs - 1) * v.chars) AS saved
  FROM v JOIN through a ON a.c = v.rep AND a.d <= v.d GROUP BY a.rep, a.d)
SELECT v.rep AS conv_id, CAST(v.d AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n_convs, CAST(v.k AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN sums s ON v.rep = s.rep AND v.d = s.d
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; labels are learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id")).select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.fit(docs, labels, "doc_id", "text")
    return toxicity.score(docs, "doc_id", "text", model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "n_hits", "n_mentions")


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of the 64-component ``embeddings``, three rounds and a last assignment."""
    good = (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("bigint"))
    vectors = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & good).select("vec_id", scaled.alias("v"))
    rows, centres, _ = kmeans.cluster(vectors, "vec_id", "v", 16, 3, F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    named = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centres)], "cluster int, parts string")  # 16 rows
    return rows.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("parts", 256).alias("centroid_sha256"))


def _op13_sql() -> str:
    near = lambda c: f"""SELECT v.vec_id, v.e, arg_min(c.j, {{'d': list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'j': c.j}}) AS j,
         min(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM v CROSS JOIN {c} c GROUP BY v.rid, v.vec_id, v.e"""  # noqa: E731
    rounds = ",".join(f"""
a{r} AS ({near(f'c{r}')}),
s{r} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY j, i),
m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY j),
c{r + 1} AS (SELECT c.j, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON c.j = m.j)""" for r in range(3))
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS j, e FROM v
       QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) <= 16),{rounds},
f AS ({near('c3')})
SELECT f.vec_id, CAST(f.j AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance,
       CAST(sum(f.d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM f JOIN c3 c ON f.j = c.j
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_rules": op8_rules,
    "op9_bpe": op9_bpe,
    "op10_urls": op10_urls,
    "op11_trie": op11_trie,
    "op12_toxicity": op12_toxicity,
    "op13_kmeans": op13_kmeans,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {"op1_licenses": _op1_sql(), "op3_pii": _op3_sql(), "op5_topk": OP5_SQL, "op10_urls": _op10_sql(),
                          "op11_trie": OP11_SQL, "op13_kmeans": _op13_sql()}
