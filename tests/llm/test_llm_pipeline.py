import math
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_llm_pii import CASES, LISTS
from test_llm_quality import grams_by_hand
from test_llm_rules import by_hand as base_measures
from test_llm_rules import removed_by_hand
from test_llm_simhash import components, fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from agrolith.llm import pii, quality, queries, rules

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and queries.QUERIES["pipeline"]


def keep_by_hand(docs, labels):
    """The classifier with dictionaries of counts and a full sort."""
    buckets = quality.BUCKETS
    grams = {i: grams_by_hand(t, buckets) for i, t in docs.items()}
    raw, target = np.full(buckets, quality.SMOOTH), np.full(buckets, quality.SMOOTH)
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += labels.get(i) == 1
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    total = {i: float(sum(ratio[b] for b in g)) for i, g in grams.items()}
    mean = lambda q: np.array([total[i] / len(grams[i]) for i in docs if grams[i] and i in labels and (labels[i] == 1) == q])
    tilt = quality.tilt_between(mean(True), mean(False))
    weight = {i: total[i] - len(g) * tilt for i, g in grams.items() if g}
    unit = lambda i: ((xxhash.xxh64_intdigest(struct.pack("<q", i), 42) >> 11) + 0.5) / (1 << 53)
    key = {i: w - math.log(-math.log(unit(i))) for i, w in weight.items()}
    k = sum(w >= 0 for w in weight.values())
    least = sorted(key.values(), reverse=True)[k - 1]
    return {i for i, x in key.items() if x >= least}


def accounts_by_hand(text):
    """Account numbers by a walk over the starts: as many characters as the country has, else the longest run of groups."""
    size_of = {c: n for n, cs in pii.IBAN_LENGTHS.items() for c in cs.split()}
    at = 0
    while at < len(text):
        head = re.match("[A-Z]{2}[0-9]{2}", text[at:at + 4])
        size, end, flat = size_of.get(text[at:at + 2]), at + 4, text[at:at + 4]
        if head and size is None:
            m = re.match("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9]{1,3})?", text[at:])
            flat, end = (m[0].replace(" ", ""), at + m.end()) if m else ("", at)
        elif head:
            while len(flat) < size:  # a space may stand before each group of four
                end += len(flat) % 4 == 0 and text[end:end + 1] == " "
                if not re.match("[A-Z0-9]", text[end:end + 1]):
                    break
                flat, end = flat + text[end], end + 1
        if head and flat and len(flat) == (size or len(flat)) and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
            yield at, end
            at = end
        else:
            at += 1


def redact_by_hand(text):
    rank_of = {k.name: i for i, k in enumerate(pii.KINDS)}
    spans = [(a, rank_of["iban"], b, "iban") for a, b in accounts_by_hand(text)]
    for name, pattern in queries.OP3_PATTERNS.items():
        k = pii.KINDS[rank_of[name]]
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            near = (text[max(0, m.start() - 40):m.start()] + " " + text[m.end():m.end() + 40]).lower()
            score = k.score + (pii.CONTEXT_BONUS if re.search(k.context, near) else 0)
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                  "phone": lambda: 10 <= len(digits) <= 15,
                  "ssn": lambda: not re.search("^(000|666|9)|-00-|-0000$", m[0])}[name]()
            if ok and (k.base or score >= pii.KEEP_SCORE):
                spans.append((m.start(), rank_of[name], m.end(), name))
    out, at = [], 0
    for a, _, b, name in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{name.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redaction_of_lists(spark):
    """Lists of numbers after one heading, account numbers beside other words: redaction against plain loops."""
    texts = [t for t in LISTS + CASES if t and len(t) < 500] + [" ".join(LISTS), "\n".join(LISTS[::-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.redact(df, "text").collect():
        assert r["text"] == redact_by_hand(texts[r["doc_id"]]), texts[r["doc_id"]]


def clean_by_hand(text):
    """(kept, text) of the line rules by plain loops."""
    seen, lost, left = set(), 0, []
    for line in text.split("\n"):
        if line.strip("\t\x0b\x0c\r ") and (line in seen or removed_by_hand(line)):
            lost += sum(c not in rules.SPACES for c in line)
        else:
            left.append(line)
        seen.add(line)
    _, chars, _, _, _, base_failed = base_measures(text)
    return not base_failed and lost <= 0.4 * chars, "\n".join(left)


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows, run one after the other."""
    from agrolith.llm.common import staged
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, []
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, SF), "test-pipeline")
        assert name == "packing" or docs.columns == columns
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_equals_brute_force(spark, stages):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    classified, ruled, deduped, private, packed = stages
    kept = keep_by_hand(docs, labels)
    assert {r["doc_id"] for r in classified} == kept
    cleaned = {i: clean_by_hand(docs[i]) for i in kept}
    cleaned = {i: text for i, (stays, text) in cleaned.items() if stays}
    assert {r["doc_id"]: r["text"] for r in ruled} == cleaned
    fps = {i: fingerprint(t) for i, t in cleaned.items()}
    roots = components(fps.values())
    first = {}
    for i, f in fps.items():
        first[roots[f]] = min(i, first.get(roots[f], i))
    assert {r["doc_id"] for r in deduped} == set(first.values()) and len(deduped) == len(first)
    final = {i: redact_by_hand(cleaned[i]) for i in first.values()}
    assert {r["doc_id"]: r["text"] for r in private} == final
    assert all(r["n_chars"] == len(r["text"]) for r in private)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(final)
    for i, parts in pieces.items():
        ids, at = plain.encode(final[i], add_special_tokens=False).ids + [1], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            cut = ids[at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)))
            at += r["length"]
        assert at == len(ids)


def test_good_documents_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = {r["doc_id"]: rules.judge(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1 and not docs[i].base_failed}
    left = {r["doc_id"] for r in stages[1]}
    assert len(good - left) <= 0.02 * len(good)


def test_edge_rows_go_through(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "A line without an id. " * 20, None, None, 5),
                                 (10**6 + 2, "word, " * 40_000, "en", "s", 1)], base.schema)
    twice = base.where("doc_id < 30")
    base.unionByName(odd).unionByName(twice).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen = [(r["doc_id"], r["start"]) for r in got]
    assert len(seen) == len(set(seen)) and not any(r["doc_id"] in (10**6, 10**6 + 1) for r in got)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
