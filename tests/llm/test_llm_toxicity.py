import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agrolith.llm import queries, toxicity

WORDS = {"idiot": 1.0, "worthless": 1.0, "scum": 0.95, "loser": 0.7}
STEMS = {"achlich": 1.0, "veju": 0.8}


def edits(a, b):
    """Edit distance with swaps of neighbours (each letter edited once)."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def by_hand(word):
    cost = [2 * e + (p < toxicity.SURE_SHARE) for w, p in WORDS.items() if (e := edits(word, w)) <= toxicity.edits(w, False)]
    whole = min(cost, default=None)
    cost = [2 * e + (p < toxicity.SURE_SHARE) for s, p in STEMS.items() for i in range(1, len(word) + 1) if (e := edits(word[:i], s)) <= toxicity.edits(s, True)]
    best = min([c for c in (whole, min(cost, default=None)) if c is not None], default=None)
    return None if best is None else "near" if best > 1 else "weak" if best else "word" if whole == 0 else "stem"


def test_automaton_equals_edit_distances():
    rng = random.Random(4)
    machine = toxicity.Automaton(WORDS, STEMS)
    seen = Counter()
    for _ in range(6000):
        w = list(rng.choice([*WORDS, *STEMS]) + rng.choice(["", "", "en", "xyz"]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w)) if w else 0
            kind = rng.random()
            if kind < 0.3 and w:
                w[i] = rng.choice("abcehilostuv")
            elif kind < 0.55:
                w.insert(i, rng.choice("abcehilostuv"))
            elif kind < 0.75 and w:
                del w[i]
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        word = "".join(w)
        if word:
            assert machine.match(word) == by_hand(word), word
            seen[by_hand(word)] += 1
    assert all(seen[k] > 100 for k in (*toxicity.KINDS, None))


def test_states_made_anew_change_nothing(monkeypatch):
    monkeypatch.setattr(toxicity, "_STATES", 3)
    machine = toxicity.Automaton(WORDS, STEMS)
    assert [machine.match(w) for w in ("idiot", "idoit", "achlichung", "wortless", "tree", "vejux", "loser")] == \
        ["word", "near", "stem", "near", None, "weak", "weak"]


def model():
    return toxicity.Model(WORDS, STEMS, {"idiom": 3}, toxicity.belief(0.1))


def test_window_tells_quotation_from_abuse():
    s = toxicity.Scorer(model())
    assert s.hits("what an idiot, really") == {("word", "plain"): 1}
    assert s.hits('the label "idiot" was used') == s.hits("the «total idiot» label") == s.hits("she said idiot") == {("word", "mention"): 1}
    assert s.hits('"hello there" you idiot') == {("word", "plain"): 1}
    assert s.hits("idiot and scum") == {("word", "dense"): 2}
    assert s.hits("IDIOT!!! idoit... idiom") == {("word", "dense"): 1, ("near", "dense"): 1}
    abuse, quoted, nothing = (s.score(s.hits(t)) for t in ("you idiot, you worthless scum", 'the word "idiot" is old', ""))
    assert abuse >= toxicity.THRESHOLD > quoted > nothing


def corpus(spark):
    """Invented prose; toxic documents hold made-up words, and one toxic document has many copies."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    copy = " ".join(rng.choice(words) for _ in range(20)) + " zzcopied zzmarker muppetry"
    for i in range(900):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["muppetry", "blockhead", "Blockhead!", "nitwitted", "quarx" + rng.choice(words)]))
        rows.append((i, copy if i % 60 == 0 else " ".join(text), 7, "s"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, id int, score string").repartition(5), spark.createDataFrame(labels, "id bigint, toxic int")


def test_learns_words_and_stems_but_not_the_words_of_copies(spark):
    docs, labels = corpus(spark)
    m = toxicity.fit(docs, labels, "doc_id", "text")
    assert {"muppetry", "blockhead", "nitwitted"} <= set(m.words) and not {"zzcopied", "zzmarker"} & set(m.words)
    assert any("quarx".startswith(s) for s in m.stems)
    fresh = spark.createDataFrame([(1, "an muppetryy and blokchead too"), (2, "quarxnever of quarxseen"), (3, "plain abc text"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in toxicity.score(fresh, "doc_id", "text", m).collect()}
    assert [got[i]["predicted"] for i in (2, 3, 4, 5)] == [1, 0, 0, 0] and got[1]["n_hits"] == 2
    assert got[3]["score"] == got[4]["score"] == got[5]["score"] < got[1]["score"]


def test_edge_cases(spark):
    docs, labels = corpus(spark)
    none = labels.where("false")
    m = toxicity.fit(docs, none, "doc_id", "text")
    assert not m.words and {r["predicted"] for r in toxicity.score(docs, "doc_id", "text", m).collect()} == {0}
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1), (2, 0)], "id bigint, toxic int")
    toxicity.fit(docs, odd, "doc_id", "text")
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert toxicity.score(empty, "doc_id", "text", toxicity.fit(empty, labels, "doc_id", "text")).count() == 0
    long = spark.createDataFrame([(None, "abc " * 500_000 + "idiot"), (None, "abc " * 500_000 + "idiot"), (3, "x" * 300_000)], "doc_id bigint, text string")
    got = toxicity.score(long, "doc_id", "text", model()).collect()
    assert sorted(r["n_hits"] for r in got) == [0, 1, 1]


@pytest.mark.parametrize("sf,recall", [("0.01", 0.8), ("0.1", 0.85)])
def test_held_out_accuracy(spark, sf, recall):
    d = f"/root/testdata/sf{sf}"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op12_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p for t, p in held if t) >= recall * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.01 * sum(not t for t, _ in held)


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(spark)
    seen = lambda lab: toxicity.fit(docs, lab.where(~toxicity.held_out("id")), "doc_id", "text")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert seen(labels) == seen(turned)
