"""Toxicity: Levenshtein automata intersected with a lexicon trie, and the window around each hit.

The lexicon is learned from labelled documents: words, and stems of word
families, that toxic documents hold far more often than chance. Its trie is
walked together with the Levenshtein automata of its entries (substitution,
insertion, deletion, swap of neighbours): an automaton's state is the set of
(trie node, edits so far) that the letters read can stand for, made when first
reached and kept, so a word costs one look-up per letter and stops at the empty
set. Longer entries allow more edits; a misspelling that clean documents use as
a word of its own is none.

Each hit is judged by the words around it: quotation marks around it or a
reporting word before it make it a mention, other hits nearby make it denser.
A document's score is a logistic function of how many hits of each kind and
surrounding it has; the weights are learned too, starting from beliefs that
count for more the fewer labels there are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import staged, with_workers

#: The model is fitted on at most this many labelled documents of each class, by hash of the id.
LABEL_ROWS = 20_000
#: Largest numbers of learned words and stems.
MAX_TERMS, MAX_STEMS = 20_000, 2_000
#: Share of toxic documents among those with an entry, and words a family must have.
MIN_SHARE, MIN_FAMILY = 0.6, 4
#: Entries with a smaller share are hits of a kind of their own.
SURE_SHARE = 0.9
STEM_CHARS = (3, 8)
WINDOW = 6
THRESHOLD = 0.7
KINDS = ("word", "stem", "weak", "near")
AROUND = ("mention", "plain", "dense")
#: Log odds a hit adds before any label is seen, its surrounding's share of them, and how firmly that is believed.
BELIEF = {"word": 5.0, "stem": 4.0, "weak": 2.0, "near": 1.0}
BELIEF_AROUND = {"mention": 0.2, "plain": 1.0, "dense": 1.2}
FIRMNESS = 0.5
#: Hits of one class beyond this number count no more.
MOST_HITS = 7

# Marks that open or close a quotation, and words that report speech (en, de, fr, es).
QUOTES = "\"“”„«»‹›‘’`"
REPORTING = frozenset("""said says called calls word words term quote quoted insult sagte sagt nannte wort begriff zitat
dit disait mot terme citation dijo dice palabra término cita""".split())
_CACHE = 1 << 17
_STATES = 1 << 16


def tokens(text: str | None) -> list[str]:
    """Lower-cased pieces between white space, with the marks around them."""
    return (text or "").lower().split()


def core(token: str) -> str:
    """The token between its first and last letter or digit."""
    if token.isalnum():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def edits(entry: str, stem: bool) -> int:
    """Edits allowed for an entry: none in short ones, where every other word is near."""
    n = len(entry) - (1 if stem else 0)
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """All entries within their edits, as one machine over letters whose states are made on demand.

    A match costs two for each edit, and one more if the entry is a weak one.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.kids: list[dict[str, int]] = [{}]
        self.left = [0]                                    # most edits that an entry below allows
        self.ends: list[dict[bool, tuple]] = [{}]          # stem? -> edits allowed, 1 if weak
        for entry, stem, weak in [(w, False, p < SURE_SHARE) for w, p in words.items()] + [(s, True, p < SURE_SHARE) for s, p in stems.items()]:
            k, at, path = edits(entry, stem), 0, [0]
            for c in entry:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.left.append(0)
                    self.ends.append({})
                at = self.kids[at][c]
                path.append(at)
            self.ends[at][stem] = (k, int(weak))
            for n in path:
                self.left[n] = max(self.left[n], k)
        self.reset()

    def reset(self) -> None:
        self.next: list[dict[str, int]] = [{}, {}]         # state 0: nothing can match any more
        self.items: list[tuple] = [(), ()]
        self.word: list[int | None] = [None, None]         # least cost if the token ends here
        self.stem: list[int | None] = [None, None]         # least cost of a stem read by now
        self.known = {(): 0}
        self.start = self.state({(0, ""): 0})

    def state(self, reached: dict[tuple[int, str], int]) -> int:
        """The number of the state that can be at these (node, letter owed by a swap) with so many edits."""
        todo = [(n, e) for (n, owed), e in reached.items() if not owed]
        while todo:                                         # entry letters left out of the token
            n, e = todo.pop()
            for m in self.kids[n].values():
                if e < self.left[m] and e + 1 < reached.get((m, ""), 99):
                    reached[m, ""] = e + 1
                    todo.append((m, e + 1))
        items = tuple(sorted((n, owed, e) for (n, owed), e in reached.items()))
        if items not in self.known:
            self.known[items] = len(self.items)
            self.items.append(items)
            self.next.append({})
            for out, stem in ((self.word, False), (self.stem, True)):
                fits = [2 * e + self.ends[n][stem][1] for n, owed, e in items if not owed and stem in self.ends[n] and e <= self.ends[n][stem][0]]
                out.append(min(fits, default=None))
        return self.known[items]

    def step(self, state: int, c: str) -> int:
        out: dict[tuple[int, str], int] = {}

        def reach(n, owed, e):
            if e <= self.left[n] and e < out.get((n, owed), 99):
                out[n, owed] = e

        for n, owed, e in self.items[state]:
            if owed:
                if owed == c:
                    reach(n, "", e)
                continue
            reach(n, "", e + 1)                             # a letter too many
            for d, m in self.kids[n].items():
                reach(m, "", e if d == c else e + 1)        # the letter, or another one
                if d != c and c in self.kids[m]:
                    reach(self.kids[m][c], d, e + 1)        # two letters swapped
        return self.state(out)

    def match(self, word: str) -> str | None:
        """The kind of the best entry for a word."""
        if len(self.items) > _STATES:
            self.reset()
        at, stem = self.start, None
        for c in word:
            nxt = self.next[at].get(c)
            if nxt is None:
                nxt = self.next[at][c] = self.step(at, c)
            at = nxt
            if not at:
                break
            if self.stem[at] is not None:
                stem = self.stem[at] if stem is None else min(stem, self.stem[at])
        whole = self.word[at] if at else None
        best = min((x for x in (whole, stem) if x is not None), default=None)
        if best is None:
            return None
        return "near" if best > 1 else "weak" if best else "word" if whole == 0 else "stem"


@dataclass
class Model:
    words: dict[str, float]               # entry -> share of toxic documents
    stems: dict[str, float]
    clean: dict[str, int]                 # words of clean documents that lie near an entry -> documents
    weights: list[float]                  # the constant, then one per class of hits


def belief(prior: float) -> list[float]:
    """The weights before any label is seen."""
    return [math.log(prior / (1 - prior))] + [BELIEF[k] * BELIEF_AROUND[a] for k in KINDS for a in AROUND]


def features(hits: Counter) -> list[float]:
    """Per kind and surrounding: 0, 1 for one hit, 2 for three, 3 for seven and more."""
    return [math.log2(1 + min(MOST_HITS, hits[k, a])) for k in KINDS for a in AROUND]


def regress(rows: list[tuple[list[float], float, float]], start: list[float]) -> list[float]:
    """Logistic weights for (features, weight of toxic documents, of clean ones), drawn towards ``start``; Newton's method."""
    x = np.array([[1.0, *r[0]] for r in rows])
    t, n, w, w0 = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array(start), np.array(start)

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, -z) * t + np.logaddexp(0, z) * n).sum() + 0.5 * FIRMNESS * ((w - w0) ** 2).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ ((t + n) * p - t) + FIRMNESS * (w - w0)
        h = (x * ((t + n) * p * (1 - p))[:, None]).T @ x + FIRMNESS * np.eye(len(w))
        d, s = np.linalg.solve(h, g), 1.0
        while s > 1e-9 and loss(w - s * d) > loss(w):
            s /= 2
        w = w - s * d
        if np.abs(s * d).max() < 1e-10:
            break
    return w.tolist()


class Scorer:
    """Hits of a text and its score; finished look-ups of tokens are kept in two generations."""

    def __init__(self, model: Model):
        self.model, self.machine = model, Automaton(model.words, model.stems)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def look(self, token: str):
        """(kind, clean documents with this word) or None."""
        if token in self.young:
            return self.young[token]
        if token in self.old:
            found = self.old[token]
        else:
            word = core(token)
            kind = self.machine.match(word) if word else None
            found = (kind, self.model.clean.get(word, 0) if kind == "near" else 0) if kind else None
        if len(self.young) >= _CACHE:
            self.old, self.young = self.young, {}
        self.young[token] = found
        return found

    def hits(self, text: str | None, own: int = 0) -> Counter:
        """Number of hits per (kind, surrounding). ``own``: clean documents to leave out of a word's count (1 while fitting on one)."""
        toks = tokens(text)
        here = {}
        for t in set(toks):
            found = self.look(t)
            if found is not None and found[1] <= own:
                here[t] = found[0]
        out: Counter = Counter()
        if here:
            at = [i for i, t in enumerate(toks) if t in here]
            for j, i in enumerate(at):
                near = (j > 0 and i - at[j - 1] <= WINDOW) + (j + 1 < len(at) and at[j + 1] - i <= WINDOW)
                out[here[toks[i]], AROUND[0 if mentioned(toks, i) else 2 if near else 1]] += 1
        return out

    def score(self, hits: Counter) -> float:
        z = self.model.weights[0] + sum(w * x for w, x in zip(self.model.weights[1:], features(hits)))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def mentioned(toks: list[str], i: int) -> bool:
    """Quotation marks open and close around token ``i`` within the window, or a reporting word stands before it."""
    opened = closed = False
    for j in range(i, max(-1, i - WINDOW - 1), -1):
        if j < i and toks[j][-1] in QUOTES:
            break
        if toks[j][0] in QUOTES:
            opened = True
            break
    if opened:
        for j in range(i, min(len(toks), i + WINDOW + 1)):
            if j > i and toks[j][0] in QUOTES:
                break
            if toks[j].rstrip(".,;:!?")[-1:] in (*QUOTES,):
                closed = True
                break
    return closed or any(core(t) in REPORTING for t in toks[max(0, i - WINDOW):i])


def _counting(batches):
    """Documents that hold a word, by class, and in toxic ones a 64-bit map of the words before it; partial counts
    leave in bounded portions. The empty word counts the documents."""
    toxic, clean, before = Counter(), Counter(), defaultdict(int)

    def out():
        words = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([
            pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64()),
            pa.array([m - (1 << 64) if (m := before.get(w, 0)) >= 1 << 63 else m for w in words], pa.int64())], ["word", "t", "n", "before"])
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            if label:
                words = [core(t) for t in tokens(text)]
                toxic.update({*words, ""})
                for left, w in zip(["", *words], words):
                    before[w] |= 1 << (zlib.crc32(left.encode()) & 63)
            else:
                clean.update({core(t) for t in set(tokens(text))} | {""})
            if len(toxic) + len(clean) > 1 << 18:
                yield out()
                toxic.clear(), clean.clear(), before.clear()
    if toxic or clean:
        yield out()


def _evidence(t: str, before: str):
    """Toxic documents, but no more than different words stand before: copies of a document are one piece of evidence."""
    unset = 64 - F.bit_count(before)
    return F.when(unset == 0, F.col(t).cast("double")).otherwise(F.least(F.col(t).cast("double"), -64.0 * F.log(F.greatest(unset, F.lit(1)) / 64.0)))


def _gain(t, n, share: float):
    """Log likelihood ratio of t toxic and n clean documents against the share of toxic ones at large."""
    p = (t + 0.5) / (t + n + 1.0)
    return t * F.log(p / share) + n * F.log((1 - p) / (1 - share))


def families(width: dict[str, int]) -> list[str]:
    """Stems out of significant prefixes and their numbers of words: the longest one that still covers nearly all of a family, none inside another."""
    grown = set()
    for p in width:
        while True:
            more = [q for q in width if len(q) == len(p) + 1 and q.startswith(p) and width[q] >= 0.9 * width[p]]
            if not more:
                break
            p = more[0]
        grown.add(p)
    return sorted(p for p in grown if not any(p[:i] in grown for i in range(1, len(p))))


def fit(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_rows: int = LABEL_ROWS) -> Model:
    """Lexicon and chances from labelled documents. ``labels``: (id, toxic); the fit sees no other rows.

    At most ``label_rows`` labelled ids of each class (smallest hash of the id)
    are used; the shares of the classes come from all labels. Ids labelled more
    than once count by their mean; null ids and labels are ignored.
    """
    spark = documents.sparkSession
    with_workers(spark)
    lab = labels.where(F.col("id").isNotNull() & F.col("toxic").isNotNull()).groupBy("id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    lab = staged(lab, "toxicity-labels")
    size = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    prior = (size.get(True, 0) + 0.5) / (sum(size.values()) + 1.0)
    picked = [lab.where(F.col("toxic") == flag).orderBy(F.xxhash64("id"), "id").limit(label_rows) for flag in (True, False)]
    # at most 2 * label_rows ids
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    sample = staged(documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(ids, "id"), "toxicity-sample")
    words = sample.select("text", "toxic").mapInArrow(_counting, "word string, t bigint, n bigint, before bigint") \
        .groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.bit_or("before").alias("before"))
    words = staged(words, "toxicity-words")
    seen = words.where("word = ''").first()
    model = Model({}, {}, {}, belief(prior))
    if seen is None or not seen["t"] or not seen["n"]:
        return model  # no labelled documents of both classes: the share of toxic labels for every text
    share = seen["t"] / (seen["t"] + seen["n"])
    real = words.where(F.length("word") >= 2)
    distinct = max(2, real.where("t + n >= 2").count())
    need = math.log(distinct) + 2
    wanted = lambda df, by: df.withColumn("t", _evidence("t", "before")).withColumn("gain", _gain(F.col("t"), F.col("n"), share)).where(
        (F.col("gain") >= need) & (F.col("t") >= MIN_SHARE * (F.col("t") + F.col("n")))).orderBy(F.desc("gain"), by)
    held = lambda r: r["t"] / (r["t"] + r["n"])
    model.words = {r["word"]: held(r) for r in wanted(real, "word").limit(MAX_TERMS).collect()}  # MAX_TERMS rows
    low, high = STEM_CHARS
    pre = real.select("t", "n", "before", "word", F.explode(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length("word") - 1)))).alias("k")) \
        .where(F.length("word") > F.col("k")).groupBy(F.substring("word", 1, F.col("k")).alias("stem")) \
        .agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.bit_or("before").alias("before"), F.sum((F.col("t") > 0).cast("int")).alias("width")).where(F.col("width") >= MIN_FAMILY)
    rows = wanted(pre, "stem").limit(MAX_STEMS).collect()  # MAX_STEMS rows
    share_of = {r["stem"]: held(r) for r in rows}
    model.stems = {p: share_of[p] for p in families({r["stem"]: r["width"] for r in rows})}

    def near(batches):
        machine = Automaton(model.words, model.stems)
        for b in batches:
            keep = [machine.match(w) == "near" for w in b.column("word").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    known = real.where("n >= 1").select("word", "n").mapInArrow(near, "word string, n bigint")
    model.clean = {r["word"]: r["n"] for r in known.collect()}  # near misses among the words of at most label_rows documents

    def classify(batches):
        """Documents of each class per vector of features."""
        scorer, tally = Scorer(model), defaultdict(lambda: [0, 0])
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                tally[tuple(features(scorer.hits(text, 0 if toxic else 1)))][0 if toxic else 1] += 1
        keys = sorted(tally)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.float64())), pa.array([tally[k][0] for k in keys], pa.int64()),
                                          pa.array([tally[k][1] for k in keys], pa.int64())], ["x", "t", "n"])

    tally = sample.select("text", "toxic").mapInArrow(classify, "x array<double>, t bigint, n bigint").groupBy("x").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # documents of the sample stand for the labelled ones of their class; at most 2 * label_rows rows
    up = [size.get(True, 0) / seen["t"], size.get(False, 0) / seen["n"]]
    model.weights = regress([(r["x"], r["t"] * up[0], r["n"] * up[1]) for r in tally.orderBy("x").collect()], model.weights)
    return model


def score(documents: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, score, predicted, n_hits, n_mentions) of every whole text.

    A null or empty text scores as one without hits. Repeated rows and null ids
    are scored row by row; other columns are ignored; no rows give no rows.
    """
    with_workers(documents.sparkSession)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            hits = [scorer.hits(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([scorer.score(h) for h in hits], pa.float64()), pa.array([sum(h.values()) for h in hits], pa.int64()),
                pa.array([sum(c for (_, a), c in h.items() if a == "mention") for h in hits], pa.int64())], ["id", "score", "n_hits", "n_mentions"])

    out = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "id bigint, score double, n_hits bigint, n_mentions bigint")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits", "n_mentions")


def held_out(id_col: str):
    """True for the rows whose labels the fit must not see: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
