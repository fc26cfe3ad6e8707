"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of labelled target texts and one
of all raw texts, give every document the log ratio of its probabilities. The
ratio is the importance weight; documents are resampled without replacement by
Gumbel top-k: the k largest of log weight plus Gumbel noise. The noise comes
from a hash of the id, and the k-th largest key from counts per interval that
are narrowed until it is exact, so nothing is sorted or gathered whole.

Tokens are runs of word bytes or of punctuation, lower-cased; a token in
capitals and a token that repeats the one before carry a mark, so shouting and
stuttering are n-grams of their own. Hashing works on whole Arrow buffers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import staged, with_workers

BUCKETS = 1 << 14
#: Labelled documents that shape the target model and the tilt, taken by hash of the id.
LABEL_ROWS = 20_000
SMOOTH = 1.0
_BLOCK = 1 << 20
_BINS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CAPS, _AGAIN, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)

_SPACE_BYTES = b"\t\n\x0b\x0c\r "
_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 punctuation
_KIND[list(_SPACE_BYTES)] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    up[0] = 1
    down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Grams:
    """Bucket numbers of the 1- and 2-grams of texts that lie one after the other in a buffer."""

    def __init__(self, buckets: int = BUCKETS):
        self.mask = np.uint64(buckets - 1)
        self.up, self.down = _powers(1 << 12)
        self.last: tuple | None = None  # the last token's hash, without and with its mark

    def of(self, data: np.ndarray, starts: np.ndarray, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, document index of each) for bytes ``data`` whose texts begin at ``starts``.

        ``goes_on``: the bytes are the next piece of the text before.
        """
        none = np.zeros(0, np.int64)
        if not goes_on:
            self.last = None
        if not len(data):
            return none, none
        if len(self.up) < len(data) + 1:
            self.up, self.down = _powers(len(data) + 1)
        kind = _KIND[data]
        edge = np.empty(len(data), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge[starts[starts < len(data)]] = True
        a = np.flatnonzero(edge)
        b = np.append(a[1:], len(data))
        word = kind[a] > 0
        a, b = a[word], b[word]
        if not len(a):
            return none, none
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
        h = (total[b] - total[a]) * self.down[a]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        caps = (upper[b] - upper[a] == b - a) & (b - a > 1)
        doc = np.searchsorted(starts, a, side="right") - 1
        near = doc[1:] == doc[:-1]
        plain = h
        again = np.concatenate([[self.last is not None and h[0] == self.last[0]], (h[1:] == h[:-1]) & near])
        h = np.where(again, _AGAIN, np.where(caps, h ^ _CAPS, h))
        pairs, pair_doc = (h[:-1] * _PAIR + h[1:])[near], doc[1:][near]
        if self.last is not None:
            pairs, pair_doc = np.append(pairs, self.last[1] * _PAIR + h[:1]), np.append(pair_doc, 0)
        self.last = (plain[-1], h[-1:])
        both = np.concatenate([h, pairs])
        both = (both ^ (both >> np.uint64(32))) * _MIX
        return ((both >> np.uint64(40)) & self.mask).astype(np.int64), np.concatenate([doc, pair_doc])


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(rows, bytes, starts, goes on) of a string column in blocks of about a MiB; nulls are empty.

    A longer text comes in pieces that end at white space, all but the first with ``goes on``.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BLOCK, side="right")) - 1)
        at, end = int(offsets[a]), int(offsets[b])
        while end - at > 2 * _BLOCK:  # one text, as blocks of several end sooner
            stop = at + _BLOCK
            while stop < end and _KIND[data[stop]]:
                ahead = np.flatnonzero(_KIND[data[stop:min(end, stop + _BLOCK)]] == 0)
                stop = stop + int(ahead[0]) if len(ahead) else min(end, stop + _BLOCK)
            yield np.array([a]), data[at:stop], np.zeros(1, np.int64), at > offsets[a]
            at = stop
        if at == offsets[a]:
            yield np.arange(a, b), data[at:end], offsets[a:b] - offsets[a], False
        elif at < end:
            yield np.array([a]), data[at:end], np.zeros(1, np.int64), True
        a = b


@dataclass
class Model:
    ratio: np.ndarray  # log target probability minus log raw probability, per bucket
    tilt: float  # per n-gram, so that a weight over 0 means target rather than raw

    def scores(self, column: pa.Array, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """(summed log ratio, number of n-grams) per text."""
        total, n = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for rows, data, starts, goes_on in blocks(column):
            bucket, doc = grams.of(data, starts, goes_on)
            total[rows] += np.bincount(doc, weights=self.ratio[bucket], minlength=len(rows))
            n[rows] += np.bincount(doc, minlength=len(rows))
        return total, n


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality",
        label_rows: int = LABEL_ROWS, buckets: int = BUCKETS) -> Model | None:
    """The ratio model; None when no labelled target document is there.

    Raw counts cover all of ``docs``. The target model comes from the labelled
    documents with ``label_col`` 1 among ``label_rows`` labels taken by hash of
    the id; those with 0 only serve to place the tilt.
    """
    spark = docs.sparkSession
    with_workers(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("i")) \
        .agg(F.max(F.col(label_col).cast("int")).alias("l")).orderBy(F.xxhash64("i"), "i").limit(label_rows).toPandas()
    good = np.sort(known.loc[known["l"] == 1, "i"].to_numpy(np.int64))
    bad = np.sort(known.loc[known["l"] != 1, "i"].to_numpy(np.int64))
    if not len(good):
        return None
    sent = spark.sparkContext.broadcast((good, bad))  # at most label_rows integers
    base = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))

    def member(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(ids), bool)
        return known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(buckets)
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            chosen = member(ids, sent.value[0]) & np.asarray(batch.column(0).is_valid())
            for rows, data, starts, goes_on in blocks(batch.column(1)):
                bucket, doc = grams.of(data, starts, goes_on)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[chosen[rows][doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["b", "raw", "target"])

    counted = base.mapInArrow(count, "b bigint, raw bigint, target bigint").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    raw[counted["b"]] += counted["raw"]
    target[counted["b"]] += counted["target"]
    model = Model(np.log(target / target.sum()) - np.log(raw / raw.sum()), 0.0)
    if len(bad):
        some = base.join(F.broadcast(spark.createDataFrame(known.astype({"i": "int64", "l": "int32"}), "i bigint, l int")), "i")
        means = score(some, model, "i", "t", ["l"]).where("n > 0").select("i", "l", (F.col("total") / F.col("n")).alias("m"))
        seen = means.groupBy("i", "l").agg(F.min("m").alias("m")).toPandas()  # at most one row for each known label
        model.tilt = tilt_between(seen.loc[seen["l"] == 1, "m"].to_numpy(), seen.loc[seen["l"] != 1, "m"].to_numpy())
    return model


def tilt_between(good: np.ndarray, bad: np.ndarray) -> float:
    """The mean log ratio that parts target from other texts.

    First the cut with the fewest errors (a lost target text weighs four times
    one that passes); then the middle between the lowest hundredth of the target
    texts above it and the highest hundredth of the others below it, so that
    short texts near the cut keep a margin against the noise.
    """
    if not len(good) or not len(bad):
        return 0.0
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    cut = float(cuts[(4 * lost + passed).argmin()])
    above, below = good[good >= cut], bad[bad < cut]
    if not len(above) or not len(below):
        return cut
    return float(np.quantile(above, 0.01) + np.quantile(below, 0.99)) / 2


def score(docs: DataFrame, model: Model, id_col: str, text_col: str, also: list[str] = ()) -> DataFrame:
    """(id, total, n) and the columns ``also`` per row."""
    with_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(sent.value.ratio))
        for b in batches:
            total, n = sent.value.scores(b.column(1), grams)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(n), *b.columns[2:]], names=[id_col, "total", "n", *also])

    base = docs.select(id_col, F.col(text_col).cast("string"), *also)
    kinds = dict(base.dtypes)
    return base.mapInArrow(run, ", ".join([f"`{id_col}` {kinds[id_col]}", "total double", "n bigint", *(f"{c} {kinds[c]}" for c in also)]))


def _score_of(docs: DataFrame, model: Model, text_col: str) -> Column:
    """Struct (total, n) of a row's text, beside its other columns."""
    with_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    @F.arrow_udf("total double, n bigint")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(len(sent.value.ratio))
        for t in texts:
            total, n = sent.value.scores(t, grams)
            yield pa.StructArray.from_arrays([pa.array(total), pa.array(n)], names=["total", "n"])

    return run(F.col(text_col).cast("string"))


def kth_largest(df: DataFrame, col: str, k: int) -> float | None:
    """The k-th largest value of a double column, from counts per interval that are narrowed until it is exact."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = (hi - lo) / _BINS
        if width <= 0 or lo + width == lo:
            break
        inside = df.where(F.col(col).between(lo, hi))
        bin_of = F.least(F.floor((F.col(col) - lo) / width), F.lit(_BINS - 1)).cast("int")
        rows = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("c"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()  # at most _BINS
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["c"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["c"]
    return hi


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             k: int | None = None, seed: int = 42, also: list[str] = ()) -> DataFrame:
    """One row per input row: id, log_weight, gumbel_key, kept (and the columns ``also``).

    ``k`` documents with the largest keys are kept (all that tie with the k-th);
    by default k is the number of documents whose weight is at least 0, that is
    which the target model explains better than the tilted raw model. Texts
    without n-grams (null, empty, white space) have no weight and are not kept.
    Rows with the same id share their noise, so repeated rows share their fate.
    Without labelled target documents all weights are 0 and all rows with
    n-grams stay. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col) or Model(np.zeros(BUCKETS), 0.0)
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *also)
    scored = staged(_keyed(base, model, seed, list(also)), "quality-scores")
    kept = _kept(_threshold(scored, k))
    return scored.select(F.col("__id").alias(id_col), "log_weight", "gumbel_key", kept.alias("kept"), *also)


def _keyed(base: DataFrame, model: Model, seed: int, also: list[str]) -> DataFrame:
    return _with_keys(score(base, model, "__id", "__text", also), model, seed)


def _with_keys(scored: DataFrame, model: Model, seed: int) -> DataFrame:
    unit = (F.shiftrightunsigned(F.xxhash64(F.col("__id"), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return scored \
        .withColumn("log_weight", F.when(F.col("n") > 0, F.col("total") - F.col("n") * F.lit(model.tilt))) \
        .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit)))


def _threshold(scored: DataFrame, k: int | None) -> float | None:
    return kth_largest(scored, "gumbel_key", scored.where("log_weight >= 0").count() if k is None else k)


def _kept(least: float | None):
    return F.lit(False) if least is None else F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
         k: int | None = None, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, same columns, that :func:`resample` keeps.

    The keys depend on the row alone, so the second pass over the texts finds
    the same ones and nothing is joined. It sends a text to the Python worker
    once and gets two numbers back: the rows themselves never leave the JVM.
    """
    model = fit(docs, labels, id_col, text_col, label_col) or Model(np.zeros(BUCKETS), 0.0)
    both = [F.col(id_col).alias("__id"), F.col(text_col).alias("__text")]
    least = _threshold(staged(_keyed(docs.select(*both), model, seed, []), "quality-scores"), k)
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), both[0],
                         _score_of(docs, model, text_col).alias("__score")).select("__row", "__id", "__score.*")
    return _with_keys(scored, model, seed).where(_kept(least)).select("__row.*")
