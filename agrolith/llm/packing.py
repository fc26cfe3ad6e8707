"""Sequence packing as a cutting-stock problem, solved by column generation.

Every document becomes pieces: full ones of the sequence length and a rest.
The rests' lengths, rounded up to a grid, form a histogram of fixed size. A
linear program over patterns (how many pieces of each length share a sequence)
covers the histogram; a knapsack over the grid prices new patterns, and patterns
are added until none improves the program. Whole parts of the solution are used
as they are, the few pieces left over are packed best-fit. Each length class
then deals its pieces, ranked in parallel, to the slots of the patterns.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agrolith.llm.common import staged, with_workers

LENGTH = 2048
GRID = 8
END_ID = 1
MAX_ROUNDS = 4000
#: Rows that one (class, bucket) is expected to rank at most.
RANK_ROWS = 50_000
#: Characters on which both libraries are known to cut alike; other texts take the slower one.
_PLAIN = re.compile("[^\t\n\r -~¡-ɏ‐-‧‰-⁞€]|<\\|")


class ByteEncoder:
    """Ids of a whole text as the tokenizer file gives them."""

    def __init__(self, json_text: str, ranks: bytes):
        import base64

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_str(json_text)
        self.exact.no_truncation()
        self.exact.no_padding()
        pairs = dict(line.split() for line in ranks.splitlines() if line)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                      mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs.items()})

    def encode(self, text: str) -> list[int]:
        if _PLAIN.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@dataclass
class Plan:
    """Patterns with their counts: pattern p is ``uses[p]`` sequences, each with ``sizes[p]`` classes in order."""

    sizes: list[tuple[int, ...]]
    uses: list[int]


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Best multiset of sizes 1.. (index + 1) with total at most ``capacity`` (unbounded knapsack)."""
    n = len(values)
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(n, c)
        options = values[:k] + best[c - 1::-1][:k]
        i = int(options.argmax())
        if options[i] > best[c - 1] + 1e-12:
            best[c], take[c] = options[i], i + 1
        else:
            best[c] = best[c - 1]
    items, c = [], capacity
    while c > 0:
        if take[c]:
            items.append(int(take[c]))
            c -= int(take[c])
        else:
            c -= 1
    return float(best[capacity]), items


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A small product without threads of its own (they would compete with the driver's JVM)."""
    return np.einsum("ij,j->i", matrix, vector)


def solve(demand: np.ndarray, capacity: int, max_rounds: int = MAX_ROUNDS) -> Plan:
    """Patterns covering ``demand`` (pieces of size index + 1), nearly the fewest sequences.

    Column generation on the covering program by the revised simplex method: the
    basis starts with one homogeneous pattern per size, prices come from the
    basis inverse, the knapsack finds the entering pattern.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return Plan([], [])
    row = {int(s): i for i, s in enumerate(sizes)}
    need = demand[sizes - 1].astype(float)
    columns = [np.zeros(m) for _ in range(m)]
    for i, s in enumerate(sizes):
        columns[i][i] = capacity // s
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    x = times(inverse, need)
    for _ in range(max_rounds):
        price = inverse.sum(axis=0)  # all patterns cost one sequence
        values = np.zeros(capacity)
        values[sizes - 1] = np.maximum(price, 0)
        worth, items = knapsack(values, capacity)
        if worth <= 1 + 1e-9:
            break
        new = np.zeros(m)
        for s in items:
            if s in row:
                new[row[s]] += 1
        direction = times(inverse, new)
        ok = direction > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / direction[ok]
        out = int(ratio.argmin())
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[out] = new
        x = np.maximum(times(inverse, need), 0)
    left = demand[sizes - 1].astype(np.int64).copy()
    plan = Plan([], [])
    for count, col in sorted(zip(x, columns), key=lambda c: -c[0]):
        items = col.astype(np.int64)
        whole = int(min(np.floor(count + 1e-6), (left[items > 0] // items[items > 0]).min(initial=1 << 60)))
        if whole > 0 and items.any():
            plan.sizes.append(tuple(int(s) for s, c in zip(sizes[::-1], items[::-1]) for _ in range(c)))
            plan.uses.append(whole)
            left -= whole * items
    # what rounding left over (a bounded number of pieces): best fit, longest first
    bins: list[tuple[int, list[int]]] = []
    by_room: dict[int, list[int]] = {}
    for s, c in zip(sizes[::-1].tolist(), left[::-1].tolist()):
        for _ in range(c):
            room = min((r for r, at in by_room.items() if r >= s and at), default=None)
            if room is None:
                bins.append((0, []))
                k, room = len(bins) - 1, capacity
            else:
                k = by_room[room].pop()
            bins[k][1].append(s)
            by_room.setdefault(room - s, []).append(k)
    for _, items in bins:
        plan.sizes.append(tuple(items))
        plan.uses.append(1)
    return plan


def pieces_of(docs: DataFrame, id_col: str, text_col: str, length: int, json_path: str | None, ranks_path: str | None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): the pieces of every document."""
    spark = docs.sparkSession
    with_workers(spark)
    with open(json_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, \
            open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as g:
        sent = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteEncoder(*sent.value)
        for b in batches:
            row, start, size, crc, total = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.array([*coder.encode(t.as_py() or ""), END_ID], "<u4")
                for a in range(0, len(ids), length):
                    part = ids[a:a + length]
                    row.append(i)
                    start.append(a)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grid: int = GRID,
         json_path: str | None = None, ranks_path: str | None = None, rank_rows: int = RANK_ROWS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty; every document ends with ``END_ID``, so an empty
    one is a piece of one id. Repeated rows are packed each; among equal pieces
    any order is one result. An empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    parts = staged(pieces_of(docs, id_col, text_col, length, json_path, ranks_path), "pack-pieces")
    cls = F.ceil(F.col("length") / grid).cast("int")
    parts = parts.withColumn("cls", cls)
    counts = parts.groupBy("cls").count().collect()  # at most length / grid rows
    n = sum(r["count"] for r in counts)
    if not n:
        return parts.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                            F.col("start").alias("sequence_id"), F.col("start").alias("offset"))
    demand = np.zeros(length // grid, np.int64)
    for r in counts:
        demand[r["cls"] - 1] = r["count"]
    plan = solve(demand, length // grid)
    # ranks within a class: a count per (class, bucket), then places inside the bucket
    buckets = max(16, -(-4 * n // rank_rows))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)).cast("int"))
    per = parts.groupBy("cls", "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("cls", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("id", "start", "ids_crc32"))
    ranked = parts.withColumn("place", place).join(per, ["cls", "bucket"]).withColumn("rank", F.col("first") + F.col("place") - 1)
    # slots: pattern p gives class c ``each`` slots in each of its sequences
    slots, dealt, first_sequence = [], dict.fromkeys(range(1, length // grid + 1), 0), 0
    for items, uses in zip(plan.sizes, plan.uses):
        for c in dict.fromkeys(items):
            each = items.count(c)
            slots.append((c, dealt[c], dealt[c] + each * uses, each, first_sequence, items.index(c)))
            dealt[c] += each * uses
        first_sequence += uses
    table = spark.createDataFrame(slots, "c int, lo bigint, hi bigint, each int, seq bigint, slot int")  # a few rows a class
    got = ranked.join(F.broadcast(table), (F.col("cls") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    j = F.col("rank") - F.col("lo")
    got = got.withColumn("sequence_id", F.col("seq") + F.floor(j / F.col("each"))).withColumn("at", F.col("slot") + j % F.col("each"))
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return got.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                      F.col("sequence_id").cast("bigint").alias("sequence_id"), F.coalesce(ahead, F.lit(0)).cast("bigint").alias("offset"))
