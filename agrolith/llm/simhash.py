"""SimHash near-duplicates by forests of vantage-point trees.

A fingerprint is 64 majority bits over the XXH64 values of a text's word
shingles. Two fingerprints are linked when they differ in at most ``max_bits``
bits. The 64 bits are cut into blocks; a linked pair differs in at most
``max_bits // blocks`` bits of some block, and Hamming distance over a block is
a lower bound of the whole distance. So each block has one vantage-point tree
over its own Hamming distance: a node sends a point to its inner or outer side
by the distance to the vantage point, and by the triangle inequality only the
outer points within ``radius`` of the boundary need a copy inside as well. A
top tree from a bounded sample cuts the fingerprints into shards; where the
bound of its size leaves shards overfull, each of them is cut again by a tree
from a sample of its own, level by level, as long as the trees part it. Shards
go on with trees of their own, and small leaves are compared pair by pair on
all 64 bits. Shards return stars (a spanning set of links), never pairs, and the stars
of all shards are joined into components by alternating large-star and
small-star rounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import staged, with_workers

SEED = 42
BLOCKS = 3
SHARD_ROWS = 8192
LEAF_ROWS = 512
MAX_SHARDS = 1 << 14  # of the top tree; bounds the sample to SAMPLE_PER_SHARD times as many fingerprints
MAX_CUT = 1 << 8  # shards that one overfull shard is cut into at a level
PIECE_ROWS = 1 << 16  # rows of an overfull shard that one task sends to its tree
SAMPLE_PER_SHARD = 32
_HASH_BLOCK = 1 << 18


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words (the whole sequence if it is shorter), in blocks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    first, last = starts[:n], ends[min(size, len(words)) - 1:]
    hash_of = xxhash.xxh64_intdigest
    for a in range(0, n, _HASH_BLOCK):
        f, e = first[a:a + _HASH_BLOCK].tolist(), last[a:a + _HASH_BLOCK].tolist()
        yield np.fromiter((hash_of(line[x:y], SEED) for x, y in zip(f, e)), np.uint64, len(f))


def fingerprint(text: str | None, size: int = 4) -> int:
    """64-bit SimHash; a text without words has 0."""
    votes, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text or "", size):
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, also: list[str] = ()) -> DataFrame:
    """(id, fp) and the columns ``also``: the fingerprint as a signed 64-bit integer."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64)), *b.columns[2:]], names=["id", "fp", *also])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *also)
    kinds = dict(base.dtypes)
    return base.mapInArrow(run, ", ".join([f"id {kinds['id']}", "fp bigint", *(f"{c} {kinds[c]}" for c in also)]))


def block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]


class VantageTree:
    """Splits points by Hamming distance over ``mask`` to vantage points taken from a sample.

    ``route`` gives every leaf a point belongs to: its own one, and the leaves
    whose inner side reaches to within ``radius`` of it.
    """

    def __init__(self, points: np.ndarray, mask: int, radius: int, leaves: int, leaf_rows: int = 1):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list[tuple] = []
        self.n_leaves = 0
        self.root = self._grow(points, leaves, leaf_rows)

    def distance(self, points: np.ndarray, vantage) -> np.ndarray:
        return np.bitwise_count((points ^ vantage) & self.mask)

    def _grow(self, points: np.ndarray, leaves: int, leaf_rows: int) -> int:
        if leaves > 1 and len(points) > leaf_rows:
            best = None
            for k in {0, len(points) // 2, len(points) - 1}:  # the vantage point whose cut is crossed by the fewest
                d = self.distance(points, points[k])
                for cut in {int(np.quantile(d, 0.4)), int(np.median(d))}:
                    inner = int((d <= cut).sum())
                    if 0 < inner < len(d):
                        both = int(((d > cut) & (d <= cut + self.radius)).sum())
                        cost = max(inner + both, len(d) - inner) + both / 2
                        if inner + both < len(d) and (best is None or cost < best[0]):
                            best = (cost, points[k], cut, d)
            if best:
                _, vantage, cut, d = best
                at = len(self.nodes)
                self.nodes.append(())
                half = max(1, leaves // 2)
                inner = self._grow(points[d <= cut + self.radius], half, leaf_rows)
                outer = self._grow(points[d > cut], max(1, leaves - half), leaf_rows)
                self.nodes[at] = (vantage, cut, inner, outer)
                return at
        self.n_leaves += 1
        return -self.n_leaves

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indexes of the points in it)."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -at - 1, rows
                continue
            vantage, cut, inner, outer = self.nodes[at]
            d = self.distance(points[rows], vantage)
            todo.append((inner, rows[d <= cut + self.radius]))
            todo.append((outer, rows[d > cut]))


class Links:
    """Disjoint sets over the indexes of one shard's points."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_groups(points: np.ndarray, max_bits: int, width: int = 64) -> Iterator[np.ndarray]:
    """The groups of two or more points that links connect, as indexes; smallest index first.

    Every point is met once: from a seed, ``width`` points at a time look for
    their neighbours among those not met yet. In a dense group the first ones
    find nearly all, so no list of pairs is ever made.
    """
    rest = np.arange(len(points))
    while len(rest):
        group, todo, rest = [rest[:1]], rest[:1], rest[1:]
        while len(todo) and len(rest):
            now, todo = todo[:width], todo[width:]
            hit = np.zeros(len(rest), bool)
            step = max(1, (1 << 22) // len(rest))
            for a in range(0, len(now), step):
                hit |= (np.bitwise_count(points[now[a:a + step], None] ^ points[None, rest]) <= max_bits).any(axis=0)
            if hit.any():
                group.append(rest[hit])
                todo, rest = np.concatenate([todo, rest[hit]]), rest[~hit]
        if len(group) > 1:
            yield np.concatenate(group)


def link_shard(points: np.ndarray, mask: int, radius: int, max_bits: int, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """For sorted distinct points: the index of the smallest point each is linked to through the shard."""
    links = Links(len(points))
    tree = VantageTree(points, mask, radius, max(1, 4 * len(points) // leaf_rows), leaf_rows)
    for _, rows in tree.route(points):
        rows = np.sort(rows)
        here = points[rows]
        linked = np.ones(len(rows), bool)
        if len(rows) <= 2 * leaf_rows:  # most points have no neighbour: find the others at once
            linked = (np.bitwise_count(here[:, None] ^ here[None, :]) <= max_bits).sum(axis=1) > 1
        rows, here = rows[linked], here[linked]
        for group in near_groups(here, max_bits):
            for i in rows[group[1:]].tolist():
                links.join(int(rows[group[0]]), i)
    return np.fromiter((links.root(i) for i in range(len(points))), np.int64, len(points))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node reachable.

    Alternating large-star and small-star rounds; each is a partial minimum per
    node and a join, written to the shared folder, until nothing changes.
    """
    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def mins(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    cur = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-0")
    seen = state(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(mins(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = mins(large)
        small = large.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        cur = staged(small, "cc")
        now = state(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))


def overfull(routed: DataFrame, shard_rows: int) -> DataFrame:
    """(tree, leaf, n) of the shards with more than four times ``shard_rows`` rows."""
    return routed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 4 * shard_rows)


def cut_again(routed: DataFrame, masks: list[int], radius: int, shard_rows: int, max_cut: int = MAX_CUT, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows (tree, leaf, fp) with every overfull shard cut by vantage trees of its own, level by level.

    A shard's tree is made from a hash sample of about SAMPLE_PER_SHARD rows for
    each shard it is to be cut into, and its rows meet it in pieces of bounded
    size. A shard stays as it is when the cut would not lower the rows to
    compare by a quarter, so the levels end. New leaf names are hashes of the
    old one and the place in the tree: two shards that share a name would only
    compare more pairs.
    """
    def cost(n):
        return n * F.ceil(n / (4 * shard_rows))

    done = None
    while True:
        big = staged(overfull(routed, shard_rows), "simhash-overfull")
        if big.isEmpty():
            return routed if done is None else done.unionByName(routed)
        fine = routed.join(big, ["tree", "leaf"], "left_anti")
        rows = routed.join(big, ["tree", "leaf"])
        cuts = F.least(F.ceil(2 * F.col("n") / shard_rows), F.lit(max_cut))
        rows = rows.withColumns({"cuts": cuts.cast("int"), "piece": F.pmod(F.xxhash64("fp", F.lit(7)), F.ceil(F.col("n") / piece_rows)).cast("int")})
        share = F.least(F.lit(1.0), SAMPLE_PER_SHARD * F.col("cuts") / F.col("n"))
        sample = rows.where(F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(1 << 30)) <= share * (1 << 30))

        def plant(p: pd.DataFrame) -> pd.DataFrame:
            points = np.sort(p["fp"].to_numpy(np.int64)).view(np.uint64)
            t, cuts = int(p["tree"].iloc[0]), int(p["cuts"].iloc[0])
            tree = VantageTree(points, masks[t], radius, cuts, 2)
            return pd.DataFrame({"tree": [np.int32(t)], "leaf": [p["leaf"].iloc[0]], "made": [pickle.dumps(tree)], "leaves": [tree.n_leaves]})

        made = staged(sample.groupBy("tree", "leaf").applyInPandas(plant, "tree int, leaf bigint, made binary, leaves int"), "simhash-trees")
        pieces = big.join(made.where("leaves > 1"), ["tree", "leaf"]) \
            .select("tree", "leaf", "made", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / piece_rows) - 1).cast("int"))).alias("piece"))

        def send(points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(tree):
                return pd.DataFrame({"tree": [], "old": [], "leaf": [], "fp": []}).astype({"tree": "int32"} | dict.fromkeys(("old", "leaf", "fp"), "int64"))
            t, leaf = points["tree"].iloc[0], int(points["leaf"].iloc[0])
            fps = points["fp"].to_numpy(np.int64).view(np.uint64)
            out = []
            for k, at in pickle.loads(tree["made"].iloc[0]).route(fps):
                name = xxhash.xxh64_intdigest(f"{leaf}:{k}", SEED) >> 1
                out.append(pd.DataFrame({"tree": t, "old": np.int64(leaf), "leaf": np.int64(name), "fp": fps[at].view(np.int64)}))
            return pd.concat(out)

        keys = ["tree", "leaf", "piece"]
        sent = rows.select(*keys, "fp").groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInPandas(send, "tree int, old bigint, leaf bigint, fp bigint")
        sent = staged(sent, "simhash-shards")
        after = sent.groupBy("tree", "old", "leaf").agg(F.count("*").alias("c")).groupBy("tree", "old").agg(F.sum(cost(F.col("c"))).alias("cost"))
        better = after.join(big.withColumnRenamed("leaf", "old"), ["tree", "old"]).where(F.col("cost") <= 0.75 * cost(F.col("n"))).select("tree", "old")
        better = staged(better, "simhash-better")
        whole = rows.join(better.withColumnRenamed("old", "leaf"), ["tree", "leaf"], "left_anti").select("tree", "leaf", "fp")
        kept = fine.unionByName(whole)
        done = kept if done is None else done.unionByName(kept)
        routed = sent.join(better, ["tree", "old"], "left_semi").select("tree", "leaf", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4,
                    blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS, also: list[str] = ()) -> DataFrame:
    """One row per input row: id, fp (signed), component_fp, component_id and the columns ``also``.

    Components join all rows whose fingerprints are linked, directly or through
    others; ``component_fp`` names the component and ``component_id`` is its
    smallest id. Null and empty texts have the fingerprint 0 and are linked to
    each other and to any fingerprint within ``max_bits`` of it. A null id is
    ignored by the minimum (null if the component has no other). Repeated rows
    stay, each with its component; an empty table gives none. Other columns are
    not read.
    """
    spark = docs.sparkSession
    with_workers(spark)
    fps = staged(fingerprints(docs, id_col, text_col, shingle, also), "simhash-fp")
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("min_id")), "simhash-nodes")
    n = nodes.count()
    shards = max(1, min(max_shards, -(-2 * n // shard_rows)))
    share = min(1.0, 1.2 * SAMPLE_PER_SHARD * shards / max(1, n))
    near = nodes.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = np.sort(near.select("fp").limit(2 * SAMPLE_PER_SHARD * shards).toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    masks, radius = block_masks(blocks), max_bits // blocks
    trees = [VantageTree(sample, m, radius, shards, 2) for m in masks]
    sent = spark.sparkContext.broadcast(trees)  # bounded by max_shards nodes a tree

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            points = p["fp"].to_numpy(np.int64).view(np.uint64)
            for t, tree in enumerate(sent.value):
                for leaf, rows in tree.route(points):
                    yield pd.DataFrame({"tree": np.int32(t), "leaf": np.int64(leaf), "fp": points[rows].view(np.int64)})

    routed = staged(nodes.select("fp").mapInPandas(route, "tree int, leaf bigint, fp bigint"), "simhash-shards")
    routed = cut_again(routed, masks, radius, shard_rows)
    # a shard that trees do not part (a dense region) is cut into parts, and each pair of parts is one group
    parts = routed.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / (4 * shard_rows)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    grouped = routed.join(F.broadcast(parts), ["tree", "leaf"]).select("tree", "leaf", "fp", part.alias("x"), other.alias("y")) \
        .select("tree", "leaf", "fp", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    def link(p: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(p["fp"].to_numpy(np.int64).view(np.uint64))
        up = link_shard(points, masks[int(p["tree"].iloc[0])], radius, max_bits)
        moved = up != np.arange(len(points))
        return pd.DataFrame({"a": points[moved].view(np.int64), "b": points[up[moved]].view(np.int64)})

    edges = staged(grouped.groupBy("tree", "leaf", "x", "y").applyInPandas(link, "a bigint, b bigint"), "simhash-links")
    roots = components(edges)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "min_id", F.coalesce("root", "fp").alias("component_fp"))
    ids = named.groupBy("component_fp").agg(F.min("min_id").alias("component_id"))
    labels = named.select("fp", "component_fp").join(ids, "component_fp")
    return fps.join(labels, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_fp", "component_id", *also)


def hex_fp(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def row_hash(docs: DataFrame):
    """A hash over all columns of a row."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in docs.dtypes])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, same columns, with one row of each component.

    The row with the smallest id stays (null ids come last; among rows with the
    same id the smallest hash of the row, and of equal rows any one).
    """
    marked = docs.withColumns({"__i": F.col(id_col), "__h": row_hash(docs)})
    found = near_duplicates(marked.select("__i", "__h", F.col(text_col).alias("__t")), "__i", "__t", shingle, max_bits, also=["__h"])
    per_row = found.groupBy("component_fp", "__i", "__h").agg(F.count("*").alias("__n"))
    first = per_row.groupBy("component_fp").agg(F.min(F.struct(F.col("__i").isNull().alias("z"), "__i", "__h", "__n")).alias("k")) \
        .select(F.col("k.__i").alias("i"), F.col("k.__h").alias("h"), F.col("k.__n").alias("n"))
    first = staged(first, "simhash-kept")
    same = marked["__i"].eqNullSafe(F.col("i")) & (marked["__h"] == F.col("h"))
    single = marked.join(first.where("n = 1"), same, "left_semi")
    equal = marked.join(first.where("n > 1"), same, "left_semi").dropDuplicates(["__i", "__h"])
    return single.unionByName(equal).select(*[F.col(f"`{c}`") for c in docs.columns])
