"""Conversation prefix trie: shared prefixes as nodes, subtree totals by centroid decomposition.

**Nodes.** Every conversation is rebuilt from the head of its base conversation
and its own turns. A node is a distinct sequence of first turns; its key is the
exclusive-or of one 128-bit hash per turn and depth, so keys of all depths come
from running sums and long conversations are cut into blocks. Texts are hashed
where they are read and never shuffled. The smallest conversation through a
node is its name: (conversation, depth) is unique, and the nodes of one name
form one vertical path.

**Rollup.** The parent edges form a tree that may be as deep as the longest
conversation and as wide as the corpus, so neither levels nor paths bound the
work. Components are split at their centroid: with the number of conversations
as a node's weight, the weight below every node comes from the same grouping
that makes the nodes. The nodes with at least half of their component's weight
below them are one chain from the component's top, and its end is the centroid.
Taking it out leaves components of at most half the weight. The component
totals below it, added up with its own values, are what the centroid has below
itself and what every node on the centroid-to-top path gains. A round does so
for all large components at once, as joins and grouped sums; components of at
most ``SHARD`` weight are finished by the same recursion inside tasks.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.common import staged, with_workers

#: Components of at most this weight are finished inside one task.
SHARD = 1 << 15
#: Turns of a conversation whose running key is one window.
BLOCK = 1024
#: Ids of a node are joined to texts of about this length, and those hashed in order.
PIECE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
GROUP, HEADS = 100, 6
_KEY = ["depth", "k1", "k2"]


def rebuilt(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after rebuilding.

    Turns: conv, depth (from 1), n_chars, the two hash words of the turn at its
    depth, and the conversation's rebuilt length. Conversations: conv, length.
    """
    said = F.concat(F.length(F.coalesce(role, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.unhex(F.sha2(said, 256)).alias("said"), F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_chars"))
    # a total order dealt over all tasks: a long conversation may lie in many of them
    order = ["conv", "turn", "role", "said"]
    rows = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()), "trie-turns")
    rows = rows.withColumn("part", F.shiftright("mid", 33))
    runs = rows.groupBy("conv", "part").agg(F.min("mid").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start") + 1), "trie-runs")

    sizes = runs.groupBy("conv").agg(F.sum("n").alias("own"))
    info = sizes.withColumn("base", F.col("conv") - F.col("conv") % GROUP) \
        .withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    of_base = sizes.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.least("own", F.lit(HEADS - 1)).alias("held"))
    info = staged(info.join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("held", F.lit(0))))
                  .withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
                  .select("conv", "base", "h", "head", "length"), "trie-conversations")
    # one row of ``runs`` per conversation and task: the join spreads a long conversation over its tasks
    numbered = rows.join(runs.join(info, "conv").select("conv", "part", "offset", "h", "head", "length"), ["conv", "part"]) \
        .withColumn("pos", F.col("mid") + F.col("offset"))
    tails = numbered.where(F.col("pos") > F.col("h")).select(
        "conv", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "n_chars", "said", "length")
    first = numbered.where((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS)) \
        .select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "n_chars", "said")
    heads = info.where("head > 0").join(first, "base").where(F.col("depth") <= F.col("head")) \
        .select("conv", "depth", "n_chars", "said", "length")
    words = [F.xxhash64(F.lit(i), "depth", "said").alias(f"x{i}") for i in (1, 2)]
    return staged(tails.unionByName(heads).select("conv", "depth", "n_chars", "length", *words), "trie-rebuilt"), info.select("conv", "length")


def keyed(turns: DataFrame) -> DataFrame:
    """conv, depth, n_chars, length and the key (k1, k2) of the first ``depth`` turns."""
    t = turns.withColumn("block", F.floor(F.col("depth") / BLOCK).cast("bigint"))
    run = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = t.where(F.col("length") >= BLOCK).groupBy("conv", "block").agg(*[F.bit_xor(f"x{i}").alias(f"s{i}") for i in (1, 2)])
    whole = whole.select("conv", "block", *[F.bit_xor(f"s{i}").over(before).alias(f"b{i}") for i in (1, 2)])
    t = t.select("conv", "block", "depth", "n_chars", "length", *[F.bit_xor(f"x{i}").over(run).alias(f"r{i}") for i in (1, 2)])
    return t.join(whole, ["conv", "block"], "left").select(
        "conv", "depth", "n_chars", "length", *[F.col(f"r{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))).alias(f"k{i}") for i in (1, 2)])


def _pieces(batches):
    """Ids in order -> (key, first id, comma-joined text) of bounded length; the text goes on in the next row."""
    key, first, out, size = None, None, [], 0
    for p in batches:
        done = []
        for d, a, b, c in zip(p["depth"].tolist(), p["k1"].tolist(), p["k2"].tolist(), p["conv"].tolist()):
            if key != (d, a, b) or size >= PIECE:
                if out:
                    done.append((*key, first, ",".join(out)))
                key, first, out, size = (d, a, b), c, [], 0
            out.append(str(c))
            size += len(out[-1]) + 1
        if done:
            yield pd.DataFrame(done, columns=[*_KEY, "conv", "ids"])
    if out:
        yield pd.DataFrame([(*key, first, ",".join(out))], columns=[*_KEY, "conv", "ids"])


def _digests(batches):
    """Pieces by key and first id -> (smallest id, depth, SHA-256 of the whole text); only the running digest is held."""
    key, first, h = None, None, None
    for p in batches:
        done = []
        for d, a, b, c, ids in zip(p["depth"].tolist(), p["k1"].tolist(), p["k2"].tolist(), p["conv"].tolist(), p["ids"].tolist()):
            if key == (d, a, b):
                h.update(b",")
            else:
                if h is not None:
                    done.append((first, key[0], h.hexdigest()))
                key, first, h = (d, a, b), c, hashlib.sha256()
            h.update(ids.encode())
        if done:
            yield pd.DataFrame(done, columns=["conv", "depth", "ends_sha256"])
    if h is not None:
        yield pd.DataFrame([(first, key[0], h.hexdigest())], columns=["conv", "depth", "ends_sha256"])


def endings(ends: DataFrame) -> DataFrame:
    """conv (smallest that ends there), depth, ends_sha256 per node at which conversations end.

    Ids are ordered over all tasks and joined to pieces there; the task that
    hashes a node reads one row per piece.
    """
    pieces = ends.select(*_KEY, "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv") \
        .mapInPandas(_pieces, "depth bigint, k1 bigint, k2 bigint, conv bigint, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv").mapInPandas(_digests, "conv bigint, depth bigint, ends_sha256 string")


def decompose(parent: list[int], values: list[list[int]], gained: list[list[int]], member: list[int]) -> None:
    """Subtree totals of one component, written into ``gained``.

    ``member`` lists the component's nodes, parents before children; every
    parent but the first one's lies in it. ``gained`` starts with what was
    added along the paths of earlier centroids.
    """
    size, part = {}, {}
    todo = [member]
    while todo:
        m = todo.pop()
        if len(m) == 1:
            for v, g in zip(values, gained):
                g[m[0]] += v[m[0]]
            continue
        for v in m:
            size[v] = 1
        for v in reversed(m[1:]):
            size[parent[v]] += size[v]
        centroid = next(v for v in reversed(m) if 2 * size[v] >= len(m))  # the last one of the chain
        above, below = [], {}
        for v in m:
            p = parent[v]
            if v == centroid:
                part[v] = None
            elif v != m[0] and p == centroid:
                part[v] = v
                below[v] = [v]
            elif v != m[0] and part[p] is not None and part[p] >= 0:
                part[v] = part[p]
                below[part[v]].append(v)
            else:
                part[v] = -1
                above.append(v)
        totals = [v[centroid] + sum(sum(v[u] for u in b) for b in below.values()) for v in values]
        for g, t in zip(gained, totals):
            g[centroid] += t
            u = centroid
            while u != m[0]:
                u = parent[u]
                g[u] += t
        todo += below.values()
        if above:
            todo.append(above)


def _finish(batches):
    """Whole components, one after the other, ordered by component and depth."""
    cols = ["rep", "depth", "n_leaves", "saved"]
    rest = None
    for p in batches:
        p = p if rest is None else pd.concat([rest, p], ignore_index=True)
        last = (p["crep"] == p["crep"].iloc[-1]) & (p["cdepth"] == p["cdepth"].iloc[-1]) if len(p) else []
        rest = p[last].reset_index(drop=True) if len(p) else None
        done = p[~last] if len(p) else p
        if len(done):
            yield _components(done.reset_index(drop=True))[cols]
    if rest is not None and len(rest):
        yield _components(rest)[cols]


def _components(p: pd.DataFrame) -> pd.DataFrame:
    names = list(zip(p["rep"].tolist(), p["depth"].tolist()))
    at = {n: i for i, n in enumerate(names)}
    parent = [at.get((u, d - 1), -1) for u, d in zip(p["up"].tolist(), p["depth"].tolist())]
    values = [p["leaf"].tolist(), p["saving"].tolist()]
    gained = [p["got_leaf"].tolist(), p["got_saving"].tolist()]
    groups: dict = {}
    for i, c in enumerate(zip(p["crep"].tolist(), p["cdepth"].tolist())):
        groups.setdefault(c, []).append(i)
    for member in groups.values():
        decompose(parent, values, gained, member)
    return pd.DataFrame({"rep": p["rep"], "depth": p["depth"], "n_leaves": gained[0], "saved": gained[1]})


def rollup(nodes: DataFrame, paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """(rep, depth, n_leaves, saved): ``leaf`` and ``saving`` summed over every node's subtree.

    ``nodes``: rep, depth, up (the parent's rep), weight (of the subtree, each
    node 1 at least), leaf, saving. ``paths``: conv, depth, rep, up for the
    nodes that the conversation ``rep`` of a node passes.
    """
    root = nodes.where("depth = 0").select(F.col("rep").alias("crep"), F.lit(0).cast("bigint").alias("cdepth"))
    live = nodes.crossJoin(F.broadcast(root)).select(
        "rep", "depth", "up", "weight", "leaf", "saving", F.lit(0).cast("bigint").alias("got_leaf"), F.lit(0).cast("bigint").alias("got_saving"), "crep", "cdepth")
    comp = ["crep", "cdepth"]
    ready, cut = [], []
    live = staged(live, "trie-live")
    while True:
        tops = live.where((F.col("rep") == F.col("crep")) & (F.col("depth") == F.col("cdepth"))).select(*comp, F.col("weight").alias("total"))
        large = tops.where(F.col("total") > shard)
        if large.isEmpty():
            ready.append(live)
            break
        # the nodes with half of the weight below them: a chain from the top to the centroid
        half = live.join(large, comp).where(2 * F.col("weight") >= F.col("total"))
        at = staged(half.groupBy(*comp, "total").agg(F.max(F.struct("depth", "rep", "weight")).alias("x"))
                    .select(*comp, "total", F.col("x.rep").alias("xrep"), F.col("x.depth").alias("xdepth"), F.col("x.weight").alias("xweight")), "trie-centroids")
        ready.append(live.join(at, comp, "left_anti"))
        active = live.join(at, comp)
        # where the path of each name passes below the centroid, and through which child
        names = active.groupBy(*comp, "rep", "xrep", "xdepth").agg(F.max("depth").alias("low")).where("low > xdepth")
        step = paths.select(F.col("conv").alias("rep"), (F.col("depth") - 1).alias("xdepth"), F.col("rep").alias("child"), F.col("up").alias("xrep"))
        under = names.join(step, ["rep", "xdepth", "xrep"]).select(*comp, "rep", "child")
        is_x = (F.col("rep") == F.col("xrep")) & (F.col("depth") == F.col("xdepth"))
        active = active.join(under, [*comp, "rep"], "left") \
            .withColumn("part", F.when(is_x, "centroid").when(F.col("child").isNotNull() & (F.col("depth") > F.col("xdepth")), "below")
                        .when(2 * F.col("weight") >= F.col("total"), "path").otherwise("other"))
        active = staged(active, "trie-split")
        totals = active.where("part in ('centroid', 'below')").groupBy(*comp).agg(F.sum("leaf").alias("t_leaf"), F.sum("saving").alias("t_saving"))
        active = active.join(totals, comp)
        gains = lambda c: F.when(F.col("part").isin("path", "centroid"), F.col(f"t_{c}")).otherwise(0)
        active = staged(active.select(
            "rep", "depth", "up", "part", (F.col("weight") - F.when(F.col("part") == "path", F.col("xweight")).otherwise(0)).alias("weight"),
            "leaf", "saving", *[(F.col(f"got_{c}") + gains(c)).alias(f"got_{c}") for c in ("leaf", "saving")],
            F.when(F.col("part") == "below", F.col("child")).otherwise(F.col("crep")).alias("crep"),
            F.when(F.col("part") == "below", F.col("xdepth") + 1).otherwise(F.col("cdepth")).alias("cdepth")), "trie-live")
        cut.append(active.where("part = 'centroid'").select("rep", "depth", F.col("got_leaf").alias("n_leaves"), F.col("got_saving").alias("saved")))
        live = active.where("part <> 'centroid'").drop("part")
    rest = ready[0]
    for r in ready[1:]:
        rest = rest.unionByName(r)
    out = rest.drop("weight").repartition(*comp).sortWithinPartitions(*comp, "depth") \
        .mapInPandas(_finish, "rep bigint, depth bigint, n_leaves bigint, saved bigint")
    for c in cut:
        out = out.unionByName(c)
    return out


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Conversation c becomes the first h turns of conversation c - c % 100 (all if
    it has fewer, none if it is not there) and its own turns behind its first h;
    h = crc32 of the decimal c, modulo 6. Turns are ordered by ``turn``, nulls
    first; ties by role, then by the hash of role and text; repeated rows are
    turns of their own. A null role or text is the empty one; rows with a null
    conversation take no part; an empty table gives no rows. Other columns are
    ignored.

    Columns: conv_id (the smallest conversation through the node), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    with_workers(turns.sparkSession)
    steps, convs = rebuilt(turns, conv, turn, role, text)
    rows = staged(keyed(steps), "trie-keyed")
    top = convs.agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("rep is not null")
    zero = F.lit(0).cast("bigint")
    ends = rows.where(F.col("depth") == F.col("length")).select(*_KEY, "conv") \
        .unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv"))
    ends = staged(endings(ends), "trie-ends")

    found = rows.groupBy(*_KEY).agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"),
                                    F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    # one conversation of each distinct sequence names all nodes there are
    distinct = ends.where("depth > 0").select("conv")
    passed = staged(rows.select("conv", *_KEY).join(distinct, "conv", "left_semi").join(found, _KEY)
                    .select("conv", "depth", "rep", "n_convs", "n_chars", "weight"), "trie-passed")
    above = passed.select("conv", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("up"))
    paths = staged(passed.join(above, ["conv", "depth"], "left").crossJoin(F.broadcast(top.select(F.col("rep").alias("root"))))
                   .withColumn("up", F.coalesce("up", "root")).drop("root"), "trie-paths")
    nodes = paths.where(F.col("conv") == F.col("rep")).select("rep", "depth", "up", "n_convs", "n_chars", "weight") \
        .unionByName(top.select("rep", zero.alias("depth"), F.lit(None).cast("bigint").alias("up"), "n_convs", zero.alias("n_chars"), "weight"))
    kids = paths.where(F.col("conv") == F.col("rep")).groupBy(F.col("up").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = staged(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
                   .withColumn("saving", (F.col("n_convs") - 1) * F.col("n_chars")), "trie-nodes")
    sums = rollup(nodes.select("rep", "depth", "up", "weight", "leaf", "saving"), paths.select("conv", "depth", "rep", "up"), shard)
    # the name of the node at which a conversation ends
    ended = ends.join(paths.select("conv", "depth", "rep"), ["conv", "depth"]).select("rep", "depth", "ends_sha256") \
        .unionByName(ends.where("depth = 0").crossJoin(F.broadcast(top.select("rep"))).select("rep", "depth", "ends_sha256"))
    out = nodes.join(sums, ["rep", "depth"]).join(ended, ["rep", "depth"], "left")
    return out.select(F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
