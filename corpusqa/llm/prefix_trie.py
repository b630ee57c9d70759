"""Prefix trie of conversations, totals of subtrees by centroid decomposition.

A node is a distinct sequence of first turns; its key sums position-tagged SHA-256 digests of the turns,
so the keys of a conversation of any length are running totals and no conversation is gathered.
Every turn says how many turns follow it; summed over the members of a node that is the size of its
subtree, each node counted once a member. With these sizes the tree of parent edges is split at
centroids: the nodes that hold at least half of a component are the path from its top to its
centroid. The centroid's total is added along that path, the parts below it and what is left above
go on by themselves. Components that are small enough are finished in tasks, many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.joins import lookup_join, number_rows, running_totals
from corpusqa.session import settle

# Fixed by the contract of the rebuilt conversations.
GROUP, HEADS = 100, 6

SMALL = 1 << 16  # components up to this size are finished inside a task ...
TASK = 1 << 18  # ... which takes about this much
PIECES = 4  # 32-bit pieces of a digest that are summed


def shared_heads(conv: Column) -> tuple[Column, Column]:
    """(conversation whose first turns are taken, how many): the rule of the contract."""
    return conv - conv % GROUP, (F.crc32(conv.cast("string")) % HEADS).cast("int")


def rebuilt_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, chars, total), (conv_id, total)): turns of the rebuilt conversations, and their lengths.

    Turns are ordered by turn (null first), then role and text.
    """
    rows = messages.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    numbered = number_rows(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv_id"], "pos")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = settle(numbered.select("conv_id", "pos", digest.alias("digest"), F.length("text").cast("long").alias("chars")))
    base, heads = shared_heads(F.col("conv_id"))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"base": base, "h": heads})
    others = own.filter(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("_theirs"))
    taken = F.least(F.col("h").cast("long"), F.coalesce("_theirs", F.lit(0).cast("long")))
    convs = own.join(others, "base", "left").withColumn("taken", taken)
    convs = settle(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))
    heads_ = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    first = convs.join(heads_, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars", "total")
    later = lookup_join(turns, convs, "conv_id").filter("pos > h")
    later = later.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars", "total")
    return first.unionByName(later), convs.select("conv_id", "total")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]))


def prefix_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, total): the node of every turn, and the one before it."""
    tagged = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    pieces = {f"v{i}": F.conv(F.substring("tag", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(PIECES)}
    tagged = turns.withColumn("tag", tagged).select("conv_id", "depth", "chars", "total", *[c.alias(k) for k, c in pieces.items()])
    sums = running_totals(tagged, {f"b{i}": f"v{i}" for i in range(PIECES)}, [F.col("depth")], ["conv_id"])
    before = [F.col(f"b{i}") for i in range(PIECES)]
    after = [F.col(f"b{i}") + F.col(f"v{i}") for i in range(PIECES)]
    return sums.select("conv_id", "depth", _key(F.col("depth"), after).alias("node"), _key(F.col("depth") - 1, before).alias("parent"), "chars", "total")


ROOT = hashlib.md5(",".join(["0"] * (1 + PIECES)).encode()).hexdigest()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # ids of one node that lie together become one text
    for batch in batches:
        if not batch.num_rows:
            continue
        node, ids = batch["node"], batch["conv_id"]
        codes = node.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(codes)).astype(np.int32)), ids.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([node.take(pa.array(begin)), ids.take(pa.array(begin)), pc.binary_join(lists, ",")], names=["node", "first", "ids"])


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # texts come in order; a node may reach over batches
    current, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[str, str]] = []
        for node, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if node == current:
                state.update(b",")
            else:
                if current is not None:
                    done.append((current, state.hexdigest()))
                current, state = node, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["node", "ends_sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends`` (node, conv_id): ids in order, comma-joined.

    The ids of a node, which may be many, are sorted over ranges that split it and joined to texts there; one
    task then only runs over a node's texts, keeping nothing of them.
    """
    texts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_chunks, "node string, first long, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hash_runs, "node string, ends_sha256 string")


VALUES = ("leaves", "saved")


def _finish(table: pa.Table) -> pa.Table:
    """Totals of the subtrees of whole components, all components at once."""
    node = table["node"].combine_chunks()
    n = len(node)
    comp = pc.index_in(table["comp"], value_set=node).to_numpy().astype(np.int64)
    parent = pc.fill_null(pc.index_in(table["parent"], value_set=node), -1).to_numpy().astype(np.int64)
    depth, size = table["depth"].to_numpy(), table["size"].to_numpy().copy()
    own = np.stack([table[v].to_numpy() for v in VALUES])
    total = np.stack([table[f"sum_{v}"].to_numpy() for v in VALUES])
    rows = np.arange(n)
    up, cut = np.arange(n), np.zeros(n, bool)
    while len(rows):
        c = comp[rows]
        path = rows[2 * size[rows] >= size[c]]  # from the top of each component to its centroid
        deepest = np.full(n, -1, np.int64)
        np.maximum.at(deepest, comp[path], depth[path])
        is_centroid = depth[path] == deepest[comp[path]]
        centroid = path[is_centroid]
        of = np.empty(n, np.int64)  # the centroid of a component, kept at its top
        of[comp[centroid]] = centroid
        cut[centroid] = True
        above = parent[rows]
        stays = (rows == c) | cut[rows] | np.where(above >= 0, cut[above], False)
        up[rows] = np.where(stays, rows, above)
        while True:
            further = up[up[rows]]
            if np.array_equal(further, up[rows]):
                break
            up[rows] = further
        below = rows[(up[rows] != c) | cut[rows]]  # the centroid and all under it
        under = np.zeros((len(VALUES), n), own.dtype)
        for k in range(len(VALUES)):
            np.add.at(under[k], comp[below], own[k][below])
        total[:, path] += under[:, comp[path]]
        upper = path[~is_centroid]
        size[upper] -= size[of[comp[upper]]]
        comp[rows] = up[rows]
        cut[centroid] = False
        rows = rows[~np.isin(rows, centroid, assume_unique=True)]
    return pa.Table.from_arrays([node, *[pa.array(total[k]) for k in range(len(VALUES))]], names=["node", *[f"sum_{v}" for v in VALUES]])


def subtree_totals(nodes: DataFrame, paths: DataFrame, small: int = SMALL, task: int = TASK) -> DataFrame:
    """(node, sum_leaves, sum_saved) of ``nodes`` (node, parent, conv_id, depth, size, leaves, saved).

    ``size`` of a node is at least 1 more than its children's together, ``paths`` (conv_id, depth, node,
    parent) names the nodes from the top (depth 1) down to those that belong to ``conv_id``. Components
    above ``small`` are split by joins, each round halves them; what is smaller is finished in tasks.
    """
    start = [F.lit(0).cast("long").alias(f"sum_{v}") for v in VALUES]
    # a node without a parent is the top of a tree
    top = nodes.filter("parent is null").select("node", "size")
    state = nodes.select("node", "parent", "conv_id", "depth", F.lit(ROOT).alias("comp"), "size", *VALUES, *start)
    at = paths.select("conv_id", F.col("depth").alias("at"), F.col("node").alias("child"), F.col("parent").alias("child_of"))
    finished: list[DataFrame] = []
    waiting: list[DataFrame] = []
    active, tops = state, top.select(F.col("node").alias("comp"), F.col("size").alias("whole"))
    while True:
        large = settle(tops.filter(F.col("whole") > small))
        if large.isEmpty():
            waiting.append(active)
            break
        waiting.append(lookup_join(active, large, "comp", "left_anti"))
        rows = lookup_join(active, large, "comp")
        on_path = 2 * F.col("size") >= F.col("whole")
        found = rows.filter(on_path).groupBy("comp").agg(F.max_by(F.struct("node", "depth", "size"), "depth").alias("c"))
        centroids = settle(found.select("comp", F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")))
        rows = lookup_join(rows, centroids, "comp")
        rows = rows.withColumn("at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        rows = lookup_join(rows, at, ["conv_id", "at"], "left")
        under = F.coalesce(F.col("child_of") == F.col("c_node"), F.lit(False))
        own = F.col("node") == F.col("c_node")
        rows = settle(rows.select(
            *state.columns, on_path.alias("on_path"), own.alias("is_c"), "c_size",
            F.when(under, F.col("child")).otherwise(F.col("comp")).alias("part"), (under | own).alias("below"),
        ))
        totals = rows.filter("below").groupBy("comp").agg(*[F.sum(v).alias(f"t_{v}") for v in VALUES])
        rows = lookup_join(rows, settle(totals), "comp")
        added = [(F.col(f"sum_{v}") + F.when(F.col("on_path"), F.col(f"t_{v}")).otherwise(0)).alias(f"sum_{v}") for v in VALUES]
        left = F.col("size") - F.when(F.col("on_path") & ~F.col("is_c"), F.col("c_size")).otherwise(0)
        rows = settle(rows.select("node", "parent", "conv_id", "depth", F.col("part").alias("comp"), left.alias("size"), *VALUES, *added, "is_c"))
        finished.append(rows.filter("is_c").select("node", *[f"sum_{v}" for v in VALUES]))
        active = rows.filter("not is_c").drop("is_c")
        tops = active.filter(F.col("node") == F.col("comp")).select("comp", F.col("size").alias("whole"))
    rest = waiting[0]
    for more in waiting[1:]:
        rest = rest.unionByName(more)
    rest = settle(rest.select("node", "parent", "comp", "depth", "size", *VALUES, *[f"sum_{v}" for v in VALUES]))
    whole = rest.filter(F.col("node") == F.col("comp")).agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-whole // task))
    out = rest.groupBy(F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("task")).applyInArrow(_finish, "node string, " + ", ".join(f"sum_{v} long" for v in VALUES))
    for part in finished:
        out = out.unionByName(part)
    return out


def conversation_trie(messages: DataFrame, small: int = SMALL, task: int = TASK) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``messages`` has conv_id, turn, role and text. Turns are ordered by turn (null first), then by role
    and text; repeated rows are turns of their own. A null role or text is empty. Rows without
    a conv_id belong to no conversation. An empty table gives no rows, not even a root. Other
    columns are ignored. Nodes are told apart by 128 bits summed from SHA-256 digests.
    """
    turns, convs = rebuilt_turns(messages)
    paths = settle(prefix_paths(turns))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), zero.alias("chars"), "total")
    members = paths.unionByName(roots)
    nodes = members.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"), F.sum(F.col("total") - F.col("depth") + 1).alias("size"),
    )
    nodes = settle(nodes)
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = settle(lookup_join(nodes, nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    forest = nodes.select("node", "parent", "conv_id", "depth", "size", (F.col("n_children") == 0).cast("long").alias("leaves"), saved.alias("saved"))
    totals = subtree_totals(forest, paths, small, task)
    ends = paths.filter("depth = total").select("node", "conv_id").unionByName(convs.filter("total = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    out = nodes.join(totals, "node").join(end_digests(ends), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
