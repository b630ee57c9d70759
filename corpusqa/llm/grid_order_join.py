"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2 t) apart. Vectors are sorted by the
grid cells (of side eps) of their leading principal coordinates and cut into intervals of that
order. Pairs of intervals are joined recursively, from runs of intervals down to single ones,
and skipped where their bounding boxes in the principal coordinates are more than eps apart;
inside a task the recursion goes on with short runs of vectors. Surviving runs are compared
exactly, in double precision, on the original vectors.

Equal vectors are one class with a multiplicity. A task tells how many links each class has and
the fewest links that connect what it joined, so a group of any size sends no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.components import components
from corpusqa.operators.joins import number_rows
from corpusqa.session import new_folder

THRESHOLD = 0.9
CELL_DIMS = 6  # leading principal coordinates in the sort key
BOX_DIMS = 16  # leading principal coordinates in bounding boxes
INTERVAL = 4096  # classes that travel together
RUN = 128  # classes compared at once inside a task
FAN = 16  # intervals or runs in one of the next level


def is_valid(vec_id: Column, v: Column) -> Column:
    """An id, and a vector of finite components that are not all zero."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec_id.isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the valid rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(is_valid(F.col("vec_id"), F.col("v")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # the square of a large component may not be finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dims + 1, dims + 1))
    for batch in batches:
        u = np.column_stack([unit(matrix(batch.column(0))), np.ones(batch.num_rows)])
        total += u.T @ u
    i, j = np.triu_indices(dims + 1)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "x"])


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Columns: directions of falling variance of all unit vectors (dims x dims numbers travel)."""
    sums = vectors.select("v").mapInArrow(partial(_moments, dims=dims), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    whole = np.zeros((dims + 1, dims + 1))
    i, j, x = (sums[c].to_numpy() for c in ("i", "j", "x"))
    whole[i, j] = whole[j, i] = x
    n = max(whole[dims, dims], 1)
    mean = whole[dims, :dims] / n
    _, axes = np.linalg.eigh(whole[:dims, :dims] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def _cells(batches: Iterator[pa.RecordBatch], axes, eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near = np.floor(unit(matrix(batch.column(1))) @ axes[:, :CELL_DIMS] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(list(near), pa.list_(pa.int32()))], names=["vec_id", "v", "copies", "cell"]
            )


_INTERVAL = "interval long, size int, ids binary, copies binary, vectors binary, low array<double>, high array<double>"


def _gather(table: pa.Table, axes) -> pa.Table:
    order = np.argsort(table["position"].to_numpy(), kind="stable")
    u = unit(matrix(table["v"]))[order]
    near = u @ axes[:, :BOX_DIMS]
    return pa.Table.from_arrays(
        [pa.array([table["interval"][0].as_py()], pa.int64()), pa.array([len(u)], pa.int32()), pa.array([table["position"].to_numpy()[order].tobytes()], pa.binary()),
         pa.array([table["copies"].to_numpy()[order].tobytes()], pa.binary()), pa.array([u.tobytes()], pa.binary()), pa.array([near.min(0)]), pa.array([near.max(0)])],
        names=["interval", "size", "ids", "copies", "vectors", "low", "high"],
    )


def _gap(low, high, other_low, other_high):
    """Least distance of points of two boxes."""
    return np.sqrt((np.maximum(0, np.maximum(low - other_high, other_low - high)) ** 2).sum(-1))


class _Forest:
    """Components of local numbers; links are given as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def join_intervals(a: np.ndarray, b: np.ndarray | None, copies_a: np.ndarray, copies_b: np.ndarray, axes: np.ndarray, threshold: float):
    """(links of rows of a, links of rows of b, local roots) of unit vectors; b None: a with itself."""
    eps = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    other = a if b is None else b
    n, m = len(a), len(other)
    links_a, links_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    forest = _Forest(n if b is None else n + m)
    shift = 0 if b is None else n

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, heads = x @ axes[:, :BOX_DIMS], np.arange(0, len(x), RUN)
        return np.minimum.reduceat(near, heads), np.maximum.reduceat(near, heads)

    (la, ha), (lb, hb) = boxes(a), boxes(other)

    def recurse(i: int, j: int, k: int, l: int) -> None:
        # runs i to j of a against runs k to l of the other
        if b is None and l <= i:
            return
        if _gap(la[i:j].min(0), ha[i:j].max(0), lb[k:l].min(0), hb[k:l].max(0)) > eps:
            return
        if j - i > 1 or l - k > 1:
            s, t = max(1, -(-(j - i) // 4)), max(1, -(-(l - k) // 4))
            for p in range(i, j, s):
                for q in range(k, l, t):
                    recurse(p, min(p + s, j), q, min(q + t, l))
            return
        x, y = slice(i * RUN, (i + 1) * RUN), slice(k * RUN, (k + 1) * RUN)
        found = a[x] @ other[y].T >= threshold
        if b is None and i == k:
            np.fill_diagonal(found, False)
        elif b is None and k < i:
            return
        if not found.any():
            return
        links_a[x] += found @ copies_b[y]
        if b is None:
            if i != k:
                links_a[y] += copies_a[x] @ found
        else:
            links_b[y] += copies_a[x] @ found
        p, q = np.nonzero(found)
        forest.join(p + x.start, q + y.start + shift)

    recurse(0, len(la), 0, len(lb))
    return links_a, links_b, forest.root


def _join(batches: Iterator[pa.RecordBatch], axes, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(k)[r] for k, c in enumerate(batch.schema.names)}
            size = row["size_a"].as_py()

            def part(side: str, n: int):
                return (np.frombuffer(row[f"ids_{side}"].as_buffer(), np.int64), np.frombuffer(row[f"copies_{side}"].as_buffer(), np.int64), np.frombuffer(row[f"vectors_{side}"].as_buffer(), np.float64).reshape(n, -1))  # noqa: B023

            ids, copies, x = part("a", size)
            if row["i"].as_py() == row["j"].as_py():
                own, _, root = join_intervals(x, None, copies, copies, axes, threshold)
                links = own
            else:
                more, copies_b, y = part("b", row["size_b"].as_py())
                own, theirs, root = join_intervals(x, y, copies, copies_b, axes, threshold)
                ids, links = np.concatenate([ids, more]), np.concatenate([own, theirs])
            tied = np.flatnonzero(root != np.arange(len(root)))
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[has], ids[tied]])), pa.array(np.concatenate([links[has], np.zeros(len(tied), np.int64)])), pa.array(np.concatenate([np.full(len(has), -1), ids[root[tied]]]))],
                names=["a", "links", "b"],
            )


def _interval_pairs(intervals: DataFrame, eps: float) -> DataFrame:
    """(i, j), i <= j: intervals whose boxes are within eps, found level by level."""
    levels = [intervals.select(F.col("interval").alias("id"), "low", "high")]
    count = levels[0].count()
    dims = BOX_DIMS
    while count > FAN:
        low = F.array(*[F.min(F.get("low", F.lit(d))) for d in range(dims)])
        high = F.array(*[F.max(F.get("high", F.lit(d))) for d in range(dims)])
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(low.alias("low"), high.alias("high")))
        count = -(-count // FAN)
    top = intervals.sparkSession.range(count).select(F.col("id").alias("i"))  # at most FAN numbers
    pairs = top.select("i", F.explode(F.sequence("i", F.lit(count - 1).cast("long"))).alias("j"))
    while levels:
        level = levels.pop()
        a = level.select(F.col("id").alias("i"), F.col("low").alias("la"), F.col("high").alias("ha"))
        b = level.select(F.col("id").alias("j"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        gap = F.zip_with(
            F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
        )
        near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + F.coalesce(g, F.lit(0.0)) * F.coalesce(g, F.lit(0.0))) <= eps * eps
        pairs = pairs.join(a, "i").join(b, "j").filter(near).select("i", "j")
        if levels:
            # numbers that no interval has find no box
            pairs = (
                pairs.select(F.explode(F.sequence(F.col("i") * FAN, F.col("i") * FAN + FAN - 1)).alias("i"), "j")
                .select("i", F.explode(F.sequence(F.col("j") * FAN, F.col("j") * FAN + FAN - 1)).alias("j")).filter("i <= j")
            )
    return pairs


def _same_length(classes: DataFrame, dims: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((position, vec_id) of each class, (a, links, b) of the join) of vectors of one length."""
    spark = classes.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)
    axes = principal_axes(classes, dims)
    celled = classes.select("vec_id", "v", "copies").mapInArrow(partial(_cells, axes=axes, eps=eps), "vec_id long, v array<double>, copies long, cell array<int>")
    cells = [F.get("cell", F.lit(d)) for d in range(min(CELL_DIMS, dims))]
    placed = number_rows(celled, [*cells, F.col("vec_id"), F.xxhash64("v")], name="position")
    rows = placed.withColumn("interval", F.floor((F.col("position") - 1) / INTERVAL))
    path = new_folder(spark, "grid-intervals")
    rows.select("interval", "position", "v", "copies").groupBy("interval").applyInArrow(lambda t: _gather(t, axes), _INTERVAL).write.parquet(path)
    intervals = spark.read.schema(_INTERVAL).parquet(path)
    pairs = _interval_pairs(intervals.select("interval", "low", "high"), eps)
    a = intervals.select(F.col("interval").alias("i"), *[F.col(c).alias(f"{c}_a") for c in ("size", "ids", "copies", "vectors")])
    b = intervals.select(F.col("interval").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("size", "ids", "copies", "vectors")])
    found_at = new_folder(spark, "grid-links")
    tasks = pairs.repartition(max(1, min(10_000, pairs.count())), "i", "j")
    tasks.join(a, "i").join(b, "j").mapInArrow(partial(_join, axes=axes, threshold=threshold), "a long, links long, b long").write.parquet(found_at)
    return placed.select("position", "vec_id", "v", "copies"), spark.read.parquet(found_at)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Links join vectors with cosine >= ``threshold`` (over 0), whatever their other columns say. A
    vector that is null, zero or holds null or non-finite components links with nothing, nor
    does a row without an id (its component is null). Vectors of different lengths never link.
    Rows that repeat an id count as vectors of their own. An empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine over 0")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = valid_vectors(rows)
    classes = valid.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    lengths = [r["n"] for r in valid.select(F.size("v").alias("n")).distinct().collect()]  # a few lengths
    result = None
    for dims in sorted(lengths):
        placed, found = _same_length(classes.filter(F.size("v") == dims), dims, threshold)
        links = found.groupBy("a").agg(F.sum("links").alias("links"))
        roots = components(found.filter("b >= 0").select("a", "b"))
        out = (
            placed.join(links.withColumnRenamed("a", "position"), "position", "left")
            .join(roots.withColumnRenamed("node", "position"), "position", "left")
            .select("v", F.coalesce("root", "position").alias("root"), "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        )
        least = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
        out = out.join(least, "root").select("v", "n_links", "component_id")
        result = out if result is None else result.unionByName(out)
    if result is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = valid.join(result, "v").select("vec_id", "n_links", "component_id")
    lone = rows.filter(~is_valid(F.col("vec_id"), F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
