"""Joins and numbering that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.session import settle

# A side is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
# A key is hot if it holds more than this share (one in ...) of the rows.
HOT_SHARE = 64
# Largest group limit that Spark applies before the shuffle (windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(16)
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = size + F.greatest(F.size(c), F.lit(0)) * 8 + 16
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 64
        else:
            size = size + 8
    return size


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``: does the whole of it fit the broadcast bound?"""
    total = df.agg(F.sum(_row_bytes(df)).alias("b")).first()["b"]
    return (total or 0) <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` to ``right`` by equal keys (inner, left, left_semi or left_anti).

    Both sides are measured. A small ``right`` is broadcast; for an inner join a small ``left``
    is too, so that the large side is not moved. Otherwise rows of ``left`` whose key holds more
    than 1 / HOT_SHARE of them are spread over ``salts`` partitions, to which only the matching
    rows of ``right`` are repeated.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(right, max_bytes):
        return left.join(F.broadcast(right), keys, how)
    if how == "inner" and fits_broadcast(left, max_bytes):
        names = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
        return right.join(F.broadcast(left), keys, how).select(*names)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    many = left.count() / HOT_SHARE
    # fewer than HOT_SHARE keys can be hot
    hot = F.broadcast(settle(counts.filter(F.col("_rows") > many).select(*keys, F.lit(True).alias("_hot"))))
    # salted by row content: the same row gets the same salt when a lost task is run again
    rest = [F.col(f"`{f.name}`") for f in left.schema.fields if not holds_map(f.dataType)]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rest), F.lit(salts))).otherwise(0).cast("int")
    salted = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return False


def attach_children(parents: DataFrame, children: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Every parent with each of its children; a parent without any once, with nulls.

    A parent may own any share of the children: the pairs come from an inner join,
    whose hot keys are salted, and the childless parents from an anti join
    against the distinct keys.
    """
    keys = [on] if isinstance(on, str) else list(on)
    pairs = lookup_join(children, parents, keys)
    used = children.select(*keys).distinct()
    childless = parents.join(used, keys, "left_anti")
    extra = [f for f in children.schema.fields if f.name not in keys]
    for f in extra:
        childless = childless.withColumn(f.name, F.lit(None).cast(f.dataType))
    names = [*parents.columns, *[f.name for f in extra]]
    return pairs.select(*names).unionByName(childless.select(*names))


def _placed(df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    # Rows in global order over partitions of about equal size; the order must be unique,
    # so that a large group is split. Range bounds come from a sample: write the rows out
    # before anything is derived from the partition they are in.
    keys = [F.col(g) for g in group_by] + list(order_by)
    return settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_at"), 33))
    )


def _before(summary: DataFrame, group_by: Sequence[str], value: str) -> DataFrame:
    # at most one row per (partition, group): the sum of earlier partitions of the group
    w = Window.partitionBy(*group_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def _with_summary(placed: DataFrame, before: DataFrame, group_by: Sequence[str]) -> DataFrame:
    keys = ["_part", *group_by]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    extra = [c for c in before.columns if c not in keys]
    return placed.alias("r").join(before.alias("b"), same).select("r.*", *[f"b.{c}" for c in extra])


def number_rows(
    df: DataFrame, order_by: Sequence[Column], group_by: Sequence[str] = (), name: str = "row_number"
) -> DataFrame:
    """Number rows from 1 in ``order_by`` order, per ``group_by`` group or over all rows.

    Takes no window over a whole group: rows are range-partitioned, numbered inside
    their partition, and shifted by the counts of the partitions before.
    """
    placed = _placed(df, group_by, order_by)
    summary = placed.groupBy("_part", *group_by).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    out = _with_summary(placed, _before(summary, group_by, "_rows"), group_by)
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return out.select(*df.columns, number.alias(name))


def running_totals(
    df: DataFrame, totals: dict[str, str], order_by: Sequence[Column], group_by: Sequence[str] = ()
) -> DataFrame:
    """For each new column of ``totals`` the sum of its value column over all earlier rows of the
    group, without a window over it."""
    placed = _placed(df, group_by, order_by)
    summary = placed.groupBy("_part", *group_by).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    earlier = Window.partitionBy(*group_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(
        "_part", *group_by, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    out = _with_summary(placed, before, group_by)
    inside = (
        Window.partitionBy("_part", *group_by)
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = [(F.col(f"_before_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for n, v in totals.items()]
    return out.select(*df.columns, *sums)


def running_total(
    df: DataFrame,
    value: str,
    order_by: Sequence[Column],
    group_by: Sequence[str] = (),
    name: str = "total_before",
) -> DataFrame:
    """``running_totals`` of one column."""
    return running_totals(df, {name: value}, order_by, group_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The row of each key with the smallest ``order_by``; copies of a key merge before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    kept = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order_by)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1.

    Spark limits each group inside the tasks before the shuffle, so at most ``n`` rows per key
    and task travel. It does so for a small ``n`` only; for others each key is first
    limited per salt.
    """
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
        part = Window.partitionBy(*keys, "_salt").orderBy(*order_by)
        salted = df.withColumn("_salt", salt).withColumn("_at", F.row_number().over(part))
        df = salted.filter(F.col("_at") <= n).drop("_salt", "_at")
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
