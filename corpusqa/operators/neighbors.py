"""Exact nearest neighbours by cosine. Spark deals out blocks of vectors, numpy scores them: all pairs in single
precision, in double precision those that its rounding errors do not rule out.

Items are dealt to a few pivots by direction, and a pivot's items to slices. No item of a pivot can be
nearer to a query than the angle between query and pivot, less the widest angle of the pivot's
items, allows. A query looks into the most promising slice first; what its n-th score there is,
another pivot must be able to reach to be looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.functions.vectors import from_best
from corpusqa.operators.joins import lookup_join, top_per_key
from corpusqa.session import settle

# Measured bytes of the queries, and of the items, that one task scores against one another.
QUERY_BYTES = 32 * 1024 * 1024
ITEM_BYTES = 64 * 1024 * 1024
BIN_SLICES = 4  # whole slices that fit the items of a task
# Pairs that are worth a task of their own.
BLOCK_PAIRS = 1 << 26
# Queries, and items, scored at once.
SCORE_ROWS = 256
SCORE_ITEMS = 4096
HELD = 1 << 21  # scores kept before all but the best are dropped
# Key that orders what has no score below every similarity.
NO_SCORE = -2.0
MOST_PIVOTS = 128
SAMPLE = 16  # vectors for each pivot that its place is learned from
ROUNDS = 4
SLACK = 2e-6  # scores are compared when rounded to six places
NO_PIVOT = -1  # of zero vectors and vectors that hold no number


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists of doubles; a null element is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _by_length(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of unit vectors) for each length; what has no direction is NaN."""
    values, offsets = _lists(column)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        x = values[offsets[rows][:, None] + np.arange(size)] if len(rows) < len(sizes) else values.reshape(len(rows), size)
        with np.errstate(all="ignore"):
            yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if size else np.full((len(rows), 0), np.nan)


def _directed(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x).all(axis=1) & (x.shape[1] > 0)


def _pivots(items: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit directions for each length of vector, from a bounded sample, by spherical k-means."""
    wanted = SAMPLE * count
    rows = items.count()
    place = F.pmod(F.xxhash64("item", "vec"), F.lit(1 << 30))
    near = items.filter(place * F.lit(rows) <= 4.0 * wanted * (1 << 30))  # a few times the sample, however many there are
    sample = near.orderBy(place).limit(wanted).select("vec").toArrow()["vec"]
    out: dict[int, np.ndarray] = {}
    if not len(sample):
        return out
    for _, x in _by_length(sample):
        x = x[_directed(x)]
        if not len(x):
            continue
        c = x[: max(1, count * len(x) // len(sample))]
        for _ in range(ROUNDS):
            home = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, home, x)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
        out[x.shape[1]] = c
    return out


def _assign(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Unit vectors with their pivot and the cosine to it."""
    for batch in batches:
        n = batch.num_rows
        size, home, cosine = np.zeros(n, np.int32), np.full(n, NO_PIVOT, np.int32), np.zeros(n)
        parts, order = [], []
        for rows, x in _by_length(batch.column(1)):
            size[rows] = x.shape[1]
            some = _directed(x)
            c = pivots.get(x.shape[1])
            if some.any():
                near = x[some] @ c.T if c is not None else np.full((int(some.sum()), 1), -1.0)
                home[rows[some]] = near.argmax(axis=1)
                cosine[rows[some]] = near.max(axis=1)
            parts.append(np.where(some[:, None], x, np.nan).reshape(-1))
            order.append(rows)
        if not n:
            continue
        order = np.concatenate(order)
        ends = np.concatenate([[0], np.cumsum(size[order])]).astype(np.int32)
        vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts))).take(pa.array(np.argsort(order)))
        yield pa.RecordBatch.from_arrays([batch.column(0), vec, pa.array(size), pa.array(home), pa.array(cosine)], names=["item", "vec", "size", "pivot", "cosine"])


def _bounds(x: np.ndarray, groups: np.ndarray, pivots: dict[int, np.ndarray]) -> np.ndarray:
    """The best score that each query could have in each of ``groups`` (size, pivot, items, slices, least cosine)."""
    out = np.full((len(x), len(groups)), -1.0)  # vectors of another length score -1
    same = groups["size"] == x.shape[1]
    out[:, same] = NO_SCORE
    near = np.flatnonzero(same & (groups["pivot"] != NO_PIVOT))
    some = np.flatnonzero(_directed(x))
    if len(near) and len(some):
        c = pivots.get(x.shape[1])
        if c is None:  # no pivot is known: anything may be there
            out[np.ix_(some, near)] = 1.0
        else:
            angle = np.arccos(np.clip(x[some] @ c[groups["pivot"][near]].T, -1, 1))
            wide = np.arccos(np.clip(groups["least"][near], -1, 1))
            out[np.ix_(some, near)] = np.cos(np.maximum(angle - wide, 0))
    return out


def _choose(batches: Iterator[pa.RecordBatch], groups: np.ndarray, pivots: dict[int, np.ndarray], n: int, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slices each query looks into: the first ones, where it has no ``floor`` yet, else the others that can reach it.

    A query's vector goes to each bin of slices once.
    """
    many = groups["slices"].astype(np.int64)
    first_slice = np.cumsum(many) - many
    for batch in batches:
        floors = batch.column(2).to_numpy(zero_copy_only=False)  # NaN where null
        asked = batch.column(3).to_numpy(zero_copy_only=False)  # is this the second look?
        chosen: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
        for rows, x in _by_length(batch.column(1)):
            if len(bins) and bins[-1] == 0:  # one bin: all are looked into at once
                for row in rows.tolist():
                    chosen[row] = np.arange(len(bins))
                continue
            bounds = _bounds(x, groups, pivots)
            order = np.argsort(-bounds, axis=1, kind="stable")
            for k, row in enumerate(rows.tolist()):
                # the first look: whole slices from the best pivot on, until they may hold n
                seen, first = 0, []
                for g in order[k].tolist():
                    each = max(1, int(groups["items"][g]) // int(many[g]))
                    take = min(int(many[g]), -(-(n - seen) // each))
                    first.append(first_slice[g] + np.arange(take))
                    seen += take * each
                    if seen >= n:
                        break
                first = np.concatenate(first) if first else np.zeros(0, np.int64)
                if not asked[row]:
                    chosen[row] = first
                    continue
                able = np.ones(len(groups), bool) if np.isnan(floors[row]) else bounds[k] >= floors[row] - SLACK
                every = np.concatenate([first_slice[g] + np.arange(many[g]) for g in np.flatnonzero(able)]) if able.any() else first[:0]
                chosen[row] = np.setdiff1d(every, first)
        rows = np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen])
        slices = np.sort(np.concatenate(chosen) + rows * len(bins)) - rows * len(bins) if len(rows) else np.zeros(0, np.int64)
        # slices of a bin are neighbours
        heads = np.flatnonzero(np.diff(rows * len(bins) + bins[slices], prepend=-1)) if len(rows) else rows
        ends = np.append(heads, len(rows))
        for a in range(0, len(heads), 4096):
            b = min(a + 4096, len(heads))
            at = pa.array(rows[heads[a:b]])
            lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(slices[ends[a] : ends[b]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(bins[slices[heads[a:b]]].astype(np.int32)), lists],
                names=["qid", "vec", "floor", "bin", "slices"])


def _places(ids: pa.Array) -> np.ndarray:
    """The place of each id among all in order."""
    order = pc.sort_indices(ids).to_numpy() if not pa.types.is_nested(ids.type) else np.array(sorted(range(len(ids)), key=lambda i: repr(ids[i].as_py())))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


def _banned(banned: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) by place, in order of the queries: the items that do not count."""
    none = np.zeros(0, np.int64)
    flat = banned.flatten()
    if not len(flat):
        return none, none
    owner = np.repeat(np.arange(len(banned)), pc.fill_null(pc.list_value_length(banned), 0).to_numpy(zero_copy_only=False))
    names = pc.unique(ids)
    place = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
    owner, place = owner[place >= 0], place[place >= 0]
    number = pc.index_in(ids, value_set=names).to_numpy(zero_copy_only=False)
    by = np.argsort(number, kind="stable")
    start = np.searchsorted(number[by], np.arange(len(names) + 1))
    copies = start[place + 1] - start[place]
    within = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
    return np.repeat(owner, copies), by[np.repeat(start[place], copies) + within]


def _first(q: np.ndarray, keys: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """The places of the best ``n`` of each query: highest key, then smallest rank."""
    best = np.lexsort((rank, -keys, q))
    q = q[best]
    return best[np.arange(len(q)) - np.searchsorted(q, q) < n]


class _Found:
    """What may be among the best ``n`` items of a few queries, and the score that another must reach."""

    def __init__(self, floors: np.ndarray, rank: np.ndarray, n: int):
        self.rank, self.n = rank, n
        self.least = np.where(np.isnan(floors), -np.inf, floors - SLACK)
        self.top = np.full((len(floors), n), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, q: np.ndarray, item: np.ndarray, scores: np.ndarray) -> None:
        keys = np.where(np.isnan(scores), NO_SCORE, np.round(scores, 6))
        self.parts.append((q, item, scores, keys))
        self.held += len(q)
        by = np.lexsort((-keys, q))
        own = q[by]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        by, place = by[place < self.n], place[place < self.n]
        if len(by):
            mine, row = np.unique(q[by], return_inverse=True)
            new = np.full((len(mine), self.n), -np.inf)
            new[row, place] = keys[by]
            self.top[mine] = -np.partition(-np.concatenate([self.top[mine], new], axis=1), self.n - 1, axis=1)[:, : self.n]
            self.least[mine] = np.maximum(self.least[mine], self.top[mine, self.n - 1] - SLACK)
        if self.held > HELD:
            self.parts = [self.best()]
            self.held = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, ...]:
        q, item, scores, keys = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        at = _first(q, keys, self.rank[item], self.n)
        return q[at], item[at], scores[at], keys[at]


def _products(a: np.ndarray, b: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The products of rows ``q`` of ``a`` with rows ``v`` of ``b``, in double precision."""
    if len(q) * 8 > len(a) * len(b):
        return (a @ b.T)[q, v]
    out = np.empty(len(q))
    for k in range(0, len(q), 1 << 15):
        out[k : k + (1 << 15)] = np.einsum("ij,ij->i", a[q[k : k + (1 << 15)]], b[v[k : k + (1 << 15)]])
    return out


def _near(found: _Found, mine: np.ndarray, x: np.ndarray, rough: np.ndarray, at: np.ndarray, v: np.ndarray, f: np.ndarray, left: tuple[np.ndarray, np.ndarray]) -> None:
    """Scores the items ``at`` for the queries ``mine``: all in single precision, in double what can be among the best."""
    error = (x.shape[1] + 8) * 2.0**-22  # of a single precision product of unit vectors, and of its bound
    row = np.full(len(found.least), -1)
    row[mine] = np.arange(len(mine))
    for a in range(0, len(at), SCORE_ITEMS):
        scores = rough[mine] @ f[a : a + SCORE_ITEMS].T
        if len(left[0]):
            here = (left[1] >= a) & (left[1] < a + scores.shape[1]) & (row[left[0]] >= 0)
            scores[row[left[0][here]], left[1][here] - a] = -np.inf
        least = found.least[mine]
        unseen = np.flatnonzero(np.isneginf(least))
        if len(unseen) and scores.shape[1] > found.n:
            edge = np.partition(scores[unseen], scores.shape[1] - found.n, axis=1)[:, scores.shape[1] - found.n]
            least[unseen] = edge - error - SLACK
        q, k = np.nonzero(scores >= (least - error)[:, None].astype(np.float32))
        there = scores[q, k] > -np.inf
        q, k = q[there], k[there]
        if len(q):
            found.add(mine[q], at[a + k], _products(x[mine], v[a : a + SCORE_ITEMS], q, k))


def _level(found: _Found, mine: np.ndarray, score: float, at: np.ndarray, left: tuple[np.ndarray, np.ndarray]) -> None:
    """Items that all have the same score: the first ones count, those left out aside."""
    most = int(np.bincount(left[0]).max()) if len(left[0]) else 0
    some = np.argsort(found.rank[at], kind="stable")[: found.n + most]
    q, k = np.repeat(mine, len(some)), np.tile(some, len(mine))
    if most:
        there = ~np.isin(q * len(at) + k, left[0] * len(at) + left[1])
        q, k = q[there], k[there]
    found.add(q, at[k], np.full(len(q), score))


def _best(queries: pa.Table, items: pa.Table, n: int, schema: pa.Schema) -> pa.Table:
    """The best ``n`` items of each query in the slices it looks into: highest rounded score first, then smallest
    item; NaN last. What lies below a query's floor may be missing."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids = items["item"].combine_chunks()
    rank = _places(ids)
    owner, banned = _banned(queries["banned"].combine_chunks(), ids)
    floors = queries["floor"].to_numpy()
    wanted = queries["slices"].combine_chunks()
    of = items["slice"].to_numpy()
    names = np.unique(of)
    looks = np.zeros((queries.num_rows, int(max(names.max(), pc.max(wanted.flatten()).as_py())) + 1), bool)
    looks[np.repeat(np.arange(queries.num_rows), pc.list_value_length(wanted).to_numpy()), wanted.flatten().to_numpy()] = True
    stored = []
    for at, v in _by_length(items["vec"]):
        some = _directed(v)
        by = np.lexsort((some, of[at]))
        at, v, some = at[by], v[by], some[by]
        # runs of one slice, with or without a direction
        heads = np.flatnonzero(np.diff(of[at] * 2 + some, prepend=-1))
        stored.append((at, v, v.astype(np.float32), some, heads, np.append(heads[1:], len(at))))
    spot = np.empty(len(ids), np.int64)
    for rows, x in _by_length(queries["vec"]):
        for a in range(0, len(rows), SCORE_ROWS):
            part, y = rows[a : a + SCORE_ROWS], x[a : a + SCORE_ROWS]
            directed, rough = _directed(y), y.astype(np.float32)
            found = _Found(floors[part], rank, n)
            row = np.searchsorted(part, owner)
            own = (row < len(part)) & (part[np.minimum(row, len(part) - 1)] == owner)
            left_q, left_v = row[own], banned[own]
            for at, v, f, some, heads, ends in stored:
                for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
                    look = looks[part, of[at[h]]]
                    if not look.any():
                        continue
                    left = left_q, left_v
                    if len(left_q):
                        spot[:] = -1
                        spot[at[h:e]] = np.arange(e - h)
                        here = spot[left_v] >= 0
                        left = left_q[here], spot[left_v[here]]
                    same = v.shape[1] == y.shape[1]
                    near = look & directed & bool(same and some[h])
                    if near.any():
                        _near(found, np.flatnonzero(near), y, rough, at[h:e], v[h:e], f[h:e], left)
                    if (look & ~near).any():
                        _level(found, np.flatnonzero(look & ~near), float("nan") if same else -1.0, at[h:e], left)
            if found.parts:
                q, item, scores, _ = found.best()
                out.append((part[q], item, scores))
    q, v, s = (np.concatenate([f[k] for f in out]) if out else np.zeros(0, np.int64) for k in range(3))
    return pa.Table.from_arrays([queries["qid"].combine_chunks().take(pa.array(q)), ids.take(pa.array(v)), pa.array(s, pa.float64())], schema=schema)


def _bytes(column: str) -> Column:
    return F.size("vec").cast("long") * 8 + F.octet_length(F.col(column).cast("string")) + 64


class _Slices:
    """Items dealt to slices, slices to bins that fit a task, and what is known of each pivot's."""

    def __init__(self, items: DataFrame, n: int):
        self.items_type = items.schema["item"].dataType.simpleString()
        self.n = n
        items = settle(items)  # read for their size, for the pivots and at each look
        total = items.agg(F.sum(_bytes("item"))).first()[0] or 0
        slice_bytes = max(1, ITEM_BYTES // BIN_SLICES)
        self.pivots = _pivots(items, min(MOST_PIVOTS, 4 * math.ceil(total / slice_bytes))) if total > ITEM_BYTES else {}
        assigned = items.mapInArrow(partial(_assign, pivots=self.pivots), f"item {self.items_type}, vec array<double>, size int, pivot int, cosine double")
        # a row for each pivot and length of vectors
        known = assigned.groupBy("size", "pivot").agg(F.count(F.lit(1)).alias("items"), F.sum(_bytes("item")).alias("bytes"), F.min("cosine").alias("least"))
        rows = known.orderBy("size", "pivot").collect()
        self.groups = np.array(
            [(r["size"], r["pivot"], r["items"], max(1, math.ceil(r["bytes"] / slice_bytes)), r["least"]) for r in rows],
            dtype=[("size", "i4"), ("pivot", "i4"), ("items", "i8"), ("slices", "i8"), ("least", "f8")])
        many = self.groups["slices"]
        starts = (np.cumsum(many) - many).tolist()
        # neighbouring slices share a bin while they fit it
        held, last = 0.0, 0
        self.bins, self.bin_items = np.zeros(int(many.sum()), np.int64), [0.0]
        for r, start, k in zip(rows, starts, many.tolist(), strict=True):
            for s in range(start, start + k):
                if held and held + r["bytes"] / k > ITEM_BYTES:
                    held, last = 0.0, last + 1
                    self.bin_items.append(0.0)
                held += r["bytes"] / k
                self.bins[s] = last
                self.bin_items[last] += r["items"] / k
        table = items.sparkSession.createDataFrame(
            [(r["size"], r["pivot"], s, int(k)) for r, s, k in zip(rows, starts, many, strict=True)], "size int, pivot int, _start long, _many long")
        dealt = F.col("_start") + F.pmod(F.xxhash64("item", "vec"), F.col("_many"))
        names = F.array(*[F.lit(b) for b in self.bins.tolist()]).cast("array<int>")
        self.items = assigned.join(F.broadcast(table), ["size", "pivot"]).select("item", "vec", dealt.cast("int").alias("slice")).withColumn("bin", F.get(names, F.col("slice")))

    def chosen(self, queries: DataFrame, floors: DataFrame | None) -> DataFrame:
        """(qid, vec, floor, bin, slices): where each query looks, first or, with ``floors`` (qid, floor), after that."""
        asked = queries.select("qid", "vec")
        if floors is None:
            asked = asked.select("*", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("again"))
        else:
            asked = lookup_join(asked, floors, "qid", "left").select("qid", "vec", "floor", F.lit(True).alias("again"))
        kind = queries.schema["qid"].dataType.simpleString()
        choose = partial(_choose, groups=self.groups, pivots=self.pivots, n=self.n, bins=self.bins)
        return asked.mapInArrow(choose, f"qid {kind}, vec array<double>, floor double, bin int, slices array<int>")

    def _blocks(self, chosen: DataFrame) -> list[int]:
        """For each bin the blocks that its queries are cut into: as many as their bytes, and the cores there are, ask for."""
        looks = {r["bin"]: r for r in chosen.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.sum(_bytes("qid")).alias("bytes")).collect()}
        work = [looks[b]["rows"] * items if b in looks else 0 for b, items in enumerate(self.bin_items)]
        cells = 2 * chosen.sparkSession.sparkContext.defaultParallelism
        return [
            max(1, math.ceil((looks[b]["bytes"] or 0) / QUERY_BYTES), min(math.ceil(w / BLOCK_PAIRS), math.ceil(cells * w / sum(work)))) if b in looks else 0
            for b, w in enumerate(work)]

    def scores(self, chosen: DataFrame, exclude: DataFrame | None) -> DataFrame:
        """The best of each query in each bin it looks into."""
        kind = chosen.schema["qid"].dataType.simpleString()
        if exclude is None:
            asked = chosen.withColumn("banned", F.lit(None).cast(f"array<{self.items_type}>"))
        else:
            # an excluded item is told to the bin it is in, once
            out = lookup_join(self.items.select("item", "bin"), exclude.select("qid", F.col("item").cast(self.items_type).alias("item")).distinct(), "item")
            asked = chosen.join(out.groupBy("qid", "bin").agg(F.collect_set("item").alias("banned")), ["qid", "bin"], "left")
        blocks = F.get(F.array(*[F.lit(b) for b in self._blocks(chosen)]).cast("array<int>"), F.col("bin"))
        asked = asked.select("qid", "vec", "floor", "slices", "banned", "bin", F.pmod(F.xxhash64("qid", "vec"), blocks).cast("int").alias("block"))
        # a bin that no query looks into is not moved
        items = self.items.withColumn("block", F.explode(F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1))))
        schema = f"qid {kind}, item {self.items_type}, score double"
        n = self.n

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            types = pa.schema([("qid", left.schema.field("qid").type), ("item", right.schema.field("item").type), ("score", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return types.empty_table()
            return _best(left, right, n, types)

        local = asked.groupBy("bin", "block").cogroup(items.groupBy("bin", "block")).applyInArrow(score, schema)
        return local.withColumn("score", F.coalesce("score", F.lit(float("nan"))))


def _prepared(queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(
        df.select(name, F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
        for df, name in ((queries, "qid"), (items, "item"))
    )


def _floors(found: DataFrame, n: int) -> DataFrame:
    """(qid, floor): the n-th score so far, as a key that can be compared; null where there are fewer."""
    best = top_per_key(found, ["qid"], [from_best(F.col("score")), F.col("item")], n)
    key = F.when(F.isnan("score"), NO_SCORE).otherwise(F.round("score", 6))
    return best.groupBy("qid").agg(F.max(F.when(F.col("rank") == n, key)).alias("floor"))


def nearest_neighbors(
    queries: DataFrame,
    items: DataFrame,
    n: int = fixed.NEIGHBORS,
    strict_n: bool = False,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Top ``n`` items per query vector: (qid, item, score, rank), ties by item.

    ``queries`` has (qid, vec), ``items`` has (item, vec), ``exclude`` (qid, item) pairs that do
    not count. A vector of another length scores -1. With ``strict_n`` a query with fewer than
    ``n`` items gets none. A qid names one query.

    Queries are cut into blocks and items into slices, slices into bins of a bounded size; each (bin, block) is one
    task's work, which gives at most n rows per query. Items that fit one bin are scored at
    once. More are dealt to pivots, and a query looks only into slices that its n-th score of the
    first ones does not rule out, and is told only what can be among its best: the result is exact, whatever the pivots
    are.
    """
    queries, items = _prepared(queries, items)
    queries = settle(queries)
    slices = _Slices(items, n)
    if len(slices.bin_items) <= 1:
        found = slices.scores(slices.chosen(queries, None), exclude)
    else:
        first = settle(slices.scores(slices.chosen(queries, None), exclude))
        second = slices.chosen(queries, settle(_floors(first, n)))
        found = first.unionByName(slices.scores(second, exclude))
    best = top_per_key(found, ["qid"], [from_best(F.col("score")), F.col("item")], n)
    if strict_n:
        best = best.join(best.filter(F.col("rank") == n).select("qid"), "qid", "left_semi")
    return best


def pairs_scored(queries: DataFrame, items: DataFrame, n: int = fixed.NEIGHBORS) -> tuple[int, int]:
    """(pairs of query and item that ``nearest_neighbors`` scores, all pairs): how much the bounds save."""
    queries, items = _prepared(queries, items)
    slices = _Slices(items, n)
    first = slices.chosen(queries, None)
    looks = first
    if len(slices.bin_items) > 1:
        looks = first.unionByName(slices.chosen(queries, settle(_floors(slices.scores(first, None), n))))
    looks = looks.select(F.explode("slices").alias("slice"))
    sizes = slices.items.groupBy("slice").agg(F.count(F.lit(1)).alias("items"))
    scored = looks.groupBy("slice").agg(F.count(F.lit(1)).alias("looks")).join(sizes, "slice").agg(F.sum(F.col("looks") * F.col("items"))).first()[0]
    return scored or 0, queries.count() * items.count()
