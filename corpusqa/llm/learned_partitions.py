"""Approximate nearest neighbours by learned partitions, for the largest inner product.

1. The neighbour graph of a bounded sample is cut into balanced parts: parts start as slices
   along principal directions and nodes then move to the part of most of their neighbours, as
   far as the parts' capacity allows.
2. A small classifier (one hidden layer, trained here) learns the parts in a node's
   neighbourhood from its vector.
3. Every row is put in its most probable part. A query goes to its most probable parts; how
   many is the least number that finds ``recall`` of the true neighbours among sample rows that
   nothing was learned from, and more where those parts hold too few candidates.
4. Candidates of those parts are scored exactly, in double precision, on the original vectors.

Parts are split into blocks of bounded size, so a part that holds most rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.grid_order_join import matrix, valid_vectors
from corpusqa.operators.joins import top_per_key
from corpusqa.session import new_folder

NEAREST = 20
SAMPLE = 8192  # vectors that the partitions are learned from
GRAPH_DEGREE = 12
HIDDEN = 128
EPOCHS = 24
HELD_OUT = 4  # one in so many sample rows is not learned from
RECALL = 0.95  # aimed at on the held-out rows
BLOCK = 16_384  # rows of a part that one task scores
QUERY_BLOCK = 4096  # queries that one task scores them for


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each node: close to equal sizes, few neighbours in other parts."""
    n = len(x)
    part = np.zeros(n, np.int64)
    # slices of equal size along the widest direction of each piece, halved again and again
    pieces = [(np.arange(n), 0, parts)]
    while pieces:
        rows, first, k = pieces.pop()
        if k == 1 or len(rows) < 2:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        order = rows[np.argsort(centred @ axes[:, -1], kind="stable")]
        cut = len(rows) * (k // 2) // k
        pieces += [(order[:cut], first, k // 2), (order[cut:], first + k // 2, k - k // 2)]
    room = int(np.ceil(slack * n / parts))
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        for j in range(neighbours.shape[1]):
            np.add.at(votes, (np.arange(n), part[neighbours[:, j]]), 1)
            np.add.at(votes, (neighbours[:, j], part), 1)  # an edge counts at both ends
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in sorted(rng.permutation(np.flatnonzero(gain > 0)).tolist(), key=lambda i: -gain[i]):
            to = best[i]
            if sizes[to] < room and sizes[part[i]] > n // (2 * parts):
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Scores of parts for a vector: a network with one hidden layer."""

    def __init__(self, dims: int, parts: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = np.zeros(dims), np.ones(dims)
        self.w = [rng.normal(0, np.sqrt(2 / dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, ((x - self.shift) / self.scale) @ self.w[0] + self.w[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, batch: int = 256) -> Router:
        """``target``: the share of each part in a node's neighbourhood. Adam on cross entropy."""
        self.shift, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        rng = np.random.default_rng(2)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                z = (x[rows] - self.shift) / self.scale
                h = np.maximum(0, z @ self.w[0] + self.w[1])
                out = h @ self.w[2] + self.w[3]
                p = np.exp(out - out.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - target[rows]) / len(rows)
                dh = (d @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((z.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


@dataclass
class Index:
    router: Router
    parts: int
    probes: int
    sample_recall: float


def _nearest_rows(x: np.ndarray, k: int) -> np.ndarray:
    # k largest inner products of each row with the others
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def learn(sample: np.ndarray, rows: int, nearest: int = NEAREST, recall: float = RECALL) -> Index:
    """Partitions and their router from ``sample``; ``rows`` is the size of the whole table."""
    order = np.random.default_rng(3).permutation(len(sample))
    held, sample = sample[np.sort(order[: len(sample) // HELD_OUT])], sample[np.sort(order[len(sample) // HELD_OUT :])]
    n = len(sample)
    parts = max(1, min(max(8, int(np.sqrt(rows) / 16)), n // 64))
    if parts == 1:
        return Index(Router(sample.shape[1], 1), 1, 1, 1.0)
    largest = np.abs(sample).max()
    x = sample / largest  # products stay finite
    graph = _nearest_rows(x, min(GRAPH_DEGREE, n - 1))
    part = balanced_parts(x, graph, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.arange(n), part), 1.0)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(n), part[graph[:, j]]), 1.0 / graph.shape[1])
    router = Router(x.shape[1], parts)
    router.fit(sample, target / target.sum(1, keepdims=True))
    # how many parts must be looked into: true neighbours among rows the router has not seen, as most of the table
    tests = np.arange(min(len(held), 1024))
    truth = _nearest_rows(held / np.abs(held).max(), min(nearest, len(held) - 1))[tests]
    scores = router.logits(held)
    home = scores.argmax(1)
    rank = np.empty((len(tests), parts), np.int64)
    np.put_along_axis(rank, np.argsort(-scores[tests], axis=1), np.arange(parts)[None, :], axis=1)
    at = np.take_along_axis(rank, home[truth], axis=1)
    found = np.array([(at < p).mean() for p in range(1, parts + 1)])
    probes = int(np.argmax(found >= recall)) + 1 if (found >= recall).any() else parts
    return Index(router, parts, probes, float(found[probes - 1]))


def _assign(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    router = index.value.router
    for batch in batches:
        if batch.num_rows:
            home = router.logits(matrix(batch.column(1))).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home.astype(np.int32))], names=["vec_id", "v", "part"])


def _route(batches: Iterator[pa.RecordBatch], index, ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """``ids``: different ids in each part. Further parts are asked until there are ``k`` besides the query's own."""
    i: Index = index.value
    for batch in batches:
        if batch.num_rows:
            best = np.argsort(-i.router.logits(matrix(batch.column(1))), axis=1, kind="stable").astype(np.int32)
            enough = 1 + (np.cumsum(ids[best], axis=1) <= k).sum(1)
            parts = [row[: max(i.probes, n)] for row, n in zip(best, enough.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int32()))], names=["query_id", "q", "parts"])


def best_of(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of ``x`` for each query, its own id left out; ties to smaller ids."""
    out = []
    for a in range(0, len(queries), 256):
        scores = queries[a : a + 256] @ x.T
        scores[own[a : a + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        else:
            edge = np.full(len(scores), -np.inf)
        q, c = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        s = scores[q, c]
        order = np.lexsort((ids[c], -s, q))
        q, c, s = q[order], c[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((own[a + q[keep]], ids[c[keep]], s[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _score(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    if not queries.num_rows or not rows.num_rows:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    else:
        found = best_of(matrix(queries["q"]), queries["query_id"].to_numpy(), rows["vec_id"].to_numpy(), matrix(rows["v"]), k)
    return pa.Table.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])


def build_index(vectors: DataFrame, nearest: int = NEAREST, recall: float = RECALL, sample: int = SAMPLE) -> Index:
    """Learn from the ``sample`` valid vectors whose hashed ids come first."""
    rows = vectors.count()
    first = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not rows:
        return Index(Router(1, 1), 1, 1, 1.0)
    order = np.argsort(first["vec_id"].to_numpy(), kind="stable")
    return learn(matrix(first["v"])[order], rows, nearest, recall)


def nearest_neighbours(vectors: DataFrame, query_filter, k: int = NEAREST, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that meets ``query_filter``.

    ``vectors`` has vec_id and embedding; every row but the query's own is a candidate. Vectors that
    are null, zero or hold null or non-finite components and rows without an id take no part.
    Vectors of different lengths are compared with those of their own length only. A query that
    is repeated is answered once. Ties go to the smaller id. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors).withColumn("n", F.size("v"))
    lengths = sorted(r["n"] for r in valid.select("n").distinct().collect())  # a few lengths
    found = None
    for n in lengths:
        part = _search(spark, valid.filter(F.col("n") == n).select("vec_id", "v"), query_filter, k, recall, sample)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = top_per_key(best, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(spark, valid: DataFrame, query_filter, k: int, recall: float, sample: int) -> DataFrame:
    index = spark.sparkContext.broadcast(build_index(valid, k, recall, sample))
    path = new_folder(spark, "learned-partitions")
    valid.mapInArrow(partial(_assign, index=index), "vec_id long, v array<double>, part int").write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = F.broadcast(stored.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")))  # a row for each part
    rows = stored.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    queries = valid.filter(query_filter).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    count = queries.count()
    turns = max(1, -(-count // QUERY_BLOCK))
    ids = np.zeros(index.value.parts, np.int64)
    # an id with rows in several parts counts in one of them
    for r in stored.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("ids")).collect():
        ids[r["part"]] = r["ids"]
    routed = queries.mapInArrow(partial(_route, index=index, ids=ids, k=k), "query_id long, q array<double>, parts array<int>")
    # queries of a part in turns, so that no task holds them all
    turn = F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(turns)).cast("int")
    asked = (
        routed.select("query_id", "q", F.explode("parts").alias("part")).join(sizes, "part")
        .select("query_id", "q", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), turn.alias("turn"))
    )
    spread = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))) if turns > 1 else rows.withColumn("turn", F.lit(0))
    spread = spread.select("vec_id", "v", "part", "block", "turn")
    keys = ("part", "block", "turn")
    return asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(lambda a, b: _score(a, b, k), "query_id long, vec_id long, score double")
