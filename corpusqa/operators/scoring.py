"""Scores of documents for a set of queries that fits a task: Spark deals out the documents, numpy sums.

A document comes as one row with all its fields. ``coded`` keeps the wanted terms of each as numbers; ``best_scores``
adds up the weights of all queries document by document, and a task hands on only what can be
among the n best that it has seen for a query; of ties in a batch those with the first keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.session import settle

WEIGHT_BYTES = 64 * 1024 * 1024  # weights of all terms and queries as one matrix
BLOCK_BYTES = 32 * 1024 * 1024  # products held at once
PART_ROWS = 1 << 17  # documents of one task, as far as they are coded
SLACK = 2e-6  # scores are compared when rounded to six places


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(elements, the row of each) of a column of lists; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _lists(rows: np.ndarray, count: int, *values: np.ndarray) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in values]


def _code(batches: Iterator[pa.RecordBatch], terms: dict[str, pa.Array], first: dict[str, int], every: int) -> Iterator[pa.RecordBatch]:
    """(keys, ids, tfs, lengths): the wanted terms of each document, each once a field."""
    for batch in batches:
        fields, row = _flat(batch.column(batch.num_columns - 1))
        name, length = fields.field("field"), fields.field("length").to_numpy(zero_copy_only=False)
        words, at = _flat(fields.field("terms"))
        tf = _flat(fields.field("tf"))[0].to_numpy(zero_copy_only=False)
        ids = np.full(len(words), -1, np.int64)
        for field, known in terms.items():
            of_field = pc.fill_null(pc.equal(name, field), False).to_numpy(zero_copy_only=False)
            here = np.flatnonzero(of_field[at]) if len(at) else at
            place = pc.index_in(words.take(pa.array(here)) if len(here) < len(words) else words, value_set=known)
            spot = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids[here] = np.where(spot >= 0, spot + first[field], -1)
        some = np.flatnonzero(ids >= 0)
        # the fields of a document lie together: the same term of the same field is counted
        code, back = np.unique(at[some] * every + ids[some], return_inverse=True)
        entry, term = code // every, code % every
        count = np.ones(len(some)) if not len(tf) else tf[some]
        columns = _lists(row[entry], batch.num_rows, term, np.bincount(back, weights=count, minlength=len(code)), length[entry])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "ids", "tfs", "lengths"])


def _types(rows: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def fits(grouped: DataFrame, qid: str, n: int) -> bool:
    """Are the weights of the clauses ``grouped`` (qid, field, term), and the n best of each query, small as matrices?"""
    terms = grouped.select("field", "term").distinct().count()
    queries = grouped.select(qid).distinct().count()
    return queries * max(terms, n) * 8 <= WEIGHT_BYTES


def coded(rows: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """(keys, ids, tfs, lengths): of the documents ``rows`` (keys, fields) the ``wanted`` (field, term) by their
    number. Rows with the same keys are one document.

    ``fields`` holds (field, length, terms, tf) for each field; without ``tf`` each term counts once where it stands.
    """
    by_field: dict[str, list[str]] = {}
    for field, term in wanted:
        by_field.setdefault(field, []).append(term)
    first = dict(zip(by_field, np.cumsum([0, *map(len, by_field.values())]).tolist(), strict=False))
    terms = {f: pa.array(t) for f, t in by_field.items()}
    code = partial(_code, terms=terms, first=first, every=max(1, len(wanted)))
    return settle(rows.select(*keys, "fields").mapInArrow(code, f"{_types(rows, keys)}, ids array<int>, tfs array<int>, lengths array<int>"))


def spread(rows: DataFrame, count: int) -> DataFrame:
    """``coded`` rows over more partitions, where theirs hold too many: small files are read as few, however many rows they have."""
    if count <= PART_ROWS * rows.rdd.getNumPartitions():
        return rows
    return settle(rows.repartition(math.ceil(count / PART_ROWS)))


def merged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``coded`` rows, one for each document."""
    if rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").isEmpty():
        return rows
    return rows.groupBy(*keys).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "tfs", "lengths")])


def _impact(scoring: str, tf: np.ndarray, length: np.ndarray, mean: np.ndarray) -> np.ndarray:
    if scoring == "classic":
        return np.sqrt(tf / length)
    k1, b = 1.2, 0.75
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))


def _order(keys: Sequence[pa.Array]) -> np.ndarray | None:
    """The place of each row by its keys, as Spark orders them; None for keys that Arrow orders in another way."""
    kinds = [k.type for k in keys]
    if not all(pa.types.is_string(t) or pa.types.is_integer(t) for t in kinds):
        return None
    names = [str(i) for i in range(len(keys))]
    by = pc.sort_indices(pa.Table.from_arrays(list(keys), names=names), sort_keys=[(c, "ascending") for c in names], null_placement="at_start").to_numpy()
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by))
    return out


def _ahead(q: np.ndarray, scores: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Which (query, score, place) can be among the ``n`` best of their query, by rounded score and place.

    A score so close to the middle of two rounded ones that only Spark's decimals tell stays if either would do.
    """
    least, most = np.floor(scores * 1e6 + 0.5 - 1e-3), np.floor(scores * 1e6 + 0.5 + 1e-3)
    by = np.lexsort((place, -least, q))
    own = q[by]
    spot = np.arange(len(own)) - np.searchsorted(own, own)
    keep = np.zeros(len(q), bool)
    keep[by[spot < n]] = True
    edge = np.full(int(q.max()) + 1, -np.inf)
    edge[own[spot == n - 1]] = least[by[spot == n - 1]]
    return keep | ((most > least) & (most >= edge[q]))


def _score(batches: Iterator[pa.RecordBatch], qids: pa.Array, name: str, weights: np.ndarray, clauses: np.ndarray, means: np.ndarray, n: int, scoring: str) -> Iterator[pa.RecordBatch]:
    top = np.full((len(qids), n), -np.inf)  # the best scores so far
    many = max(1, BLOCK_BYTES // (8 * max(1, len(qids))))
    for batch in batches:
        ids, row = _flat(batch.column("ids"))
        ids = ids.to_numpy(zero_copy_only=False)
        tf, length = (_flat(batch.column(c))[0].to_numpy(zero_copy_only=False).astype(float) for c in ("tfs", "lengths"))
        place: np.ndarray | None = None
        worth = _impact(scoring, tf, length, means[ids])
        docs, heads = np.unique(row, return_index=True)
        ends = np.append(heads[1:], len(row))
        a = 0
        while a < len(docs):  # whole documents, as many as the block holds
            b = max(a + 1, int(np.searchsorted(ends, heads[a] + many, side="right")))
            part = slice(int(heads[a]), int(ends[b - 1]))
            if part.stop - part.start > many:  # one long document
                scores = worth[None, part] @ weights[ids[part]]
                matched = np.zeros((1, len(qids)))
                for k in range(part.start, part.stop, many):
                    matched += clauses[ids[k : min(k + many, part.stop)]].sum(axis=0)
            else:
                scores = np.add.reduceat(weights[ids[part]] * worth[part, None], heads[a:b] - heads[a], axis=0)
                matched = np.add.reduceat(clauses[ids[part]], heads[a:b] - heads[a], axis=0)
            if scoring == "classic":
                scores = scores * matched
            scores = np.where(matched > 0, scores, -np.inf)
            top = -np.partition(-np.concatenate([top, scores.T], axis=1), n - 1, axis=1)[:, :n]
            d, q = np.nonzero((scores >= top.min(axis=1) - SLACK) & (matched > 0))
            if len(d) > n:  # of equal scores those with the first keys
                place = _order(batch.columns[:-3]) if place is None else place
                if place is not None:
                    ahead = _ahead(q, scores[d, q], place[docs[a:b][d]], n)
                    d, q = d[ahead], q[ahead]
            if len(d):
                at = pa.array(docs[a:b][d])
                keys = [c.take(at) for c in batch.columns[:-3]]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), *keys, pa.array(scores[d, q])], names=[name, *batch.schema.names[:-3], "score"])
            a = b


def best_scores(rows: DataFrame, keys: Sequence[str], weights: DataFrame, wanted: Sequence[tuple[str, str]], qid: str, n: int, scoring: str, lengths: DataFrame | None) -> DataFrame:
    """(qid, keys, score) of ``merged`` rows: the n best of each query are among them.

    ``weights`` (qid, field, term, _m, _w) have been measured.
    """
    number = {w: k for k, w in enumerate(wanted)}
    table = weights.select(qid, "field", "term", F.col("_m").cast("double").alias("_m"), "_w").toArrow()
    encoded = table[qid].combine_chunks().dictionary_encode(null_encoding="encode")
    term = np.array([number[w] for w in zip(table["field"].to_pylist(), table["term"].to_pylist(), strict=True)], np.int64)
    w, m = (np.zeros((len(wanted), len(encoded.dictionary))) for _ in range(2))
    at = (term, encoded.indices.to_numpy())
    w[at], m[at] = table["_w"].to_numpy(), table["_m"].to_numpy()
    mean = {} if lengths is None else {r["field"]: r["_mean"] for r in lengths.collect()}  # a row for each field
    means = np.array([mean.get(f, np.nan) for f, _ in wanted])
    kind = weights.schema[qid].dataType.simpleString()
    score = partial(_score, qids=encoded.dictionary, name=qid, weights=w, clauses=m, means=means, n=n, scoring=scoring)
    return rows.mapInArrow(score, f"`{qid}` {kind}, {_types(rows, keys)}, score double")
