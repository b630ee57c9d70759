"""Packing documents into fixed-size sequences by minimum bin slack.

Every document is cut into whole sequences and one remainder shorter than a sequence. Only the
number of remainders of each length matters for packing them, at most ``size - 1`` numbers
however many documents there are. A bitset subset-sum program picks, for the longest length
left, the multiset of lengths that fills a sequence closest to its capacity; the counts are
found by going back through the bitsets, and the pattern is used as often as the lengths last.
Pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb
from corpusqa.llm.encoding import PIECE_BYTES, kept_encoder
from corpusqa.session import new_folder

SIZE = 2048
END_ID = 1


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending), each at most ``counts`` times, closest to ``capacity``."""
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for n in lengths:
        if reached & full:
            break
        if n > capacity:
            continue
        left = min(counts[n], capacity // n)
        if not left:
            continue
        steps.append((n, reached, left))
        take = 1
        while left:  # 1, 2, 4, ... copies and the rest reach every number of copies
            take = min(take, left)
            reached |= (reached << (n * take)) & mask
            left -= take
            take *= 2
    total, out = reached.bit_length() - 1, {}
    for n, before, most in reversed(steps):
        for k in range(min(most, total // n) + 1):
            if before >> (total - k * n) & 1:
                if k:
                    out[n] = k
                total -= k * n
                break
    return out


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)]: patterns of lengths that use up ``histogram`` (length to count)."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        pattern = best_fill(lengths, counts, size - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * times
        out.append((pattern, times))
        lengths = [n for n in lengths if counts[n]]
    return out


_PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def _cut(batches: Iterator[pa.RecordBatch], content, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    encoder = kept_encoder(content.value)
    part = TaskContext.get().partitionId()
    used = np.zeros(size + 1, np.int64)  # pieces of each length so far in this task
    for batch in batches:
        data, offsets = tb.flat(batch.column(1))
        for lo, hi in tb.spans(offsets, PIECE_BYTES):
            ids, counts = encoder.rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // size)
            row = np.repeat(np.arange(hi - lo), pieces)
            start = tb.ragged(np.zeros(hi - lo, np.int64), pieces) * size
            length = np.minimum(counts[row] - start, size)
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            heads = np.searchsorted(ranked, ranked)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - heads + used[ranked]
            used += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(counts[row]), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
            )


def _places(patterns: list[tuple[dict[int, int], int]], first: int) -> dict[str, np.ndarray]:
    # for each length, ranges of ranks: (length, first rank, copies, first sequence, offset)
    rows, ranks = [], {}
    for pattern, times in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            rows.append((n, ranks.get(n, 0), pattern[n], first, offset))
            ranks[n] = ranks.get(n, 0) + pattern[n] * times
            offset += n * pattern[n]
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 44 | table[:, 1], "low": table[:, 1], "copies": table[:, 2], "first": table[:, 3], "offset": table[:, 4]}


@tb.tidy
def _place(batches: Iterator[pa.RecordBatch], places, size: int) -> Iterator[pa.RecordBatch]:
    p = places.value
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "rank"))
        sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)  # a whole sequence is its own
        part = np.flatnonzero(length < size)
        if len(part):
            e = np.searchsorted(p["key"], length[part] << 44 | rank[part], side="right") - 1
            local = rank[part] - p["low"][e]
            sequence[part] = p["first"][e] + local // p["copies"][e]
            offset[part] = p["offset"][e] + local % p["copies"][e] * length[part]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def pack_sequences(docs: DataFrame, content: bytes, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    ``docs`` has doc_id and text; ``content`` is the JSON file of a tokenizer. A null or empty
    text is one piece with the end id. Null and repeated ids keep their rows; other columns are
    ignored; an empty table gives an empty result. Sequence ids run from 0 without gaps.
    """
    spark = docs.sparkSession
    tb.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(content)
    path = new_folder(spark, "pieces")
    # stored, so that the numbers of a task's pieces are given once
    texts.mapInArrow(partial(_cut, content=sent, end_id=end_id, size=size), _PIECE).write.parquet(path)
    pieces = spark.read.schema(_PIECE).parquet(path)
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    whole = histogram.pop(size, 0)
    places = spark.sparkContext.broadcast(_places(plan(histogram, size), whole))
    ranked = pieces.join(shifts, ["part", "length"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("nth") + F.col("shift")).alias("rank")
    )
    return ranked.mapInArrow(
        partial(_place, places=places, size=size),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
