"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words of one document. Its minimiser is the smallest of its
``gram``-word hashes, so equal windows have equal minimisers. Consecutive windows with one
minimiser travel as one packed string to the minimiser's bucket, where sorting the window
hashes counts every window exactly. All windows are judged on the input. Answers go back to the
chunk of documents they are about, to which a second scan sends the texts.

Hot passages: a chunk of documents counts its own windows first and sends each different one
once. Grams that are frequent in the corpus are ordered last, so that windows around a
frequent passage go to buckets of their rare words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb

WINDOW = 35
GRAM = 4
CHUNK_BYTES = 2 << 20  # text of one chunk
BUCKET_BYTES = 3 << 20  # input text for each bucket; about three times that arrives
# Grams that a chunk holds so often are reported; the HOT_GRAMS most frequent of them are
# ordered last. That is only the order of the minimisers: any order gives the same result.
HOT_IN_CHUNK = 16
HOT_GRAMS = 1 << 16


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(number, other columns, bytes, offsets) of runs of documents of about CHUNK_BYTES."""
    tb.make_room()
    task = TaskContext.get().partitionId() << 24
    held, size, number = [], 0, 0

    def join() -> tuple:
        lengths = np.concatenate([np.diff(h[2]) for h in held])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return task + number, pa.Table.from_batches([h[0] for h in held]), np.concatenate([h[1] for h in held]), offsets

    for batch in batches:
        data, offsets = tb.flat(batch.column(0))
        rest = batch.select(range(1, batch.num_columns))
        lo = 0
        while lo < len(offsets) - 1:
            # a chunk ends at the row that fills it, wherever batches end
            hi = min(len(offsets) - 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES - size)))
            held.append((rest.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]].copy(), offsets[lo : hi + 1] - offsets[lo]))
            size += int(offsets[hi] - offsets[lo])
            lo = hi
            if size >= CHUNK_BYTES:
                yield join()
                held, size, number = [], 0, number + 1
                tb.trim()
    if held:
        yield join()


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = tb.word_bounds(data, offsets)
    return starts, ends, first, tb.word_hashes(data, starts, ends)


def _checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A second hash of every window, of other word hashes: windows are equal where both are."""
    return tb.windows(tb.word_hashes(data, starts, ends, tb.SECOND), first, size)[0]


def _ranked(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): an order in which equal windows lie together, and whether each is the one before it."""
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    same = equal & (checks[order][1:] == checks[order][:-1])
    if not np.array_equal(equal, same):  # different windows with one first hash
        order = np.lexsort((checks, hashes))
        same = (hashes[order][1:] == hashes[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    return order, np.concatenate([[False], same]) if len(hashes) else np.zeros(0, bool)


@tb.tidy
def _hot(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    for _, _, data, offsets in _chunks(batches):
        _, _, first, codes = _codes(data, offsets)
        grams = np.sort(tb.windows(codes, first, gram)[0])
        heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([heads, [len(grams)]]))
        keep = counts >= HOT_IN_CHUNK
        yield pa.RecordBatch.from_arrays([pa.array(grams[heads][keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["gram", "n"])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    out, span = values, 1
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


@tb.tidy
def _send(batches: Iterator[pa.RecordBatch], buckets: int, hot, size: int, gram: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    last = hot.value
    for number, _, data, offsets in _chunks(batches):
        starts, ends, first, codes = _codes(data, offsets)
        hashes, counts = tb.windows(codes, first, size)
        doc = np.repeat(np.arange(len(counts)), counts)
        word = tb.ragged(first[:-1], counts)  # first word of each window
        order, same = _ranked(hashes, _checks(data, starts, ends, first, size))
        heads = np.flatnonzero(~same)
        repeats = np.diff(np.concatenate([heads, [len(hashes)]]))
        marked = np.zeros(len(hashes), bool)
        marked[order] = np.repeat(repeats > 1, repeats)
        sent = np.sort(order[heads])
        del hashes, order, same
        # what the chunk knows by itself: its repeated windows
        out = [(int(number % buckets), 0, _mark(data) + len(marked).to_bytes(8, "little") + np.packbits(marked).tobytes())]
        if len(sent):
            grams = tb.windows(codes, np.array([0, len(codes)]), gram)[0]  # those across documents are in no window
            if len(last):
                hot_ones = last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams
                grams = (grams >> np.uint64(1)) | (hot_ones.astype(np.uint64) << np.uint64(63))
            else:
                grams = grams >> np.uint64(1)
            least = _sliding_min(grams, size - gram + 1)[word[sent]]
            begin = np.flatnonzero(np.concatenate([[True], (sent[1:] != sent[:-1] + 1) | (doc[sent][1:] != doc[sent][:-1]) | (least[1:] != least[:-1])]))
            stop = np.concatenate([begin[1:], [len(sent)]]) - 1
            left, right = starts[word[sent[begin]]], ends[word[sent[stop]] + size - 1]
            bucket = (tb.mix(least[begin]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1)) if buckets <= len(by) else None
            here = range(buckets) if cuts is not None else np.unique(bucket).tolist()
            view = memoryview(data)
            for b in here:
                a, z = (cuts[b], cuts[b + 1]) if cuts is not None else np.searchsorted(bucket[by], [b, b + 1])
                if a == z:
                    continue
                runs = by[a:z]
                l, r = left[runs], right[runs]
                text = b"".join([view[i:j] for i, j in zip(l.tolist(), r.tolist(), strict=True)])
                raw = b"".join([len(runs).to_bytes(8, "little"), sent[begin[runs]].astype(np.uint32).tobytes(), (r - l).astype(np.uint32).tobytes(), text])
                out.append((int(b), 1, pack.compress(raw)))
        for at in range(0, len(out), 64):
            part = out[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in part], pa.int32()), pa.array([number] * len(part), pa.int64()), pa.array([o[1] for o in part], pa.int32()), pa.array([o[2] for o in part], pa.binary())],
                names=["bucket", "chunk", "kind", "data"],
            )


def _mark(data: np.ndarray) -> bytes:
    # tells whether two scans met the same chunk
    return zlib.crc32(data).to_bytes(4, "little")


@tb.tidy
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks themselves: texts and other columns, packed."""
    pack = zstandard.ZstdCompressor(level=3)
    for number, rest, data, offsets in _chunks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as writer:
            writer.write_table(rest)
        other = sink.getvalue()
        head = np.array([len(offsets) - 1, other.size], np.int64)
        raw = _mark(data) + pack.compress(b"".join([head.tobytes(), np.diff(offsets).astype(np.int64).tobytes(), other, data.tobytes()]))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([raw], pa.binary())], names=["chunk", "data"])


@tb.tidy_table
def _answer(table: pa.Table, size: int) -> pa.Table:
    """For one bucket: the windows that occur twice or more, as ranges of window numbers."""
    tb.make_room()
    unpack = zstandard.ZstdDecompressor()
    out, sent = [], []
    for chunk, kind, raw in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        if kind == 0:
            out.append((chunk, 0, raw))
            continue
        raw = unpack.decompress(raw)
        n = int.from_bytes(raw[:8], "little")
        sent.append((chunk, np.frombuffer(raw, np.uint32, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 4 * n), np.frombuffer(raw, np.uint8, -1, 8 + 8 * n)))
    if sent:
        lengths = np.concatenate([s[2] for s in sent]).astype(np.int64)
        data = np.concatenate([s[3] for s in sent])
        origin = np.concatenate([s[1] for s in sent]).astype(np.int64)
        runs = np.cumsum([len(s[1]) for s in sent])
        hashes, checks, windows, owner = [], [], [], []
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        for lo, hi in tb.spans(offsets, 1 << 20):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, first, codes = _codes(part, offsets[lo : hi + 1] - offsets[lo])
            h, c = tb.windows(codes, first, size)
            hashes.append(h)
            checks.append(_checks(part, starts, ends, first, size))
            windows.append(tb.ragged(origin[lo:hi], c).astype(np.uint32))
            owner.append(np.repeat(np.searchsorted(runs, np.arange(lo, hi), side="right").astype(np.int32), c))
        windows, owner = np.concatenate(windows), np.concatenate(owner)
        order, same = _ranked(np.concatenate(hashes), np.concatenate(checks))
        twice = same.copy()
        twice[:-1] |= same[1:]
        del hashes, checks, same
        found = np.sort(order[twice])
        windows, owner = windows[found], owner[found]
        cuts = np.searchsorted(owner, np.arange(len(sent) + 1))
        for k, s in enumerate(sent):
            mine = np.sort(windows[cuts[k] : cuts[k + 1]])
            if len(mine):
                mine = mine.astype(np.int64)
                begin = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1] + 1]))
                stop = np.concatenate([begin[1:], [len(mine)]]) - 1
                out.append((s[0], 1, np.stack([mine[begin], mine[stop] + 1]).astype(np.uint32).tobytes()))
    return pa.Table.from_arrays(
        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
        names=["chunk", "kind", "data"],
    )


@tb.tidy_table
def _remove(table: pa.Table, texts: pa.Table, size: int, leave_clean: bool) -> pa.Table:
    """For one chunk: its documents without the words of repeated windows."""
    tb.make_room()
    kinds, blobs = table["kind"].to_pylist(), table["data"].to_pylist()
    own = [b for k, b in zip(kinds, blobs, strict=True) if k == 0]
    if len(own) != 1 or texts.num_rows != 1 or own[0][:4] != texts["data"][0].as_py()[:4]:
        raise RuntimeError("the documents came in another order when they were read again: hand over a stored table")
    total = int.from_bytes(own[0][4:12], "little")
    marked = np.unpackbits(np.frombuffer(own[0], np.uint8, -1, 12), count=total).astype(bool)
    raw = zstandard.ZstdDecompressor().decompress(memoryview(texts["data"][0].as_py())[4:])
    n, other = np.frombuffer(raw, np.int64, 2).tolist()
    lengths = np.frombuffer(raw, np.int64, n, 16)
    rest = pa.ipc.open_stream(pa.py_buffer(raw).slice(16 + 8 * n, other)).read_all()
    data = np.frombuffer(raw, np.uint8, -1, 16 + 8 * n + other)
    change = np.zeros(total + 1, np.int32)
    for k, b in zip(kinds, blobs, strict=True):
        if k == 1:
            begin, stop = np.frombuffer(b, np.uint32).reshape(2, -1)
            np.add.at(change, begin, 1)
            np.add.at(change, stop, -1)
    marked |= np.cumsum(change[:-1]) > 0
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    before = 0  # windows of the documents before
    for lo, hi in tb.spans(offsets, 2 << 20):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = tb.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
        words = np.diff(first)
        counts = np.maximum(words - size + 1, 0)
        mine = tb.ragged(first[:-1], counts)[marked[before : before + int(counts.sum())]]
        before += int(counts.sum())
        cover = np.zeros(len(starts) + size + 1, np.int32)
        np.add.at(cover, mine, 1)
        np.add.at(cover, mine + size, -1)
        stay = np.cumsum(cover[: len(starts)]) == 0
        n_words[lo:hi] = words
        running = np.concatenate([[0], np.cumsum(stay)])
        n_kept = running[first[1:]] - running[first[:-1]]
        n_removed[lo:hi] = words - n_kept
        s, width = starts[stay], ends[stay] - starts[stay] + 1  # a word and the space behind it
        text = np.append(part, np.uint8(0x20))[tb.ragged(s, width)]
        tail = np.cumsum(width)
        text[tail - 1] = 0x20
        sizes = np.concatenate([[0], tail])[np.concatenate([[0], np.cumsum(n_kept)])]
        view, whole = memoryview(text), memoryview(part)
        rows = [bytes(view[a : max(a, z - 1)]) for a, z in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
        if leave_clean:
            own = (offsets[lo : hi + 1] - offsets[lo]).tolist()
            rows = [r if gone else bytes(whole[a:z]) for r, gone, a, z in zip(rows, (words > n_kept).tolist(), own[:-1], own[1:], strict=True)]
        kept += rows
    new = [pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.Table.from_arrays([*rest.columns, *new], names=[*rest.schema.names, "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = (), leave_clean: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, and the columns ``keep``) for every row of ``docs`` (doc_id, text).

    Every word is removed that a window covers whose words also start anywhere else, in the same
    document included; ``kept_text`` joins the others by one space; with ``leave_clean`` a text
    that loses no word stays as it is. A null text has no words;
    a text of fewer than ``size`` words stays. Null and repeated ids keep their rows, as no step
    uses the id. Other columns are ignored; an empty table gives an empty result.
    A task that is run again must meet its rows in the same order: hand over a stored table.
    """
    spark = docs.sparkSession
    tb.small_batches(spark)
    text = F.col("text").cast("string").alias("text")
    rest = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]]
    rows = docs.select(text, *rest)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    seen = rows.select("text").mapInArrow(partial(_hot, gram=gram), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.col("n").desc(), "gram").limit(HOT_GRAMS).select("gram").toArrow()["gram"].to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(top.astype(np.int64).view(np.uint64)))
    # both read the same columns: rows then come in the same order even behind a shuffle
    sent = rows.mapInArrow(partial(_send, buckets=buckets, hot=hot, size=size, gram=gram), "bucket int, chunk long, kind int, data binary")
    answers = sent.groupBy("bucket").applyInArrow(lambda t: _answer(t, size), "chunk long, kind int, data binary")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    packed = rows.mapInArrow(_texts, "chunk long, data binary")
    out = answers.groupBy("chunk").cogroup(packed.groupBy("chunk")).applyInArrow(lambda t, x: _remove(t, x, size, leave_clean), f"{kinds}, n_words long, n_removed long, kept_text string")
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
