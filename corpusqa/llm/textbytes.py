"""Texts of an Arrow batch as one flat byte array: words, word hashes and hash arithmetic in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

# Words are runs of bytes other than these (fixed by the contract of the operators).
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_SEGMENT = 1 << 19  # bytes hashed at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


# What workers keep beyond a task is emptied by these.
CACHES: list[Callable[[], None]] = []


def trim() -> None:
    """Give freed memory back to the system, where the allocator can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def make_room() -> None:
    """Free what earlier tasks of this worker keep. Python workers outlive tasks and queries."""
    for clear in CACHES:
        clear()
    trim()


def tidy(step: Callable) -> Callable:
    """A stage function over batches that leaves nothing behind in its worker when its task ends."""
    @functools.wraps(step)
    def run(*args, **kwargs):
        try:
            yield from step(*args, **kwargs)
        finally:
            make_room()

    return run


def tidy_table(step: Callable) -> Callable:
    """The same for a function from tables to a table."""
    @functools.wraps(step)
    def run(*args, **kwargs):
        try:
            return step(*args, **kwargs)
        finally:
            make_room()

    return run


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_BYTES (or one row): a session setting.

    Spark's own bound allows 64 MB, of which a task holds several copies.
    """
    if int(str(spark.conf.get(_BATCH, "67108864b")).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.large_binary()
    column = pc.fill_null(column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) else column.cast(wide), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges (first, last) of rows with at most ``limit`` bytes together; a longer row is alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[0x41:0x5B] = BYTE_CODES[0x61:0x7B]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    # powers of an odd number and of its inverse modulo 2**64
    if len(_POWERS[0]) < n:
        base = int(_ODD)
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            step = np.full(n, b, np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """64-bit feature of each run ``data[start:end]``; runs are disjoint and ascending.

    Some long runs of few letters have equal features, so they decide no equality: ``word_hashes`` do.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, side="right")))
        base = int(starts[at])
        size = int(ends[to - 1]) - base
        up, down = _powers(max(size, _SEGMENT) + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    if len(_POWERS[0]) > 8 * _SEGMENT:  # a very long run does not keep its memory
        _POWERS[:] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
    return out


_PLACES = 64


def _constants(seed: int) -> np.ndarray:
    # a number for each place and byte, as good as drawn at random
    return mix((np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(seed)) * _ODD)


# Two independent families of word hashes; both together tell texts apart by 128 bits.
FIRST, SECOND = _constants(1), _constants(1 << 32)
LOWER = FIRST.reshape(_PLACES, 256).copy()
LOWER[:, 0x41:0x5B] = LOWER[:, 0x61:0x7B]
LOWER = LOWER.reshape(-1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, constants: np.ndarray = FIRST) -> np.ndarray:
    """64-bit hash of each run ``data[start:end]``; runs are disjoint and ascending.

    A hash is the sum of a constant for each byte and its place, from the 64th place on times an odd
    number of its own for each 64 places: no pattern of letters makes differences cancel.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, side="right")))
        base = int(starts[at])
        size = int(ends[to - 1]) - base
        s, e = starts[at:to] - base, ends[at:to] - base
        place = np.arange(size, dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(np.append(s, size)))
        values = constants[((place & (_PLACES - 1)) << 8) | data[base : base + size]]
        if int((e - s).max()) > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            values[far] *= mix((place[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out[at:to] = mix(sums[e] - sums[s] + (e - s).astype(np.uint64) * _ODD)
        at = to
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words of all rows, and for each row the number of words before it."""
    inside = ~SPACES[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)  # a row starts here: words never run across
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def windows(codes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` codes that stay inside one row, and how many each row has."""
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    total = len(codes) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64), counts
    out = np.empty(total, np.uint64)
    for at in range(0, total, _SEGMENT):  # a run's sum is a difference of running sums, shifted to the start
        n = min(_SEGMENT, total - at)
        up, down = _powers(_SEGMENT + size)
        sums = np.zeros(n + size, np.uint64)
        np.cumsum(codes[at : at + n + size - 1] * up[: n + size - 1], out=sums[1:])
        out[at : at + n] = (sums[size:] - sums[:n]) * down[:n]
    return mix(out[ragged(first[:-1], counts)] + np.uint64(size)), counts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def pack48(values: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes | memoryview) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view("<u8").astype(np.uint64)
