"""Token ids of whole texts, encoding each distinct stretch of text once.

The public pre-tokenizer patterns never match across a change from a character that is not
white space to white space, so a text may be cut there and the parts encoded alone. Parts
repeat a lot: each worker keeps the ids of those it has met.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Sequence

import numpy as np

from corpusqa.llm import textbytes as tb

PIECE_BYTES = 2 << 20  # text encoded at a time
KEPT_STRETCHES = 1 << 20  # memory bound of a worker; beyond it the worker starts anew
LONG = 1 << 10  # stretches of more bytes are not kept


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the stretches: row starts, and white space after a character that surely is none."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    # a two-byte character from U+00C0 on; longer ones may be spaces, so no cut is made there
    before[2:] |= (data[1:-1] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    at = tb.SPACES[data] & before
    at[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(at)


class StretchEncoder:
    """``encode`` gives ids for new stretches; all others are looked up."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, parts: list[bytes]) -> None:
        got = self.encode(parts)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.checks = keys[order], np.concatenate([self.checks, checks])[order]
        self.at, self.sizes = np.concatenate([self.at, at])[order], np.concatenate([self.sizes, sizes])[order]

    def _rows_alone(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # different stretches with one hash: told apart by their bytes
        parts = [data[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        every = list(dict.fromkeys(parts))
        ids_of = dict(zip(every, self.encode(every), strict=True))
        sizes = np.fromiter((len(ids_of[p]) for p in parts), np.int64, len(parts))
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.fromiter((i for p in parts for i in ids_of[p]), np.uint32, int(total[-1])), np.diff(total[np.searchsorted(starts, offsets)])

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the rows of one piece of text."""
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys, where, inverse = np.unique(tb.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lengths = ends - starts
        if not np.array_equal(lengths[where][inverse], lengths):
            return self._rows_alone(data, starts, ends, offsets)
        # of each different stretch a second hash, of its bytes alone
        sizes = lengths[where]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        checks = tb.word_hashes(data[tb.ragged(starts[where], sizes)], bounds[:-1], bounds[1:], tb.SECOND)
        if len(self.keys) > KEPT_STRETCHES:
            self._clear()
        long_ones = ends[where] - starts[where] > LONG
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == keys[inside]
        if not np.array_equal(self.checks[spot[known]], checks[known]):
            return self._rows_alone(data, starts, ends, offsets)
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(keys[new], checks[new], [data[starts[w] : ends[w]].tobytes() for w in where[new]])
            spot = np.searchsorted(self.keys, keys)
        pick = spot[inverse]
        sizes = self.sizes[pick]
        ids = self.ids[tb.ragged(self.at[pick], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(total[np.searchsorted(starts, offsets)])
        if long_ones.any():
            self._clear()
        return ids, counts


def library_encoder(content: bytes) -> StretchEncoder:
    """Encoder by the tokenizers library; ``content`` is its JSON file. A text that holds one of its added
    tokens gets that token's id, as the library does it; no such token may begin or end with white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())

    def encode(parts: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return StretchEncoder(encode)


_KEPT: dict[tuple, StretchEncoder] = {}
tb.CACHES.append(_KEPT.clear)


def kept_encoder(content: bytes, make: Callable[[bytes], StretchEncoder] = library_encoder) -> StretchEncoder:
    """The worker's encoder for this vocabulary; it outlives a task."""
    key = (make.__name__, zlib.crc32(content), len(content))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(content)
    return _KEPT[key]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file (some MB), read by the driver and sent to the executors as it is."""
    with open(path, "rb") as f:
        return f.read()
