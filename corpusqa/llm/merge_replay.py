"""Byte-level BPE by corpus-level merge replay, and decoding.

Words that a worker has not met are laid end to end. An inverted index leads from a token pair
(by the id it merges to) to the positions where it stands; ids are taken in rank order, each
merge is applied at all its positions, and only the two neighbours of a merge are looked at
anew. A merge that makes a pair of a lower rank gives way to it, as in a word-by-word encoder.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb
from corpusqa.llm.encoding import PIECE_BYTES, StretchEncoder, kept_encoder

KEPT_WORDS = 1 << 19  # memory bound of a worker
KEPT_PAIRS = 1 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 text and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}

    def _merged(self, a: int, b: int) -> int:
        # id that two neighbours merge to, or -1
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return got

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        single = [self.ranks[bytes([b])] for b in range(256)]
        tokens: list[int] = []  # -1 stands between words and where a token was merged away
        for w in words:
            tokens += [single[b] for b in w]
            tokens.append(-1)
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        merged = self._merged
        for i in range(n - 1):
            a, b = tokens[i], tokens[i + 1]
            if a >= 0 and b >= 0 and (m := merged(a, b)) >= 0:
                index.setdefault(m, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = sorted(index.pop(rank, ()))
            for k, i in enumerate(places):
                a, j = tokens[i], after[i]
                if a < 0 or j >= n or tokens[j] < 0 or merged(a, tokens[j]) != rank:
                    continue  # a neighbouring merge has changed it
                tokens[i], tokens[j] = rank, -1
                right = after[i] = after[j]
                if right < n:
                    before[right] = i
                lowest = rank
                left = before[i]
                for p, x, q in ((left, left, i), (i, i, right)):
                    if x >= 0 and q < n and tokens[x] >= 0 and tokens[q] >= 0 and (m := merged(tokens[x], tokens[q])) >= 0:
                        if m in index:
                            index[m].append(p)
                        else:
                            index[m] = [p]
                            heapq.heappush(heap, m)
                        lowest = min(lowest, m)
                if lowest < rank and k + 1 < len(places):
                    if rank in index:
                        index[rank] += places[k + 1 :]
                    else:
                        index[rank] = places[k + 1 :]
                        heapq.heappush(heap, rank)
                    break
        out, at = [], 0
        for w in words:
            out.append([t for t in tokens[at : at + len(w)] if t >= 0])
            at += len(w) + 1
        return out


def replay_encoder(content: bytes) -> StretchEncoder:
    """Encoder for a rank file; the first line of ``content`` is the pattern that splits texts."""
    pattern, _, ranks = content.partition(b"\n")
    split = regex.compile(pattern.decode()).findall
    replay = MergeReplay(read_ranks(ranks))
    kept: dict[bytes, list[int]] = {}

    def encode(parts: list[bytes]) -> list[list[int]]:
        if len(kept) > KEPT_WORDS:
            kept.clear()
        words = [[w.encode("utf-8", "surrogatepass") for w in split(p.decode("utf-8", "replace"))] for p in parts]
        new = list({w: None for ws in words for w in ws if w not in kept})
        got = dict(zip(new, replay.words(new), strict=True))
        out = [[i for w in ws for i in (got[w] if w in got else kept[w])] for ws in words]
        kept.update((w, i) for w, i in got.items() if len(w) <= 64)
        return out

    return StretchEncoder(encode)


def _content(pattern: str, ranks: bytes) -> bytes:
    return pattern.encode() + b"\n" + ranks


def _encode(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    encoder = kept_encoder(content.value, replay_encoder)
    for batch in batches:
        data, offsets = tb.flat(batch.column(1))
        for lo, hi in tb.spans(offsets, PIECE_BYTES):
            ids, counts = encoder.rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ends = np.concatenate([[0], np.cumsum(counts)]) * 4
            raw = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts), raw.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of ``docs`` (doc_id, text); ids are little-endian 32-bit numbers.

    ``ranks`` is a rank file, ``pattern`` the expression whose matches are encoded separately; no
    special tokens. A null or empty text has no ids. Null and repeated doc_ids keep their rows;
    other columns are ignored; an empty table gives an empty result.
    """
    tb.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_content(pattern, ranks))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(partial(_encode, content=sent), "doc_id long, n_tokens long, ids binary")


def _decode(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    ranks = read_ranks(content.value)
    top = max(ranks.values(), default=-1) + 1
    table = [b""] * top
    for token, r in ranks.items():
        table[r] = token
    sizes = np.array([len(t) for t in table], np.int64)
    joined = np.frombuffer(b"".join(table), np.uint8)
    starts = np.cumsum(sizes) - sizes
    for batch in batches:
        data, offsets = tb.flat(batch.column(2))
        for lo, hi in tb.spans(offsets, PIECE_BYTES):
            ids = np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes(), "<u4")
            if len(ids) and int(ids.max()) >= top:
                raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
            text = joined[tb.ragged(starts[ids], sizes[ids])]
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[(offsets[lo : hi + 1] - offsets[lo]) // 4]
            raw = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), raw.cast(pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])


def decode_ids(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the bytes that the ids stand for."""
    tb.small_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(partial(_decode, content=sent), "doc_id long, n_tokens long, ids binary, decoded binary")
