"""Token-id files with fixed-width bit packing.

A file stores each id in the fewest bits that hold the vocabulary. Ids are cut into blocks of
BLOCK_IDS; a table of byte offsets gives the start of each block, so any range of ids is
unpacked from the blocks that hold it. 64 ids of b bits are exactly b words of 64 bits, which
makes packing and unpacking 64 shifts of whole columns.

Layout (little-endian): magic, bits (u32), ids (u64), ids in a block (u32), blocks (u32), block
byte offsets (u64 each, and the end), then the blocks, each a whole number of 64-id groups.

Files travel and are stored as rows of a Parquet folder, so that any store Spark writes to will
do, and a lost task leaves no half-written file. A row: (shard, file, doc_ids, n_tokens, ids).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb
from corpusqa.llm.encoding import PIECE_BYTES, kept_encoder
from corpusqa.operators.joins import running_total
from corpusqa.session import new_folder

MAGIC = b"IDBITS1\0"
BLOCK_IDS = 4096
FILE_IDS = 1 << 20  # a file is closed when it holds so many; a document is never split
SHARD_BYTES = 32 << 20  # text of one task


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _columns(bits: int) -> Iterator[tuple[int, int, np.uint64, int]]:
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        yield j, word, np.uint64(shift), shift + bits - 64


def _pack(ids: np.ndarray, bits: int) -> bytes:
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), bits), np.uint64)
    for j, word, shift, over in _columns(bits):
        words[:, word] |= groups[:, j] << shift
        if over > 0:
            words[:, word + 1] |= groups[:, j] >> np.uint64(bits - over)
    return words.astype("<u8").tobytes()


def _unpack(raw: memoryview, bits: int) -> np.ndarray:
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    for j, word, shift, over in _columns(bits):
        out[:, j] = words[:, word] >> shift
        if over > 0:
            out[:, j] |= words[:, word + 1] << np.uint64(bits - over)
    return (out.reshape(-1) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def pack_file(ids: np.ndarray, vocabulary: int) -> bytes:
    """``ids`` as one file. An id outside the vocabulary is an error."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {vocabulary}")
    bits = bits_for(vocabulary)
    blocks = [_pack(ids[a : a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = MAGIC + bits.to_bytes(4, "little") + len(ids).to_bytes(8, "little") + BLOCK_IDS.to_bytes(4, "little") + len(blocks).to_bytes(4, "little")
    return b"".join([head, offsets.tobytes(), *blocks])


def read_ids(raw: bytes | memoryview, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a file; only the blocks that hold them are unpacked."""
    view = memoryview(raw)
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a token-id file")
    bits, size = int.from_bytes(view[8:12], "little"), int.from_bytes(view[12:20], "little")
    block, blocks = int.from_bytes(view[20:24], "little"), int.from_bytes(view[24:28], "little")
    count = size - start if count is None else count
    if start < 0 or count < 0 or start + count > size:
        raise IndexError(f"ids {start} to {start + count} of {size}")
    if not count:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(view[28 : 28 + 8 * (blocks + 1)], "<u8")
    body = view[28 + 8 * (blocks + 1) :]
    first, last = start // block, (start + count - 1) // block
    ids = _unpack(body[int(offsets[first]) : int(offsets[last + 1])], bits)  # blocks but the last are full
    return ids[start - first * block :][:count]


def _write(batches: Iterator[pa.RecordBatch], content, end_id: int, vocabulary: int) -> Iterator[pa.RecordBatch]:
    encoder = kept_encoder(content.value)
    shard, file = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate([h[1] for h in held])
        docs = pa.concat_arrays([h[0] for h in held])
        counts = np.concatenate([h[2] for h in held])
        whole = np.array([0, len(counts)], np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([file], pa.int32()), pa.ListArray.from_arrays(whole, docs), pa.ListArray.from_arrays(whole, pa.array(counts)), pa.array([pack_file(ids, vocabulary)], pa.binary())],
            names=["shard", "file", "doc_ids", "n_tokens", "ids"],
        )

    for batch in batches:
        data, offsets = tb.flat(batch.column(1))
        for lo, hi in tb.spans(offsets, PIECE_BYTES):
            ids, counts = encoder.rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            held.append((batch.column(0).slice(lo, hi - lo), np.insert(ids, np.cumsum(counts), end_id), counts + 1))
            size += int(counts.sum()) + len(counts)
            if size >= FILE_IDS:
                yield close()
                held, size, file = [], 0, file + 1
    if held:
        yield close()


def write_token_files(docs: DataFrame, content: bytes, path: str, end_id: int, vocabulary: int) -> None:
    """Encode ``docs`` (doc_id, text) into token-id files below ``path``, in ascending doc_id order.

    ``content`` is the JSON file of a tokenizer. A null text is empty and holds the end id
    only; null ids come first; rows that repeat an id follow one another.
    """
    spark = docs.sparkSession
    tb.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ordered = texts.repartitionByRange(max(1, -(-total // SHARD_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    sent = spark.sparkContext.broadcast(content)
    files = ordered.mapInArrow(
        partial(_write, content=sent, end_id=end_id, vocabulary=vocabulary),
        "shard int, file int, doc_ids array<long>, n_tokens array<long>, ids binary",
    )
    files.write.option("compression", "none").parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            docs, counts = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
            raw = memoryview(batch.column(4)[i].as_buffer())
            starts = np.cumsum(counts) - counts
            crc = []
            # whole documents of about a megabyte of ids at a time, by random access
            for lo, hi in tb.spans(np.append(starts, starts[-1] + counts[-1]), 1 << 18):
                ids = read_ids(raw, int(starts[lo]), int(counts[lo:hi].sum())).astype("<u4")
                at = starts[lo:hi] - starts[lo]
                crc += [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), counts[lo:hi].tolist(), strict=True)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), pa.array([batch.column(1)[i].as_py()] * n, pa.int32()), docs, pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())],
                names=["shard", "file", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, file, at) of each document in files below ``path``.

    ``start`` counts the ids of all documents before, ``at`` those before it in its own file.
    """
    files = spark.read.parquet(path)
    sizes = files.select("shard", "file", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("size"))
    before = running_total(sizes, "size", [F.col("shard"), F.col("file")], name="before").drop("size")
    rows = files.select("shard", "file", "doc_ids", "n_tokens", "ids").mapInArrow(
        _digest, "shard int, file int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(before, ["shard", "file"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "file", "at"
    )


def token_files(docs: DataFrame, content: bytes, end_id: int = 2, vocabulary: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token-id files and describe each document from what was written."""
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_str(content.decode()).get_vocab_size()
    path = path or new_folder(docs.sparkSession, "token-ids")
    write_token_files(docs, content, path, end_id, vocabulary)
    return read_token_files(docs.sparkSession, path)
