"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashed word shingles. Under one global order (rare tokens first) two sets that
link share, within a prefix of each, a token of the rare class or a combination of k tokens
of a frequent class; prefixes are extended until that is certain. Candidates are verified on
the tokens themselves.

Steps, each bounded by a chunk of text, a slice of the token universe or a block of a bucket:

1. Chunks of documents send their distinct tokens, packed, to slices of the token universe.
2. A slice counts each token over the whole corpus and answers with the tokens that occur in
   two sets or more; all others can match nothing.
3. A chunk orders each document's tokens by those counts and writes prefix signatures.
4. Sets that share a signature are compared with one representative of the bucket each;
   buckets that still hold sets of different components are then compared completely.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb
from corpusqa.llm.components import components
from corpusqa.session import new_folder

SHINGLE_WORDS = 5
PERCENT = 75  # link when 100 * intersection >= PERCENT * union
CHUNK_BYTES = 8 << 20  # text of one chunk
SLICE_BYTES = 8 << 20  # text whose tokens fill one slice of the token universe
# Class k = 2 and k = 3 tokens: at least so many sets hold them.
CLASS_FROM = (64, 4096)
# Sets of fewer tokens use single tokens only: their prefixes have no room for combinations.
SMALL_SET = 48
NAMED_PAIRS = 256  # buckets of at most so many sets list their pairs
BLOCK = 1024  # sets of a bucket that one task compares with as many others

_TOKEN_BITS = np.uint64(16)  # dropped from a 64-bit hash: tokens have 48 bits
_BAND = 4 / 3  # linked sets are in the same or in neighbouring size bands


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts): distinct 48-bit shingle tokens of each row, ascending within the row."""
    tokens, sizes = [], []
    for lo, hi in tb.spans(offsets, 2 << 20):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, first = tb.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
        codes = tb.word_hashes(part, starts, ends, tb.LOWER)
        hashes, counts = tb.windows(codes, first, words)
        n_words = np.diff(first)
        short = np.flatnonzero((n_words > 0) & (n_words < words))
        if len(short):  # the whole sequence is the one token
            whole = np.array([_whole(codes[first[r] : first[r + 1]]) for r in short], np.uint64)
            rows = np.concatenate([np.repeat(np.arange(hi - lo), counts), short])
            hashes = np.concatenate([hashes, whole])
        else:
            rows = np.repeat(np.arange(hi - lo), counts)
        hashes = hashes >> _TOKEN_BITS
        for a in range(0, hi - lo, 1 << 16):  # row number and token share one sort key
            here = (rows >= a) & (rows < a + (1 << 16)) if hi - lo > 1 << 16 else slice(None)
            key = np.sort(((rows[here] - a).astype(np.uint64) << np.uint64(48)) | hashes[here])
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            tokens.append(key & np.uint64((1 << 48) - 1))
            sizes.append(np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=min(1 << 16, hi - lo - a)))
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(tokens), np.concatenate(sizes)


def _whole(codes: np.ndarray) -> int:
    h = 0x51ED270B
    for c in codes.tolist():
        h = ((h ^ c) * 0x100000001B3 + len(codes)) & 0xFFFFFFFFFFFFFFFF
    return int(tb.mix(np.array([h], np.uint64))[0])


def _digests(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each token set; equal sets have equal numbers. 0: the empty set."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tb.mix(tokens + np.uint64(0xA5A5A5)), out=sums[1:])
    ends = np.cumsum(counts)
    return np.where(counts > 0, tb.mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)), 0).astype(np.int64)


_OUT = pa.schema([("slice", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


@tb.tidy
def _send(batches: Iterator[pa.RecordBatch], slices: int, words: int) -> Iterator[pa.RecordBatch]:
    """Step 1. A set that the task has met before is listed as a copy and sends no tokens."""
    tb.make_room()
    task = TaskContext.get().partitionId() << 24
    seen: set[int] = set()
    held: list[tuple] = []
    size, chunk = 0, 0

    def flush() -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        nulls = np.concatenate([h[1] for h in held])
        tokens = np.concatenate([h[2] for h in held])
        counts = np.concatenate([h[3] for h in held])
        digest = _digests(tokens, counts)
        own = np.zeros(len(ids), bool)
        for i, d in enumerate(digest.tolist()):
            if d and d not in seen:
                seen.add(d)
                own[i] = True
        members = b"".join([len(ids).to_bytes(8, "little"), ids.tobytes(), nulls.tobytes(), own.tobytes(), counts.astype(np.int64).tobytes(), digest.tobytes()])
        rows = np.repeat(np.arange(len(ids)), counts)
        keep = own[rows]
        rows, tokens = rows[keep], tokens[keep]
        part = (tokens % np.uint64(slices)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        rows, tokens, part = rows[order], tokens[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        out = [((task + chunk) % slices, 0, members)]
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            out.append((int(part[a]), 1, _blob(rows[a:b], tokens[a:b])))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([task + chunk] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
            schema=_OUT,
        )

    for batch in batches:
        data, offsets = tb.flat(batch.column(1))
        ids = batch.column(0)
        for lo, hi in tb.spans(offsets, CHUNK_BYTES // 4):
            part = ids.slice(lo, hi - lo)
            tokens, counts = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
            held.append((part.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), part.is_null().to_numpy(zero_copy_only=False), tokens, counts))
            size += int(offsets[hi] - offsets[lo])
            if size >= CHUNK_BYTES:
                yield flush()
                held, size, chunk = [], 0, chunk + 1
                tb.trim()
    if held:
        yield flush()


def _blob(rows: np.ndarray, tokens: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    # document numbers and how many tokens each has, the tokens, and (in an answer) their counts
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(rows)]]))
    body = [len(heads).to_bytes(4, "little"), len(rows).to_bytes(4, "little"), rows[heads].astype(np.uint32).tobytes(), sizes.astype(np.uint32).tobytes(), tb.pack48(tokens)]
    return b"".join(body if counts is None else [*body, np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes()])


def _unblob(raw: bytes, counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    heads, n = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    view = memoryview(raw)
    docs = np.frombuffer(view[8 : 8 + 4 * heads], np.uint32)
    sizes = np.frombuffer(view[8 + 4 * heads : 8 + 8 * heads], np.uint32)
    at = 8 + 8 * heads
    tokens = tb.unpack48(view[at : at + 6 * n])
    return np.repeat(docs, sizes), tokens, np.frombuffer(view[at + 6 * n :], np.uint32) if counted else None


@tb.tidy_table
def _answer(table: pa.Table) -> pa.Table:
    """Step 2, for one slice: tokens with their number of sets, where that is over one."""
    tb.make_room()
    chunks, kinds, blobs = table["chunk"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist()
    out = [(c, 0, b) for c, k, b in zip(chunks, kinds, blobs, strict=True) if k == 0]
    sent = [(c, *_unblob(b)[:2]) for c, k, b in zip(chunks, kinds, blobs, strict=True) if k == 1]
    if sent:
        tokens = np.concatenate([s[2] for s in sent])
        order = np.argsort(tokens)
        ranked = tokens[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(ranked)]]))
        counts = np.empty(len(tokens), np.int64)
        counts[order] = np.repeat(sizes, sizes)
        at = 0
        for c, rows, own in sent:
            n = counts[at : at + len(own)]
            at += len(own)
            keep = n > 1
            if keep.any():
                out.append((c, 1, _blob(rows[keep], own[keep], n[keep])))
    return pa.Table.from_arrays(
        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
        names=["chunk", "kind", "data"],
    )


def _classes(counts: np.ndarray) -> np.ndarray:
    return 1 + np.searchsorted(np.array(CLASS_FROM), counts, side="right")


def signatures(tokens: np.ndarray, counts: np.ndarray, size: int, percent: int = PERCENT) -> list[int]:
    """Signatures of one set: ``tokens`` of two sets or more, rarest first, with their counts.

    ``size - len(tokens)`` further tokens occur in this set only and come first in the order.
    """
    missed = size - -(-percent * size // 100)  # tokens that a linked set may lack
    need = missed + 1 - (size - len(tokens))
    if need <= 0:
        return []
    band = int(np.log(size) / np.log(_BAND) + 1e-9)
    out: set[int] = set()
    for b in (band - 1, band):
        low = _BAND**b  # smaller set of a pair in this band has at least so many tokens
        groups = int(low * (100 - percent) / 200) + 2  # spreads a class, so that combinations stay few
        # a group of a class gives k - 1 tokens less than it takes: there must be room for that
        if low < SMALL_SET or low * percent / 100 < 3 * groups + 1:
            out.update(tb.mix(tokens[:need] + np.uint64(1)).tolist())
            continue
        kinds = _classes(counts)
        got, taken = 0, {}
        for t, k in zip(tokens.tolist(), kinds.tolist(), strict=True):
            if k == 1:
                out.add(int(tb.mix(np.array([t + 1], np.uint64))[0]))
                got += 1
            else:
                members = taken.setdefault((k, (t * 0x9E3779B1 >> 13) % groups), [])
                members.append(t)
                got += len(members) >= k
            if got >= need:
                break
        combos = [(c, k) for (k, _), members in taken.items() for c in combinations(sorted(members), k)]
        for k in (2, 3):
            chosen = np.array([c for c, kk in combos if kk == k], np.uint64)
            if len(chosen):
                h = np.full(len(chosen), (b * 31 + k) & 0xFFFF, np.uint64)
                for i in range(k):
                    h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
                out.update(h.tolist())
    return [s - (1 << 64) if s >= 1 << 63 else s for s in sorted(out)]


_SET_TYPE = "doc_id long, n_shingles long, set_id long, own boolean, tokens binary, signatures array<long>"


@tb.tidy_table
def _order(table: pa.Table, percent: int) -> pa.Table:
    """Step 3, for one chunk: a row for each document, with signatures where it can link."""
    tb.make_room()
    kinds, blobs = table["kind"].to_pylist(), table["data"].to_pylist()
    raw = next(b for k, b in zip(kinds, blobs, strict=True) if k == 0)
    n = int.from_bytes(raw[:8], "little")
    ids = np.frombuffer(raw, np.int64, n, 8)
    nulls = np.frombuffer(raw, bool, n, 8 + 8 * n)
    own = np.frombuffer(raw, bool, n, 8 + 9 * n)
    sizes = np.frombuffer(raw, np.int64, n, 8 + 10 * n)
    digest = np.frombuffer(raw, np.int64, n, 8 + 18 * n)
    packed: list[bytes | None] = [None] * n
    signed: list[list[int] | None] = [None] * n
    got = [_unblob(b, True) for k, b in zip(kinds, blobs, strict=True) if k == 1]
    if got:
        rows, tokens, counts = (np.concatenate([g[i] for g in got]) for i in range(3))
        shared = np.bincount(rows, minlength=n)
        can = sizes - shared <= sizes - -(-percent * sizes // 100)
        keep = can[rows]
        rows, tokens, counts = rows[keep], tokens[keep], counts[keep]
        order = np.lexsort((tokens, counts, rows))
        rows, tokens, counts = rows[order], tokens[order], counts[order]
        cuts = np.searchsorted(rows, np.arange(n + 1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[r], cuts[r + 1]
            signed[r] = signatures(tokens[a:b], counts[a:b], int(sizes[r]), percent) or None
            packed[r] = tb.pack48(np.sort(tokens[a:b])) if signed[r] else None
    return pa.Table.from_arrays(
        [pa.array(ids, pa.int64(), mask=nulls), pa.array(sizes, pa.int64()), pa.array(digest, pa.int64(), mask=sizes == 0), pa.array(own, pa.bool_()), pa.array(packed, pa.binary()), pa.array(signed, pa.list_(pa.int64()))],
        names=["doc_id", "n_shingles", "set_id", "own", "tokens", "signatures"],
    )


def _links(n: int, m: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


@tb.tidy
def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            both = np.concatenate([tb.unpack48(x.as_buffer()), tb.unpack48(y.as_buffer())])
            both.sort()
            if _links(int(n[i]), int(m[i]), int((both[1:] == both[:-1]).sum()), percent):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


@tb.tidy_table
def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Step 4, for two blocks of one bucket: a link wherever sets of different components join."""
    ids, sizes, roots, sides = (table[c].to_numpy() for c in ("set_id", "n_shingles", "root", "side"))
    seen_a, seen_b = [], []
    order = np.argsort(sizes, kind="stable")
    ids, sizes, roots, sides = ids[order], sizes[order], roots[order].copy(), sides[order]
    raw = table["tokens"].combine_chunks()
    if isinstance(raw, pa.ChunkedArray):
        raw = pa.concat_arrays(raw.chunks)
    sets = [tb.unpack48(raw[int(i)].as_buffer()) for i in order]
    one_block = bool((sides == 2).all())
    universe, spots = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by_token = np.argsort(spots, kind="stable")
    posted, cuts = rows[by_token], np.searchsorted(spots[by_token], np.arange(len(universe) + 1))
    own_cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    values, weight = np.unique(roots, return_counts=True)
    largest = values[np.argmax(weight)]
    # sets outside the largest component look for partners; inside it nothing is left to join
    for i in np.flatnonzero(roots != largest).tolist():
        mine = spots[own_cuts[i] : own_cuts[i + 1]]
        common = np.bincount(posted[tb.ragged(cuts[mine], cuts[mine + 1] - cuts[mine])], minlength=len(sets))
        ok = (100 * common >= percent * (sizes + sizes[i] - common)) & (roots != roots[i])
        if not one_block:
            ok &= sides != sides[i]
        for j in np.flatnonzero(ok).tolist():
            if roots[j] != roots[i]:  # an earlier link may have joined them
                seen_a.append(int(ids[i]))
                seen_b.append(int(ids[j]))
                roots[roots == roots[j]] = roots[i]
    return pa.Table.from_arrays([pa.array(seen_a, pa.int64()), pa.array(seen_b, pa.int64())], names=["a", "b"])


def _can_link(n: Column, k: Column, m: Column, j: Column, percent: int) -> Column:
    """Bound for sets of n and m tokens, of which k and j occur elsewhere at all."""
    most = F.least(k, j)
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (100 * most >= percent * (n + m - most))


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(signature, set_id, n, k) of sets that can link with some member of the bucket, by its least size."""
    k = F.floor(F.octet_length("tokens") / 6)
    rows = sets.select("set_id", F.col("n_shingles").alias("n"), k.alias("k"), F.explode("signatures").alias("signature"))
    least = rows.groupBy("signature").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    # a partner has at least so many tokens; the larger it is, the more must be common
    partner = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    return rows.join(least, "signature").filter(100 * F.col("k") >= percent * (F.col("n") + partner - F.col("k"))).select("signature", "set_id", "n", "k")


def _labelled(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    # postings with the component of their set, only of buckets with more than one component
    if roots is None:
        out = postings.withColumn("root", F.col("set_id"))
    else:
        out = postings.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = out.groupBy("signature").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("members"))
    return out.join(mixed.filter("_lo <> _hi").drop("_lo", "_hi"), "signature")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("n"), F.col("tokens").alias("x"))
    two = sets.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("m"), F.col("tokens").alias("y"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y")
    return rows.mapInArrow(partial(_verify, percent=percent), "a long, b long")


def _star(labelled: DataFrame, sets: DataFrame, turn: int, percent: int) -> DataFrame:
    """Links between each set and one representative: of those of its buckets, the most frequent."""
    chosen = labelled.groupBy("signature").agg(F.min_by(F.struct("set_id", "root", "n", "k"), F.xxhash64("set_id", F.lit(turn))).alias("_r"))
    pairs = labelled.join(chosen, "signature").filter(
        (F.col("_r.root") != F.col("root")) & _can_link(F.col("n"), F.col("k"), F.col("_r.n"), F.col("_r.k"), percent)
    )
    best = (
        pairs.groupBy(F.col("set_id").alias("a"), F.col("_r.set_id").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        .groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    )
    return _verified(best, sets, percent)


def _complete(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different components of a bucket, all of them.

    Small buckets name their pairs, each of which is verified once however many buckets it is in.
    A large bucket is cut into blocks; each pair of blocks is one task's work.
    """
    small = labelled.filter(F.col("members") <= NAMED_PAIRS)
    a, b = small.alias("a"), small.alias("b")
    named = a.join(
        b,
        (F.col("a.signature") == F.col("b.signature")) & (F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.root") != F.col("b.root"))
        & _can_link(F.col("a.n"), F.col("a.k"), F.col("b.n"), F.col("b.k"), percent),
    ).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    # block i meets block j: side 0 and 1, or 2 where i = j
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(
            F.least(own, j).alias("i"), F.greatest(own, j).alias("j"),
            F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side"),
        ),
    )
    large = labelled.filter(F.col("members") > NAMED_PAIRS)
    rows = large.select("signature", "set_id", "root", F.explode(pairs).alias("p")).select("signature", "set_id", "root", "p.*")
    rows = rows.join(sets.select("set_id", "n_shingles", "tokens"), "set_id")
    compared = rows.groupBy("signature", "i", "j").applyInArrow(lambda t: _compare(t, percent), "a long, b long")
    return _verified(named, sets, percent).unionByName(compared)


def shingle_sets(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Steps 1 to 3: a stored row for each document with its set size, set id and signatures."""
    spark = docs.sparkSession
    tb.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = max(1, -(-total // SLICE_BYTES))
    sent = texts.mapInArrow(partial(_send, slices=slices, words=words), "slice int, chunk long, kind int, data binary")
    counted = sent.groupBy("slice").applyInArrow(lambda t: _answer(t), "chunk long, kind int, data binary")
    ordered = counted.groupBy("chunk").applyInArrow(lambda t: _order(t, percent), _SET_TYPE)
    path = new_folder(spark, "shingle-sets")
    ordered.write.parquet(path)
    return spark.read.schema(_SET_TYPE).parquet(path)


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for every row of ``docs`` (doc_id, text).

    ``set_id`` names the token set, so copies share it. Documents without words have no set,
    link with nothing and are their own component. A null doc_id keeps its row; it never names
    a component unless all its members are null. Rows that repeat an id are documents of
    their own. Other columns are ignored; an empty table gives an empty result.
    A task that is run again must meet its rows in the same order: hand over a stored table.
    """
    stored = shingle_sets(docs, words, percent)
    held = stored.filter("own and signatures is not null")
    # copies in different tasks: one row for each set
    keys = held.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("_first"))
    spark = docs.sparkSession
    path = new_folder(spark, "shingle-prefixes")
    one = held.join(keys, "set_id").filter(F.struct(F.col("doc_id").isNull(), "doc_id") == F.col("_first"))
    one.select("set_id", "n_shingles", "tokens", "signatures").dropDuplicates(["set_id"]).write.parquet(path)
    sets = spark.read.parquet(path)
    path = new_folder(spark, "shingle-postings")
    _postings(sets, percent).write.parquet(path)
    postings = spark.read.parquet(path)
    roots, found = None, None
    for turn in (0, 1, 2):  # two rounds with representatives, then all that is left
        labelled = _labelled(postings, roots)
        new = _star(labelled, sets, turn, percent) if turn < 2 else _complete(labelled, sets, percent)
        where = new_folder(spark, "shingle-links")
        new.write.parquet(where)
        new = spark.read.parquet(where)
        if new.isEmpty():
            continue
        found = new if found is None else found.unionByName(new)
        roots = components(found)
    out = stored.select("doc_id", "n_shingles", "set_id")
    if roots is None:
        out = out.withColumn("_root", F.col("set_id"))
    else:
        out = out.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("_root", F.coalesce("root", "set_id")).drop("root")
    smallest = out.filter("_root is not null").groupBy("_root").agg(F.min("doc_id").alias("_least"))
    return out.join(smallest, "_root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("_root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), "set_id"
    )
