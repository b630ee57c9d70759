"""Word vectors: lookups, centroids, similarity, neighbours, training.

A vocabulary is a table (word, vec). It is looked up by join; ``lookup_join`` broadcasts it
only when its measured size allows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.functions import fixed
from corpusqa.functions import text as tx
from corpusqa.functions import vectors as vx
from corpusqa.operators.joins import fits_broadcast, lookup_join
from corpusqa.operators.neighbors import nearest_neighbors
from corpusqa.operators.training import train_vectors
from corpusqa.session import new_folder, scratch


def vector_size(vocab: DataFrame) -> int:
    """Length of the vectors; they must all have the same, or no sum over them has a meaning."""
    known = vocab.filter(F.col("vec").isNotNull())
    row = known.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if row["least"] != row["most"]:
        raise ValueError(f"vectors have different lengths: {row['least']} to {row['most']}")
    return row["least"] or 0


def contains(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """The given words that the vocabulary knows."""
    return lookup_join(words, vocab.select("word"), "word", "left_semi")


def vector(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each given word with its vector or null."""
    return lookup_join(words, vocab.select("word", "vec"), "word", "left")


def average(vectors: DataFrame, key: str, dim: int, vec: str = "vec") -> DataFrame:
    """Mean vector per key; shorter vectors count as padded with zeros."""
    sums = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *vx.sums(F.col(vec), dim))
    return sums.select(key, vx.scale_down(vx.gather(dim), F.col("_n").cast("double")).alias("vec"))


# Words of texts that one task looks up and adds.
CHUNK_WORDS = 1 << 21
# Word vectors gathered at once.
GATHERED = 1 << 15


def _summed(groups: DataFrame, key: str, words: str, vocab: DataFrame, dim: int) -> DataFrame:
    """(key, _n, _known, _v0, ...): words, known words and the sum of their vectors.

    A small vocabulary is broadcast: rows of a group merge inside the task that read them. The vectors of a larger one
    are not joined to every word: see ``_chunked``.
    """
    table = vocab.select("word", "vec")
    if fits_broadcast(table):
        rows = groups.select(key, F.explode_outer(words).alias("word"))
        found = rows.join(F.broadcast(table), "word", "left")
        return found.groupBy(key).agg(
            F.count("word").alias("_n"), F.count("vec").alias("_known"), *vx.sums(F.col("vec"), dim)
        )
    sums = _chunked(groups, key, words, {"": table}, {"": dim})
    return sums.groupBy(key).agg(
        F.sum(F.get("_counts", F.lit(0))).alias("_n"), F.sum(F.get("_knowns", F.lit(0))).alias("_known"), *vx.sums(F.col("_sums"), dim)
    )


def _word_table(models: Mapping[str, DataFrame], dims: Mapping[str, int]) -> DataFrame:
    """(word, copies, known, vec): for each word how often each model has it, with a vector, and the sums of its
    vectors, one model's after the other's."""
    every = None
    for name, vocab in models.items():
        part = vocab.select("word", F.lit(name).alias("model"), "vec")
        every = part if every is None else every.unionByName(part)
    lists = [F.collect_list(F.when(F.col("model") == name, F.struct(F.col("vec").cast("array<double>").alias("vec")))).alias(f"_l{i}") for i, name in enumerate(models)]

    def total(i: int, dim: int) -> Column:
        zeros = F.array_repeat(F.lit(0.0), dim)
        padded = F.transform(f"_l{i}", lambda x: F.slice(F.concat(F.transform(F.coalesce(x["vec"], F.array().cast("array<double>")), lambda v: F.coalesce(v, F.lit(0.0))), zeros), 1, dim))
        return F.aggregate(padded, zeros, vx.add)

    grouped = every.filter(F.col("word").isNotNull()).groupBy("word").agg(*lists)
    return grouped.select(
        "word",
        F.array(*[F.size(f"_l{i}").cast("bigint") for i in range(len(models))]).alias("copies"),
        F.array(*[F.size(F.filter(f"_l{i}", lambda x: x["vec"].isNotNull())).cast("bigint") for i in range(len(models))]).alias("known"),
        F.concat(*[total(i, dim) for i, dim in enumerate(dims.values())]).alias("vec"),
    )


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _chunk_sums(rows: pa.Table, found: pa.Table, models: int, dim: int) -> pa.Table:
    """Counts and vector sums of the texts of a chunk, by the vectors of its words."""
    lists = rows["_words"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), sizes)
    flat = lists.flatten()
    there = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(flat, value_set=found["word"].combine_chunks(), skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    # a word that a model has not counts once, one that it has twice counts twice
    copies = np.vstack([_matrix(found["copies"], models, np.int64), np.zeros((1, models), np.int64)])
    known = np.vstack([_matrix(found["known"], models, np.int64), np.zeros((1, models), np.int64)])
    counts, knowns = np.zeros((2, len(lists), models))
    for m in range(models):
        counts[:, m] = np.bincount(owner, weights=np.maximum(copies[at, m], 1) * there, minlength=len(lists))
        knowns[:, m] = np.bincount(owner, weights=known[at, m], minlength=len(lists))
    vectors = _matrix(found["vec"], dim, float)
    sums = np.zeros((len(lists), dim))
    some = np.flatnonzero(at >= 0)
    for a in range(0, len(some), GATHERED):
        part = some[a : a + GATHERED]
        mine, heads = np.unique(owner[part], return_index=True)
        sums[mine] += np.add.reduceat(vectors[at[part]], heads, axis=0)

    def as_lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)).cast(kind), x.shape[1]).cast(pa.list_(kind))

    return pa.Table.from_arrays(
        [rows["_key"].combine_chunks(), as_lists(counts, pa.int64()), as_lists(knowns, pa.int64()), as_lists(sums, pa.float64())],
        names=["_key", "_counts", "_knowns", "_sums"])


def _chunked(groups: DataFrame, key: str, words: str, models: Mapping[str, DataFrame], dims: Mapping[str, int]) -> DataFrame:
    """(key, _counts, _knowns, _sums) of each row of ``groups``, with a count for each model and all their vectors in one.

    Rows are dealt to chunks of about CHUNK_WORDS words. A chunk gets each vector that it needs once,
    so what is moved grows with the texts and not with a vector for each of their words.
    """
    rows = groups.select(F.col(key).alias("_key"), F.col(words).alias("_words"))
    place = F.xxhash64("_key")
    # about as many words as all rows have, from a part of the keys: it decides the number of chunks only
    some = groups.select(F.col(key).alias("_key"), F.col(words).alias("_words")).filter(F.pmod(place, F.lit(16)) == 0)
    about = 16 * (some.agg(F.sum(F.greatest(F.size("_words"), F.lit(0)))).first()[0] or 0)
    chunks = max(1, math.ceil(about / CHUNK_WORDS))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(F.lit("chunk"), "_key"), F.lit(chunks)).cast("int"))
    needed = rows.select(F.col("_chunk").alias("_of"), F.explode(F.array_distinct("_words")).alias("word")).distinct()
    table = _word_table(models, dims)
    found = needed.join(table, "word").select("_of", "word", "copies", "known", "vec")
    many, dim = len(models), sum(dims.values())
    # the type itself and not its name: fields of a key that are never null stay so
    kind = T.StructType([T.StructField("_key", rows.schema["_key"].dataType)])
    for name, element in (("_counts", T.LongType()), ("_knowns", T.LongType()), ("_sums", T.DoubleType())):
        kind = kind.add(name, T.ArrayType(element))
    sums = rows.groupBy("_chunk").cogroup(found.groupBy("_of")).applyInArrow(lambda a, b: _chunk_sums(a, b, many, dim), kind)
    return sums.withColumnRenamed("_key", key)


def centroid(groups: DataFrame, key: str, words: str, vocab: DataFrame, dim: int | None = None) -> DataFrame:
    """Mean word vector per word list; null if a word is unknown or the list is empty."""
    dim = dim or vector_size(vocab)
    mean = vx.scale_down(vx.gather(dim), F.col("_n").cast("double"))
    whole = (F.col("_n") > 0) & (F.col("_n") == F.col("_known"))
    return _summed(groups, key, words, vocab, dim).select(key, F.when(whole, mean).alias("vec"))


def centroid_tolerant(groups: DataFrame, key: str, words: str, vocab: DataFrame, dim: int | None = None) -> DataFrame:
    """Sum of the known word vectors over the number of all words; zeros for an empty list."""
    dim = dim or vector_size(vocab)
    mean = vx.scale_down(vx.gather(dim), F.col("_n").cast("double"))
    return _summed(groups, key, words, vocab, dim).select(key, mean.alias("vec"))


def paragraph_vector(docs: DataFrame, key: str, vocab: DataFrame, text: str = "text", dim: int | None = None) -> DataFrame:
    """Vector of a text: mean over its tokens, unknown tokens as zeros."""
    groups = docs.select(key, tx.words(F.col(text)).alias("_words"))
    return centroid_tolerant(groups, key, "_words", vocab, dim)


def _pair_vectors(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    v = vocab.select("word", "vec")
    one = v.select(F.col("word").alias("word1"), F.col("vec").alias("_a"))
    two = v.select(F.col("word").alias("word2"), F.col("vec").alias("_b"))
    return lookup_join(lookup_join(pairs, one, "word1", "left"), two, "word2", "left")


def word_cosine(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Similarity of (word1, word2); null if a word is unknown."""
    found = _pair_vectors(pairs, vocab)
    return found.withColumn("cosine", vx.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def word_euclidean(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distance of (word1, word2); null if a word is unknown."""
    found = _pair_vectors(pairs, vocab)
    return found.withColumn("distance", vx.euclidean(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def _as_items(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.col("word").alias("item"), "vec")


def nearest_words(
    queries: DataFrame,
    vocab: DataFrame,
    n: int = fixed.NEIGHBORS,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Top ``n`` words per query vector (qid, vec).

    ``include`` (word) limits the words for all queries; ``exclude`` (qid, item) drops
    words per query.
    """
    items = _as_items(vocab)
    if include is not None:
        items = items.join(include.select(F.col("word").alias("item")).distinct(), "item", "left_semi")
    return nearest_neighbors(queries, items, n, exclude=exclude)


def distance(groups: DataFrame, key: str, words: str, vocab: DataFrame, n: int = fixed.NEIGHBORS) -> DataFrame:
    """Neighbours of the mean of each word list, its own words left out."""
    mean = centroid(groups, key, words, vocab).filter(F.col("vec").isNotNull())
    queries = mean.select(F.col(key).alias("qid"), vx.normalize(F.col("vec")).alias("vec"))
    own = groups.select(F.col(key).alias("qid"), F.explode(words).alias("item"))
    return nearest_words(queries, vocab, n, exclude=own)


def analogy(triples: DataFrame, key: str, vocab: DataFrame, n: int = fixed.NEIGHBORS) -> DataFrame:
    """Words nearest to word1 - word2 + word3, the three left out; nothing if one is unknown."""
    v = vocab.select("word", "vec")
    found = triples
    for i in (1, 2, 3):
        part = v.select(F.col("word").alias(f"word{i}"), F.col("vec").alias(f"_v{i}"))
        found = lookup_join(found, part, f"word{i}")
    target = vx.add(vx.subtract(F.col("_v1"), F.col("_v2")), F.col("_v3"))
    queries = found.select(F.col(key).alias("qid"), vx.normalize(target).alias("vec"))
    own = triples.select(
        F.col(key).alias("qid"), F.explode(F.array("word1", "word2", "word3")).alias("item")
    )
    return nearest_words(queries, vocab, n, exclude=own)


def rank_words(sets: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """Similarity of ``word`` to each ``member`` of its set; a set with an unknown word gives none.

    ``sets`` has one row (key, word, member) per member.
    """
    pairs = sets.select(key, F.col("word").alias("word1"), F.col("member").alias("word2"))
    scored = word_cosine(pairs.distinct(), vocab)
    unknown = scored.filter(F.col("cosine").isNull()).select(key).distinct()
    known = scored.join(unknown, key, "left_anti")
    return known.select(key, F.col("word1").alias("word"), F.col("word2").alias("member"), "cosine")


def near_words(
    groups: DataFrame, key: str, vocab: DataFrame, n: int = fixed.NEIGHBORS
) -> DataFrame:
    """Words nearest to the mean of unit vectors of ``positive`` minus ``negative`` words.

    ``groups`` has (key, positive, negative) with string arrays. Input words are left out;
    a group with an unknown word gives none.
    """
    signed = groups.select(
        key,
        F.explode(
            F.concat(
                F.transform("positive", lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("sign"))),
                F.transform("negative", lambda w: F.struct(w.alias("word"), F.lit(-1.0).alias("sign"))),
            )
        ).alias("_w"),
    ).select(key, "_w.word", "_w.sign")
    dim = vector_size(vocab)
    unit = vocab.select("word", vx.normalize(F.col("vec")).alias("vec"))
    found = lookup_join(signed, unit, "word", "left")
    sums = found.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("vec").alias("_known"),
        *vx.sums(F.col("vec"), dim, F.col("sign")),
    )
    mean = vx.scale_down(vx.gather(dim), F.col("_n").cast("double"))
    queries = sums.filter(F.col("_n") == F.col("_known")).select(F.col(key).alias("qid"), mean.alias("vec"))
    own = signed.select(F.col(key).alias("qid"), F.col("word").alias("item"))
    return nearest_words(queries, vocab, n, exclude=own)


def near_words_text(docs: DataFrame, key: str, vocab: DataFrame, text: str = "text", n: int = fixed.NEIGHBORS) -> DataFrame:
    """``near_words`` with the tokens of a text as positives; tokens without a vector are passed over."""
    rows = docs.select(key, F.explode(tx.words(F.col(text))).alias("word"))
    dim = vector_size(vocab)
    unit = vocab.select("word", vx.normalize(F.col("vec")).alias("vec"))
    sums = lookup_join(rows, unit, "word").groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), *vx.sums(F.col("vec"), dim)
    )
    mean = vx.scale_down(vx.gather(dim), F.col("_n").cast("double"))
    queries = sums.select(F.col(key).alias("qid"), mean.alias("vec"))
    own = rows.select(F.col(key).alias("qid"), F.col("word").alias("item"))
    known = lookup_join(own, vocab.select(F.col("word").alias("item")), "item", "left_semi")
    return nearest_words(queries, vocab, n, exclude=known)


def vectorize(docs: DataFrame, key: str, models: Mapping[str, DataFrame], text: str = "text") -> DataFrame:
    """(key, vectors): per document the vector of each named model, as a map.

    Documents are read and tokenised once; the words of all models are one lookup table.
    """
    dims = {name: vector_size(vocab) for name, vocab in models.items()}
    groups = docs.select(key, tx.words(F.col(text)).alias("_words"))
    sums = _chunked(groups, key, "_words", models, dims)
    whole = sums.groupBy(key).agg(
        *[F.sum(F.get("_counts", F.lit(i))).alias(f"_n{i}") for i in range(len(dims))], *vx.sums(F.col("_sums"), sum(dims.values()))
    )
    entries, at = [], 0
    for i, (name, dim) in enumerate(dims.items()):
        part = F.array(*[F.col(f"_v{j}") for j in range(at, at + dim)]).cast("array<double>")
        entries += [F.lit(name), vx.scale_down(part, F.col(f"_n{i}").cast("double"))]
        at += dim
    return whole.select(key, F.create_map(*entries).alias("vectors"))


def unvectorize(docs: DataFrame, column: str = "vectors") -> DataFrame:
    """Documents with their stored vectors reset to an empty map."""
    return docs.withColumn(column, F.create_map().cast("map<string,array<double>>"))


def train_embeddings(
    docs: DataFrame,
    text: str = "text",
    size: int = 64,
    window: int = 5,
    min_count: int = 5,
    iterations: int = 5,
    seed: int = 42,
    path: str | None = None,
    name: str = "model",
    **other: object,
) -> DataFrame:
    """Train word vectors and return the vocabulary (word, vec): factors of weighted co-occurrence counts.

    With ``path`` the model is stored under a name that holds its parameters, and a model
    already stored there is loaded instead of trained. Vocabulary, counts and vectors are tables
    throughout; nothing that grows with them is held by the driver or broadcast unmeasured.
    """
    if other:
        raise ValueError(f"not supported by these word vectors: {sorted(other)}")
    spark = docs.sparkSession
    target = f"{path or new_folder(spark, 'models')}/{name}-sze_{size}-wnd_{window}-mc_{min_count}-it_{iterations}"
    try:
        return spark.read.parquet(target)
    except AnalysisException:  # none stored there yet
        with scratch(spark):
            train_vectors(docs, text, size, window, min_count, iterations, seed).write.parquet(target)
        return spark.read.parquet(target)


def train_grid(docs: DataFrame, path: str, grid: list[dict], text: str = "text") -> dict[str, DataFrame]:
    """Train one model per parameter set, each stored once; vocabulary by parameter name."""
    out = {}
    for params in grid:
        label = "-".join(f"{k}_{v}" for k, v in sorted(params.items()))
        out[label] = train_embeddings(docs, text, path=path, **params)
    return out
