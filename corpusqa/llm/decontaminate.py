"""Benchmark decontamination, with DataFrame functions only.

The windows of normalised words of the benchmark are a hash set that is sent to the tasks; every
window of every document is looked up there, and what the hash finds is compared word by word.
Documents are told apart by the SHA-256 of their text: copies share their hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.joins import fits_broadcast, lookup_join
from corpusqa.session import settle

SIZE = 10  # words of a window

# Fixed by the contract: characters of words, once A-Z are lower case, and in a text as it is. Said by
# what they are, not by what they are not: Java takes six times as long for the negated class.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _windows(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(gram, n, h, win), each different window once, and (win, item): whose it is."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    every = items.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("gram"))
    # written out once: the numbers must stay
    grams = settle(every.select("gram").distinct().select("gram", F.size("gram").alias("n"), F.xxhash64("gram").alias("h"), F.monotonically_increasing_id().alias("win")))
    owners = lookup_join(every.filter("item is not null"), grams.select("gram", "win"), "gram").select("win", "item").distinct()
    return grams, owners


def _hits(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(digest, pos, n, win): each window of ``texts`` (digest, w) that is one of ``grams``."""
    lengths = [r["n"] for r in grams.select("n").distinct().collect()]  # at most ``size`` numbers
    # A column used twice is computed before the rows of a document are made, once and not for each of
    # them; the outer form keeps Spark from inferring a filter that finds the words again.
    texts = texts.select("w", F.substring("digest", 1, 32).alias("d1"), F.substring("digest", 33, 32).alias("d2"))
    at = texts.select("w", "d1", "d2", F.posexplode_outer("w").alias("pos", "_"))
    for_length = F.explode(F.array(*[F.lit(n) for n in lengths])) if len(lengths) > 1 else F.lit(lengths[0] if lengths else 0)
    at = at.select("w", "d1", "d2", "pos", for_length.alias("n")).filter(F.col("pos") + F.col("n") <= F.size("w"))
    gram = F.slice("w", F.col("pos") + 1, F.col("n"))
    seen = at.select(F.concat("d1", "d2").alias("digest"), "pos", "n", gram.alias("here"), F.xxhash64(gram).alias("h"))
    wanted = grams.select("h", "gram", "win")
    if fits_broadcast(wanted):
        pairs = seen.join(F.broadcast(wanted), "h")
    else:
        pairs = lookup_join(seen, wanted, "h", max_bytes=0)
    # compared after the lookup by the number: as an equality it would become part of the join key
    same = (F.col("here") <= F.col("gram")) & (F.col("here") >= F.col("gram"))
    return pairs.filter(same).select("digest", "pos", "n", "win")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(digest, hit, items) of each different text that holds a window of ``benchmark``.

    ``digest`` is the SHA-256 of the text, ``hit`` the places (from 0) of its hit words, ``items`` the
    ids, as strings and in order, whose windows occur. Hits of copies merge inside the tasks.
    """
    grams, owners = _windows(benchmark, size)
    text = F.col("text").cast("string")
    texts = docs.select(text.alias("text")).filter("text is not null")
    texts = texts.select(_digest(F.col("text")).alias("digest"), words(F.col("text")).alias("w"))
    found = settle(_hits(texts, grams).groupBy("digest").agg(
        F.collect_set(F.struct("pos", "n")).alias("spans"), F.collect_set("win").alias("wins")))
    items = lookup_join(found.select("digest", F.explode("wins").alias("win")), owners, "win")
    items = items.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    hit = found.select("digest", F.array_distinct(places).alias("hit"))
    return hit.join(items, "digest", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Hit is a word inside any occurrence of a window. A null or wordless text has no words
    and holds nothing; items without words have no windows, and items without an id hit words but are not
    listed. Repeated and null ids keep their rows; an empty table of either kind gives
    no rows or no hits. Other columns are ignored.
    """
    found = find_contamination(docs, benchmark, size)
    told = found.select(
        "digest", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"),
        F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(RAW_WORD))).cast("long").alias("n_words"),
    )
    nothing = F.lit(0).cast("long")
    return lookup_join(rows, told, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", nothing).alias("n_hit"), F.coalesce("n_items", nothing).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _without(text: Column, hit: Column) -> Column:
    """``text`` without the words at the places ``hit`` and what separates each from the next word."""
    kept = F.array_except(F.sequence(F.lit(0), F.regexp_count(text, F.lit(RAW_WORD)) - 1), hit)
    every, between = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.split(text, RAW_WORD, -1)
    parts = F.transform(kept, lambda i: F.concat(F.get(every, i), F.get(between, i + 1)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(parts, ""))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, what: str = "spans", size: int = SIZE) -> DataFrame:
    """``docs`` with hit words taken out of ``text`` (``what="spans"``) or without contaminated rows ("documents").

    All columns of ``docs`` come back under their names, whatever these are; rows without a hit are as
    they were, null texts among them. Windows are those of ``contamination``.
    """
    if what not in ("spans", "documents"):
        raise ValueError("what is 'spans' or 'documents'")
    found = find_contamination(docs, benchmark, size).select("digest", "hit")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _digest(F.col("text").cast("string")).alias("digest"))
    if what == "documents":
        return lookup_join(rows, found.select("digest"), "digest", "left_anti").select("row.*")
    both = lookup_join(rows, found, "digest", "left")
    text = F.when(F.col("hit").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("hit")))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
