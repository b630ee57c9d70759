"""A training-data pipeline over `documents`: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read back as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.llm.encoding import read_vocabulary
from corpusqa.llm.ppm_language import UNKNOWN, identify
from corpusqa.llm.shingle_join import jaccard_components
from corpusqa.llm.slack_packing import pack_sequences
from corpusqa.llm.substring_dedup import remove_repeats
from corpusqa.operators.joins import holds_map, lookup_join
from corpusqa.session import new_folder, scratch


def _aside(docs: DataFrame, *own: str) -> dict[str, str]:
    """Names for the columns a stage does not work on, so that they cannot be taken for its own."""
    return {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in own}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (no text, or none with a letter); fills in a missing lang."""
    aside = _aside(docs, "doc_id", "text", "lang")
    rows = docs.select("doc_id", "text", "lang", *[F.col(f"`{c}`").alias(n) for c, n in aside.items()])
    found = identify(rows, keep=("text", "lang", *aside.values())).filter(F.col("lang_pred") != UNKNOWN)
    found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id, or one without an id if none has one.

    Rows are told apart by a 64-bit digest of all their columns. Rows without words are no copies and stay.
    What is found on the way is deleted once the rows to keep are written.
    """
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if not holds_map(f.dataType)]
    keyed = docs.select(
        F.xxhash64(*told, *[c.isNull() for c in told]).alias("_row"), "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    kept_path = new_folder(spark, "kept-rows")
    with scratch(spark):
        found = jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text"))
        path = new_folder(spark, "copy-groups")
        # equal rows are in the same group
        found.groupBy(F.col("doc_id").alias("_row")).agg(
            F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("component"), F.max("set_id").isNull().alias("wordless")
        ).write.parquet(path)
        groups = spark.read.parquet(path)
        ids = keyed.groupBy("_row").agg(F.min("doc_id").alias("doc_id"))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
        first = groups.filter("not wordless").join(ids, "_row").groupBy("component").agg(F.min_by(F.struct("_row", "rows"), order).alias("_first"))
        wordless = groups.filter("wordless").select("_row", F.lit(1).cast("long").alias("rows"))
        first.select("_first.*").unionByName(wordless).write.parquet(kept_path)
    kept = spark.read.parquet(kept_path)
    # texts are moved only where the rows are too many to send to them
    rows = keyed.select("_row", "_doc")
    single = lookup_join(rows, kept.filter("rows = 1").select("_row"), "_row", "left_semi")
    repeated = lookup_join(rows, kept.filter("rows > 1").select("_row"), "_row", "left_semi").dropDuplicates(["_row"])
    return single.unionByName(repeated).select("_doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that repeat; documents that hold none are left as they are."""
    aside = _aside(docs, "doc_id", "text", "n_chars")
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in aside.items()])
    out = remove_repeats(rows, keep=tuple(aside.values()), leave_clean=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col(aside.get(c, c))).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences."""
    return pack_sequences(docs, read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", packing),
]

# A trained model and a tokenizer: SQL cannot say it. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_folder(spark, "pipeline")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
