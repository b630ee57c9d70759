"""Logs, word vector files, annotations, triples and report messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.functions import vectors as vx

# Log line and its levels.
LOG_LINE = (
    r"^([0-9]+)\.([0-9]+)\.([0-9]+) - ([0-9]+):([0-9]+):([0-9]+).([0-9]+) \t?"
    r"\[(.*?): \t?([A-Za-z]+)\] \t?(.*)$"
)
LOG_LEVELS = ("error", "warning", "debug", "info")

REPORT_SCHEMA = (
    "seq bigint, kind string, id bigint, time bigint, question string, sender string, "
    "node string, step string, json string, success boolean, answer string, ranking double, "
    "candidates array<struct<answer:string,ranking:double>>"
)


def parse_log(lines: DataFrame, line: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """(time in epoch ms UTC, level, message, sender); unknown levels are info, other lines drop.

    The last part of the time is a number of milliseconds.
    """
    def part(i: int):
        return F.regexp_extract(line, LOG_LINE, i)

    day, month, year, hour, minute, second, ms = (part(i).try_cast("int") for i in range(1, 8))
    stamp = F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)"), F.lit("UTC"))
    time = F.unix_seconds(stamp) * 1000 + ms
    level = F.when(part(9).isin(list(LOG_LEVELS)), part(9)).otherwise("info")
    return (
        lines.filter(F.col(line).rlike(LOG_LINE))
        .select(
            *keys,
            time.alias("time"),
            level.alias("level"),
            part(10).alias("message"),
            part(8).alias("sender"),
        )
        .filter(F.col("time").isNotNull())
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def log_between(log: DataFrame, start: int, end: int) -> DataFrame:
    """Messages from ``start`` to ``end``; none if start is after end."""
    return log.filter(F.col("time").between(start, end))


def parse_word_vectors(lines: DataFrame, line: str = "value", normalize: bool = True) -> DataFrame:
    """Vocabulary (word, vec) of lines ``word f f ...``; a header ``count size`` is passed over."""
    parts = lines.select(F.split(F.trim(F.col(line)), " +").alias("_p")).filter(F.size("_p") > 2)
    vec = F.transform(F.slice("_p", 2, F.size("_p") - 1), lambda x: x.cast("double"))
    vocab = parts.select(F.get("_p", F.lit(0)).alias("word"), vec.alias("vec"))
    return vocab.withColumn("vec", vx.normalize(F.col("vec"))) if normalize else vocab


def read_word_vectors(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """All words of a word vector text file."""
    return parse_word_vectors(spark.read.text(path), normalize=normalize)


def read_vocabulary(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """The same from parquet (word, vec)."""
    vocab = spark.read.parquet(path).select("word", vx.as_doubles(F.col("vec")).alias("vec"))
    return vocab.withColumn("vec", vx.normalize(F.col("vec"))) if normalize else vocab


def parse_annotations(responses: DataFrame, json: str = "json", offset: str = "offset", keys: tuple[str, ...] = ()) -> DataFrame:
    """Annotation service answers as rows (uri, support, types, surface_form, offset, score).

    All fields come as strings. Bad rows are dropped, bad JSON gives none; ``offset`` of the
    chunk is added.
    """
    resource = (
        "struct<`@URI`:string,`@support`:string,`@types`:string,`@surfaceForm`:string,"
        "`@offset`:string,`@similarityScore`:string>"
    )
    parsed = F.from_json(json, f"struct<Resources:array<{resource}>>")
    rows = responses.select(*keys, F.col(offset).alias("_shift"), F.explode(parsed["Resources"]).alias("_r"))
    r = F.col("_r")
    return rows.select(
        *keys,
        F.concat(F.lit("<"), r["@URI"], F.lit(">")).alias("uri"),
        r["@support"].try_cast("int").alias("support"),
        F.split(r["@types"], ",").alias("types"),
        r["@surfaceForm"].alias("surface_form"),
        (r["@offset"].try_cast("int") + F.col("_shift")).alias("offset"),
        r["@similarityScore"].try_cast("double").alias("score"),
    ).dropna(subset=["uri", "support", "types", "surface_form", "offset", "score"])


# An N-Triples statement.
TRIPLE_LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<[^>]*>)?)\s*\.\s*$'


def parse_triples(lines: DataFrame, line: str = "value") -> DataFrame:
    """(s, p, o, lang) of N-Triples lines; comments and other lines are dropped."""
    def part(i: int):
        return F.regexp_extract(line, TRIPLE_LINE, i)

    quoted = F.replace(F.replace(part(6), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return lines.filter(F.col(line).rlike(TRIPLE_LINE)).select(
        F.concat(part(1), part(2)).alias("s"),
        part(3).alias("p"),
        F.concat(part(4), part(5), quoted).alias("o"),
        part(7).alias("lang"),
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return parse_triples(spark.read.text(path))


def stored_reports(messages: DataFrame) -> DataFrame:
    """Messages that are stored: all kinds but the basic one."""
    return messages.filter(F.col("kind") != "basic")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report messages from a folder of parquet files."""
    return stored_reports(spark.read.schema(REPORT_SCHEMA).parquet(path))


def stream_reports(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same as a stream of arriving files."""
    stream = spark.readStream.schema(REPORT_SCHEMA).option("maxFilesPerTrigger", max_files)
    return stored_reports(stream.parquet(path))
