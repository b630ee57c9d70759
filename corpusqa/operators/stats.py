"""Evaluation statistics over per-question verdicts.

A verdict row is (corpus, run, question_id, qtype, time, finished, answered, candidates, correct).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _hits() -> list[Column]:
    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    return [
        F.count(F.lit(1)).alias("total"),
        count(F.col("finished").isNotNull()).alias("completed"),
        count(F.col("answered") & F.col("correct")).alias("correct"),
        count(F.col("candidates") > 0).alias("candidates"),
        count(F.col("answered") & ~F.col("correct")).alias("incorrect"),
    ]


def measures(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits with precision, recall and F1 per ``keys``."""
    hits = verdicts.groupBy(*keys).agg(*_hits())
    answered = F.col("correct") + F.col("incorrect")
    rated = hits.withColumn("precision", _rate(F.col("correct"), answered)).withColumn(
        "recall", _rate(F.col("correct"), F.col("total"))
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", _rate(2 * F.col("precision") * F.col("recall"), both))


def in_window(rows: DataFrame, start: int, end: int, time: str = "time") -> DataFrame:
    return rows.filter(F.col(time).between(start, end))


def time_stats(reports: DataFrame, start: int, end: int, width_ms: int | None = None) -> DataFrame:
    """First and last activity and message count in [start, end], per time slot if a width is given."""
    inside = in_window(reports, start, end)
    slot = [] if width_ms is None else [(F.floor(F.col("time") / width_ms) * width_ms).alias("slot")]
    return inside.groupBy(*slot).agg(
        F.min("time").alias("start"), F.max("time").alias("end"), F.count(F.lit(1)).alias("reports")
    )


def corpus_history(verdicts: DataFrame) -> DataFrame:
    """Statistics of every run of every corpus."""
    return measures(verdicts, ["corpus", "run"])


def corpus_stats_run(verdicts: DataFrame) -> DataFrame:
    """Statistics of the newest run of each corpus."""
    runs = measures(verdicts, ["corpus", "run"])
    newest = runs.filter("run is not null").groupBy("corpus").agg(F.max_by(F.struct(*runs.columns), "run").alias("_run"))
    return newest.select("_run.*")


def question_type_stats(verdicts: DataFrame, start: int, end: int) -> DataFrame:
    """Statistics per question type in a time window."""
    return measures(in_window(verdicts, start, end), ["qtype"])


def question_type_stats_run(verdicts: DataFrame) -> DataFrame:
    """Statistics per question type within each run of each corpus."""
    return measures(verdicts, ["corpus", "run", "qtype"])


def analyze_docs(asked: DataFrame, records: DataFrame, gold: DataFrame) -> DataFrame:
    """Verdict per asked question (corpus, run, question_id, qtype, time).

    ``records`` are merged reports by id, ``gold`` the accepted (question_id, answer) pairs.
    """
    done = records.select(
        F.col("id").alias("question_id"),
        "finished",
        "answer",
        F.coalesce(F.size("candidates"), F.lit(0)).alias("candidates"),
    )
    accepted = gold.select("question_id", "answer").distinct().withColumn("_ok", F.lit(True))
    found = asked.join(done, "question_id", "left").join(
        accepted, ["question_id", "answer"], "left"
    )
    answered = F.coalesce(F.col("finished"), F.lit(False))
    return found.select(
        "corpus", "run", "question_id", "qtype", "time", "finished",
        answered.alias("answered"),
        F.greatest(F.coalesce("candidates", F.lit(0)), F.lit(0)).alias("candidates"),
        (answered & F.col("_ok").isNotNull()).alias("correct"),
    )


def analyze_doc(asked: DataFrame, records: DataFrame, gold: DataFrame, question_id: int) -> DataFrame:
    """Verdict of one question."""
    return analyze_docs(asked.filter(F.col("question_id") == question_id), records, gold)


def reanalyze(asked: DataFrame, records: DataFrame, gold: DataFrame, path: str) -> None:
    """Drop all stored verdicts and compute them anew."""
    analyze_docs(asked, records, gold).write.mode("overwrite").parquet(path)
