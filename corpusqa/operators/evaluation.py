"""A run of evaluation: the questions of corpora are asked, their answers scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.answers import ask_batch
from corpusqa.operators.joins import lookup_join
from corpusqa.operators.stats import measures
from corpusqa.session import settle


def _key(corpus: str, number: str) -> Column:
    # one key of both, with nulls told from values
    return F.to_json(F.struct(F.col(corpus).alias("c"), F.col(number).cast("long").alias("n")))


def _said(answer: Column) -> Column:
    # without the line that names the source
    return F.substr(answer, F.instr(answer, "\n") + 1)


def ask_corpora(
    corpora: DataFrame, questions: DataFrame, answers: DataFrame, snippets: DataFrame, run: int, time: int, names: DataFrame | None = None, **options: object
) -> DataFrame:
    """Verdicts (corpus, run, question_id, qtype, time, finished, answered, candidates, correct) of one run.

    Asked are the questions (corpus, id, question, qtype, deprecated) of ``corpora``, or of those in ``names``; what is
    deprecated, corpus or question, is left out. ``options`` go to ``ask_batch``. An answer is correct if one of the question's accepted
    ``answers`` (corpus, question, id, answer) stands in its text, in any case of letters; empty and null ones never do.
    A question that is there several times is asked once, with its smallest text. A null flag means not deprecated; a null
    question finds nothing. ``candidates`` is 1 where any was found.
    """
    def in_use(rows: DataFrame) -> DataFrame:
        return rows.filter(~F.coalesce("deprecated", F.lit(False)))

    open_ones = in_use(corpora).select(F.col("name").alias("corpus")).distinct()
    if names is not None:
        open_ones = open_ones.join(names.select(F.col("name").alias("corpus")), "corpus", "left_semi")
    asked = (
        lookup_join(in_use(questions).select("corpus", "id", "question", "qtype"), open_ones, "corpus", "left_semi")
        .groupBy("corpus", F.col("id").alias("question_id"))
        .agg(F.min(F.struct("question", "qtype")).alias("_q"))
        .select(_key("corpus", "question_id").alias("qid"), "corpus", "question_id", "_q.*")
    )
    asked = settle(asked)
    told = settle(ask_batch(asked.select("qid", F.coalesce("question", F.lit("")).alias("question")), snippets, **options).select("qid", "status", "answer"))
    said = told.filter("status = 'answered'").select("qid", F.lower(_said(F.col("answer"))).alias("_said"))
    accepted = answers.filter("answer <> ''").select(_key("corpus", "question").alias("qid"), F.lower("answer").alias("_gold"))
    right = lookup_join(accepted, said, "qid").filter(F.contains("_said", "_gold")).select("qid").distinct()
    found = asked.join(told, "qid", "left").join(right.withColumn("_right", F.lit(True)), "qid", "left")
    answered = F.coalesce(F.col("status") == "answered", F.lit(False))
    return found.select(
        "corpus",
        F.lit(run).cast("long").alias("run"),
        "question_id",
        "qtype",
        F.lit(time).cast("long").alias("time"),
        answered.alias("finished"),
        answered.alias("answered"),
        F.when(F.col("status") == "failed", 0).otherwise(1).alias("candidates"),
        F.coalesce("_right", F.lit(False)).alias("correct"),
    )


def evaluate(
    corpora: DataFrame, questions: DataFrame, answers: DataFrame, snippets: DataFrame, run: int, time: int, path: str, names: DataFrame | None = None, **options: object
) -> DataFrame:
    """Hits, precision, recall and F1 of each corpus in this run; its verdicts are stored in ``path`` under the run's number.

    A run that is done again replaces its verdicts. ``stats.corpus_history`` over ``path`` compares runs.
    """
    spark = questions.sparkSession
    where = f"{path}/run={int(run)}"
    ask_corpora(corpora, questions, answers, snippets, run, time, names, **options).drop("run").write.mode("overwrite").parquet(where)
    return measures(spark.read.parquet(where).withColumn("run", F.lit(run).cast("long")), ["corpus", "run"])
