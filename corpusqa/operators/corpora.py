"""Question corpora as three tables: corpora, questions, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.joins import attach_children, first_per_key, lookup_join, number_rows
from corpusqa.operators.tables import set_flag


def corpus_exists(names: DataFrame, corpora: DataFrame) -> DataFrame:
    """Each given name and whether it is a corpus."""
    known = corpora.select("name").distinct().withColumn("_known", F.lit(True))
    found = lookup_join(names.select("name"), known, "name", "left")
    return found.select("name", F.col("_known").isNotNull().alias("exists"))


def create_corpora(new: DataFrame, corpora: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a name that exists, or is given again, is rejected.

    ``new`` is (seq, name, description); of one name the first in ``seq`` counts.
    """
    first = first_per_key(new, ["name"], [F.col("seq")])
    accepted = first.join(corpora.select("name"), "name", "left_anti")
    taken = accepted.select("name", "seq")
    rejected = new.join(taken, ["name", "seq"], "left_anti")
    return accepted.withColumn("deprecated", F.lit(False)), rejected


def deprecate_corpus(corpora: DataFrame, names: DataFrame) -> DataFrame:
    """Corpora with ``deprecated`` set for the given names; nothing is deleted."""
    return set_flag(corpora, names.select("name"), ["name"], "deprecated", True)


def deprecate_question(questions: DataFrame, which: DataFrame) -> DataFrame:
    """Questions with ``deprecated`` set by (corpus, id)."""
    return set_flag(questions, which.select("corpus", "id"), ["corpus", "id"], "deprecated", True)


def add_questions(new: DataFrame, questions: DataFrame, order_by: list[str]) -> DataFrame:
    """New questions with ids counted on from the highest id of their corpus.

    ``new`` is (corpus, question, qtype, atype, answers array, order columns).
    """
    highest = questions.groupBy("corpus").agg(F.max("id").alias("_max"))
    numbered = number_rows(new, [F.col(c) for c in order_by], ["corpus"], "_no")
    found = lookup_join(numbered, highest, "corpus", "left")
    return found.select(
        "*", (F.coalesce("_max", F.lit(0)) + F.col("_no")).alias("id"), F.lit(False).alias("deprecated")
    ).drop("_max", "_no")


def question_answers(added: DataFrame) -> DataFrame:
    """Answer rows of added questions: (corpus, question, id, answer), id by position."""
    return added.select(
        "corpus", F.col("id").alias("question"), F.posexplode("answers").alias("_at", "answer")
    ).select("corpus", "question", (F.col("_at") + 1).alias("id"), "answer")


def get_corpus(corpora: DataFrame, questions: DataFrame, answers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Corpora with their questions and those with their answers, one row per answer.

    A corpus or question may own any share of the rows, so its children stay rows; a corpus
    without questions and a question without answers appear once with nulls.
    """
    wanted = corpora if names is None else corpora.join(names.select("name"), "name", "left_semi")
    c = wanted.select(
        F.col("name").alias("corpus"), "description", F.col("deprecated").alias("corpus_deprecated")
    )
    q = questions.select(
        "corpus", F.col("id").alias("question_id"), "question", "qtype", "atype",
        F.col("deprecated").alias("question_deprecated"),
    )
    a = answers.select("corpus", F.col("question").alias("question_id"), F.col("id").alias("answer_id"), "answer")
    if names is not None:
        q = q.join(c.select("corpus"), "corpus", "left_semi")
        a = a.join(c.select("corpus"), "corpus", "left_semi")
    return attach_children(c, attach_children(q, a, ["corpus", "question_id"]), "corpus")


def list_corpora(corpora: DataFrame) -> DataFrame:
    return corpora.select("name", "description", "deprecated")


def cascade_delete(
    corpora: DataFrame, questions: DataFrame, answers: DataFrame, names: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the given corpora, their questions and those answers."""
    gone = names.select("name").distinct()
    in_corpus = gone.select(F.col("name").alias("corpus"))
    gone_questions = lookup_join(questions, in_corpus, "corpus", "left_semi").select(
        "corpus", F.col("id").alias("question")
    )
    return (
        lookup_join(corpora, gone, "name", "left_anti"),
        lookup_join(questions, in_corpus, "corpus", "left_anti"),
        lookup_join(answers, gone_questions, ["corpus", "question"], "left_anti"),
    )
