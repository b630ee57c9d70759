"""Question analysis: type, answer type, topic, focus, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import text as tx
from corpusqa.operators.entities import question_entities


def topic(entities: Column) -> Column:
    """Entity surfaces of a question."""
    return F.map_keys(entities)


def analyze_questions(
    questions: DataFrame, gazetteer: DataFrame | None = None, qid: str = "qid", text: str = "question"
) -> DataFrame:
    """One row per question: bag of words, tags, type, answer type, topics, focus, entities."""
    closed = questions.select(qid, tx.terminate_question(F.col(text)).alias("question"))
    split = closed.withColumn("bow", tx.tokens(F.col("question")))
    if gazetteer is None:
        found = split.withColumn("entities", F.create_map().cast("map<string,string>"))
        found = found.withColumn("last_label", F.lit(None).cast("string")).withColumn(
            "last_entity", F.lit(None).cast("string")
        )
    else:
        entities = question_entities(closed, gazetteer, qid, "question")
        found = split.join(entities, qid, "left").withColumn(
            "entities", F.coalesce("entities", F.create_map().cast("map<string,string>"))
        )
    bow = F.col("bow")
    return found.select(
        qid,
        "question",
        "bow",
        F.transform(bow, tx.token_tag).alias("tags"),
        tx.question_type(bow).alias("qtype"),
        tx.answer_type(F.col("last_label")).alias("atype"),
        F.when(F.col("last_label") == "ORG", F.col("last_entity")).alias("atype_entity"),
        topic(F.col("entities")).alias("topics"),
        tx.focus(bow).alias("focus"),
        "entities",
    )
