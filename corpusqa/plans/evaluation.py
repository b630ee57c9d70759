"""Corpora asked and scored in one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusqa.operators import evaluation as ev
from corpusqa.operators import stats as st
from corpusqa.plans import data as d
from corpusqa.plans.answers import _ASK
from corpusqa.plans.records import _corpora, _rounded
from corpusqa.plans.registry import query
from corpusqa.session import new_folder

_RUN, _TIME = 3, 1704844800000


def _asked(spark, sf):
    """The benchmark's questions as those of corpora; each tenth is deprecated."""
    return d.questions(spark, sf).select(
        F.concat(F.lit("src"), (F.col("qid") % 7).cast("string")).alias("corpus"),
        F.col("qid").alias("id"),
        "question",
        F.lower(F.element_at(F.split("question", " "), 1)).alias("qtype"),
        (F.col("qid") % 10 == 9).alias("deprecated"),
    )


def _gold(spark, sf):
    """The third and the seventh word of a benchmark text as accepted answers."""
    words = F.split("text", " ")
    texts = d.table(spark, sf, "benchmark").select("item_id", F.posexplode(F.array(F.get(words, F.lit(2)), F.get(words, F.lit(6)))).alias("id", "answer"))
    return texts.select(F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("corpus"), F.col("item_id").alias("question"), "id", "answer")


_RUN_SQL = f"""{_ASK},
gold AS (SELECT item_id AS qid, unnest([string_split(text, ' ')[3], string_split(text, ' ')[7]]) AS gold FROM benchmark),
matched AS (SELECT DISTINCT qid FROM outcome JOIN gold USING (qid)
  WHERE status = 'answered' AND gold <> '' AND contains(lower(substr(answer, instr(answer, chr(10)) + 1)), lower(gold))),
verdicts AS (SELECT 'src' || (qid % 7) AS corpus, {_RUN} AS run, qid AS question_id, lower(string_split(question, ' ')[1]) AS qtype, {_TIME} AS time,
    status = 'answered' AS finished, status = 'answered' AS answered, CASE WHEN status = 'failed' THEN 0 ELSE 1 END AS candidates,
    qid IN (SELECT qid FROM matched) AS correct
  FROM questions JOIN outcome USING (qid) WHERE qid % 10 <> 9 AND 'src' || (qid % 7) IN (SELECT source FROM documents))"""


@query(f"WITH {_RUN_SQL} SELECT * FROM verdicts")
def ask_corpora(spark, sf):
    return ev.ask_corpora(_corpora(spark, sf), _asked(spark, sf), _gold(spark, sf), d.snippets(spark, sf), _RUN, _TIME)


def _measured_sql(keys: str) -> str:
    return f"""WITH {_RUN_SQL},
counted AS (SELECT {keys}, count(*) AS total, count(finished) AS completed, count(*) FILTER (WHERE answered AND correct) AS correct,
    count(*) FILTER (WHERE candidates > 0) AS candidates, count(*) FILTER (WHERE answered AND NOT correct) AS incorrect FROM verdicts GROUP BY {keys}),
rates AS (SELECT *, CASE WHEN correct + incorrect > 0 THEN correct / (correct + incorrect) ELSE 0 END AS p, correct / total AS r FROM counted)
SELECT {keys}, total, completed, correct, candidates, incorrect, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM rates"""


@query(_measured_sql("corpus, run"))
def evaluate(spark, sf):
    return _rounded(
        ev.evaluate(_corpora(spark, sf), _asked(spark, sf), _gold(spark, sf), d.snippets(spark, sf), _RUN, _TIME, new_folder(spark, "runs"))
    )


@query(_measured_sql("qtype"))
def evaluate_types(spark, sf):
    """The same run by type of question, from its stored verdicts."""
    path = new_folder(spark, "runs")
    ev.evaluate(_corpora(spark, sf), _asked(spark, sf), _gold(spark, sf), d.snippets(spark, sf), _RUN, _TIME, path)
    return _rounded(st.measures(spark.read.parquet(path), ["qtype"]))
