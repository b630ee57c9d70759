from __future__ import annotations

from conftest import rows

from corpusqa.operators import evaluation as ev
from corpusqa.operators import stats as st
from corpusqa.operators.snippets import split_snippets

CORPORA = "name string, description string, deprecated boolean"
QUESTIONS = "corpus string, id bigint, question string, qtype string, deprecated boolean"
ANSWERS = "corpus string, question bigint, id bigint, answer string"


def test_a_run_asks_and_scores(spark, tmp_path):
    docs = spark.createDataFrame(
        [("d1", "base", "zoo", "cats", "Cats purr because their larynx muscles move."), ("d2", "base", "zoo", "dogs", "Dogs bark loudly at strangers.")],
        "id string, corpus string, department string, module string, text string",
    )
    snippets = split_snippets(docs)
    corpora = spark.createDataFrame([("a", "", False), ("old", "", True), ("b", "", None)], CORPORA)
    questions = spark.createDataFrame(
        [
            ("a", 1, "Why do cats purr?", "why", False),
            ("a", 1, "Why do cats purr?", "why", False),  # there twice
            ("a", 2, "Why do dogs bark?", "why", None),
            ("a", 3, "Why do dogs bark?", "why", True),  # deprecated
            ("b", 1, "xyzzy plugh", None, False),  # finds nothing
            ("b", 2, None, "who", False),
            ("b", None, "Who does bark?", "who", False),
            ("old", 1, "Why do cats purr?", "why", False),  # of a deprecated corpus
            ("unknown", 1, "Why do cats purr?", "why", False),
            (None, 1, "Why do cats purr?", "why", False),
        ],
        QUESTIONS,
    )
    answers = spark.createDataFrame(
        # "zoo" stands in the line that names the source only
        [("a", 1, 1, "nothing"), ("a", 1, 2, "LARYNX"), ("a", 2, 1, "zoo"), ("a", 2, 2, ""), ("a", 2, 3, None), ("b", 1, 1, "bark"), ("b", None, 1, "strangers")],
        ANSWERS,
    )
    path = str(tmp_path / "runs")
    got = rows(ev.evaluate(corpora, questions, answers, snippets, 7, 1000, path, threshold=0.0))
    # corpus, run, total, completed, correct, candidates, incorrect, precision, recall, f1
    assert [r[:7] for r in got] == [("a", 7, 2, 2, 1, 2, 1), ("b", 7, 3, 3, 1, 1, 0)]
    stored = spark.read.parquet(path)
    assert rows(st.corpus_history(stored), "corpus", "run", "total") == [("a", 7, 2), ("b", 7, 3)]
    again = ev.evaluate(corpora, questions, answers, snippets, 7, 2000, path, names=spark.createDataFrame([("b",), ("b",), ("nobody",)], "name string"), threshold=0.0)
    assert [r[:3] for r in rows(again)] == [("b", 7, 3)]
    assert rows(spark.read.parquet(path), "corpus", "time") == [("b", 2000)] * 3  # replaced
    none = ev.ask_corpora(corpora, questions.limit(0), answers.limit(0), snippets, 1, 0)
    assert none.count() == 0
