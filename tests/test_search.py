from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpusqa.functions import text as tx
from corpusqa.operators import answers as an
from corpusqa.operators import entities as en
from corpusqa.operators import scoring as sc
from corpusqa.operators import search as se
from corpusqa.operators import stored_index as si
from corpusqa.operators import triples as tr


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [("1", "the red cat sat"), ("2", "red red dog"), ("3", "blue bird")], "id string, text string"
    )


def asked(spark, *words):
    return spark.createDataFrame([(1, list(words))], "qid int, words array<string>")


def classic(clauses, docs):
    n = len(docs)
    idf = {c: 1 + math.log(n / (sum(c in d for d in docs) + 1)) for c in set(clauses)}
    norm = math.sqrt(sum(idf[c] ** 2 for c in clauses))
    out = []
    for d in docs:
        hit = [c for c in clauses if c in d]
        total = sum(math.sqrt(d.count(c)) * idf[c] ** 2 / math.sqrt(len(d)) for c in hit)
        out.append(total * len(hit) / len(clauses) / norm)
    return out


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("salted", [False, True])
def test_scores_follow_the_formula(spark, docs, stored, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(se, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(si, "fits_broadcast", lambda df: False)
    index = se.build_index(docs, ["id"])
    if stored:
        index = si.write_index(index)
    clauses = ["red", "red", "cat", "nowhere"]
    got = {r["id"]: r["score"] for r in se.find_terms(index, asked(spark, *clauses), "qid", "words").collect()}
    want = classic(clauses, [r["text"].split() for r in docs.orderBy("id").collect()])
    assert got == {"1": pytest.approx(want[0]), "2": pytest.approx(want[1])}


def test_bm25_and_limit(spark, docs):
    index = se.build_index(docs, ["id"])
    hits = se.find_terms(index, asked(spark, "red"), "qid", "words", n=1, scoring="bm25").collect()
    assert [(r["id"], r["rank"]) for r in hits] == [("2", 1)]
    with pytest.raises(ValueError):
        se.find_terms(index, asked(spark, "red"), "qid", "words", scoring="other")


def test_search_entity(spark):
    entities = spark.createDataFrame(
        [("Edwin Jarvis of Iron Man", "Edwin_Jarvis"), ("Bat Man", "Bat_Man")], "key string, entity string"
    )
    q = spark.createDataFrame([(1, "Jarvis Iron Man")], "qid int, text string")
    assert se.search_entity(entities, q, "qid", "text").orderBy("rank").first()["entity"] == "Edwin_Jarvis"


def test_tied_entities_are_cut_where_they_are_scored(spark, monkeypatch):
    # many entities of one key: a task hands on the first of them, and its rows are bounded
    rows_ = [("Bat Man" if i % 3 else "Bat Man Bat", f"e{(i * 7) % 3000:04d}") for i in range(3000)]
    entities = spark.createDataFrame(rows_, "key string, entity string").coalesce(1)
    q = spark.createDataFrame([(1, "Bat Man"), (2, "Man")], "qid int, text string")
    handed, best = [], se.best_hits

    def told(hits, *rest):
        handed.append(hits.count())
        return best(hits, *rest)

    monkeypatch.setattr(se, "best_hits", told)
    monkeypatch.setattr(sc, "PART_ROWS", 1000)
    got = rows(se.search_entity(entities, q, "qid", "text", 4), "qid", "rank", "entity", "key")
    pairs = sorted((e, k) for k, e in rows_ if k == "Bat Man")[:4]
    want = [(qid, rank, e, k) for qid in (1, 2) for rank, (e, k) in enumerate(pairs, 1)]
    assert got == want
    assert handed[0] <= 2 * 4 * 4


GAZ = "surface string, uri string, label string, types array<string>, support int, score double"


@pytest.fixture(scope="module")
def gazetteer(spark):
    return spark.createDataFrame(
        [
            ("Barack Obama", "kb/Barack_Obama", "PER", ["Person"], 50, 0.9),
            ("Obama", "kb/Obama", "LOC", ["Town"], 50, 0.9),
            ("New York", "kb/New_York", "LOC", ["Town"], 50, 0.9),
            ("York City Hall", "kb/Hall", "ORG", ["Place"], 50, 0.9),
            ("him", "kb/him", "MISC", [], 3, 0.9),
            ("like", "kb/like", "MISC", [], 99, 0.2),
        ],
        GAZ,
    )


def test_links_have_true_offsets_and_longest_wins(spark, gazetteer):
    docs = spark.createDataFrame(
        [(1, "Barack Obama, I do not like him!"), (2, "In New  York City Hall sits Obama")], "id int, text string"
    )
    got = rows(en.link_entities(docs, gazetteer, "id"), "id", "uri", "start", "length")
    assert got == [(1, "<kb/Barack_Obama>", 0, 12), (2, "<kb/New_York>", 3, 9), (2, "<kb/Obama>", 28, 5)]


def test_clues(spark, gazetteer):
    docs = spark.createDataFrame([(1, "Obama and Obama"), (2, "nobody")], "id int, text string")
    done = en.attach_clues(docs, en.link_entities(docs, gazetteer, "id"), "id")
    got = {r["id"]: [c["start"] for c in r["clues"]] for r in done.collect()}
    assert got == {1: [0, 10], 2: []}
    again = en.attach_clues(done, en.link_entities(docs, gazetteer, "id"), "id")
    assert {r["id"]: len(r["clues"]) for r in again.collect()} == {1: 4, 2: 0}
    assert en.clear_clues(again).filter(F.size("clues") > 0).count() == 0


def test_question_entities_last_wins(spark, gazetteer):
    q = spark.createDataFrame([(1, "Is Obama in New York?"), (2, "Is it?")], "qid int, question string")
    got = {r["qid"]: r for r in en.question_entities(q, gazetteer, "qid").collect()}
    assert got[1]["entities"] == {"obama": "LOC", "new york": "LOC"}
    assert got[1]["last_entity"] == "new york"
    assert 2 not in got


def test_triples(spark):
    t = spark.createDataFrame(
        [
            ("Iron_Man", tr.RDF_TYPE, "Cartoon", ""),
            ("Bat_Man", tr.RDF_TYPE, "Cartoon", ""),
            ("Iron_Man", "http://x/ontology/name", "Iron Man", ""),
        ],
        "s string, p string, o string, lang string",
    )
    clause = t.filter(F.col("o").contains("Iron")).select("s")
    assert rows(tr.of_type(t, "Cartoon", clause)) == [("Iron_Man",)]
    assert rows(tr.of_type(t, "Cartoon")) == [("Bat_Man",), ("Iron_Man",)]
    assert rows(tr.entities_of_predicate(t, "name")) == [("Iron Man", "Iron_Man")]
    assert rows(tr.build_entity_index(t, ["name"])) == [("Iron Man", "Iron_Man")]


def test_outcomes(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    ranked = spark.createDataFrame(
        [(1, "a", 0, 0.41), (1, "b", 0, 0.1), (2, "a", 0, 0.40)], "qid int, id string, offset int, ranking double"
    )
    best = an.select_answer(ranked)
    got = rows(an.classify_outcome(questions, best), "qid", "status", "ranking")
    assert got == [(1, "answered", 0.41), (2, "no_answer", 1.0), (3, "failed", 0.0)]


def test_nan_ranking_is_no_answer(spark):
    ranked = spark.createDataFrame([(1, "a", 0, float("nan")), (1, "b", 0, 0.2)], "qid int, id string, offset int, ranking double")
    best = an.select_answer(ranked).first()
    assert (best["id"], best["accepted"]) == ("b", False)
    assert not an.select_answer(ranked.filter("id = 'a'")).first()["accepted"]


def test_ask(spark):
    snippets = spark.createDataFrame(
        [("1", 0, "aiv", "d", "m", "cats chase mice"), ("2", 0, "aiv", "d", "m", "dogs chase cars")],
        "id string, offset int, corpus string, department string, module string, text string",
    )
    got = an.ask("mice cats chase", snippets).collect()
    assert [(r["status"], r["id"]) for r in got] == [("answered", "1")]
    assert got[0]["answer"] == "[id: 1, corpus: aiv, department: d, module: m]\ncats chase mice"


def test_passages(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "b", "b"], "a x. a b. none here. \nb!"), (2, [], "a b.")], "id int, bow array<string>, text string"
    )
    got = sorted(
        (r["id"], r["passage"], round(r["ranking"], 4), r["offset"]) for r in an.extract_passages(docs, threshold=0.3).collect()
    )
    assert got == [(1, "a x.  a b.", 0.2222, 0), (1, "b!", 0.3333, 22)]


def test_passages_of_stored_sentences(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "".join(rng.choice(["a b", "c", "d a", ", b "]) + rng.choice([". ", "! ", "\n"]) for _ in range(rng.choice((0, 3, 40))))) for i in range(12)] + [(50, None)], "k int, text string")
    pairs = [(q, k, bag) for q, bag in ((1, ["a", "b", "b"]), (2, ["c"]), (3, []), (4, ["zzz"])) for k in (*range(12), 50, 77)]
    asked = spark.createDataFrame(pairs + pairs[:5], "qid int, k int, bow array<string>")
    got = an.find_passages(an.sentence_table(docs, "k"), asked, "k", threshold=0.3)
    want = an.extract_passages(docs.join(asked.distinct(), "k"), threshold=0.3)
    key = ["qid", "k", "passage", F.round("ranking", 9).alias("ranking"), "offset"]
    assert rows(got, *key) == rows(want, *key) and got.count()


def test_passages_of_equal_rows(spark):
    text = "a b. a b c. x y. b a. z."
    docs = spark.createDataFrame([(1, text, ["a", "b"])] * 2 + [(2, None, ["a"]), (3, text, [])], "k int, text string, bow array<string>")
    got = sorted((r["k"], r["passage"], r["ranking"], r["offset"]) for r in an.extract_passages(docs).collect())
    assert sorted((g[0], g[1].split()[0], g[2]) for g in got) == [(1, "a", 1.0)] * 2 + [(1, "b", 1.0)] * 2


def test_links_in_runs(spark):
    docs = spark.createDataFrame([(1, "a b c x b c d a")], "k int, text string")
    entries = [(s, f"u/{s}", "LOC", ["t"], 20, 0.9) for s in ("a b", "b c", "b c d", "c", "a")]
    names = spark.createDataFrame(entries, "surface string, uri string, label string, types array<string>, support int, score double")
    got = [(r["start"], r["surface_form"]) for r in en.link_entities(docs, names, "k").orderBy("start").collect()]
    assert got == [(0, "a b"), (4, "c"), (8, "b c d"), (14, "a")]


def test_stored_snippets_and_index_answer_alike(spark, tmp_path):
    rows_ = [(f"d{i}", "c", "dep", "mod", i * 10, f"word{i} cats purr {'loud' * (i % 3)} because{i}") for i in range(30)]
    snippets = spark.createDataFrame(rows_, "id string, corpus string, department string, module string, offset int, text string")
    asked = spark.createDataFrame([(1, "Why word3 cats"), (2, "zebra")], "qid long, question string")
    plain = rows(an.ask_batch(asked, snippets, threshold=0.0))
    stored = an.write_snippets(snippets, str(tmp_path / "s"))
    index = si.write_index(se.build_index(snippets, an.SNIPPET_KEYS), str(tmp_path / "i"))
    assert rows(an.ask_batch(asked, stored, index=index, threshold=0.0)) == plain
    assert rows(se.find_terms(index, asked.selectExpr("qid", "array('cats', 'word3') AS w"), "qid", "w", scoring="bm25")) == rows(
        se.find_terms(se.build_index(snippets, an.SNIPPET_KEYS), asked.selectExpr("qid", "array('cats', 'word3') AS w"), "qid", "w", scoring="bm25"))


def random_docs(seed, n):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["of"] * 12 + [f"w{i % 40}" for i in range(60)] + [f"rare{i}" for i in range(50)]
    return [(i, " ".join(rng.choices(words, k=rng.choice((1, 2, 5, 30, 120)))) if i % 17 else None) for i in range(n)]


@pytest.mark.parametrize("scoring", ["classic", "bm25"])
@pytest.mark.parametrize("seed", [1, 2])
def test_score_bounds_lose_no_hit(spark, seed, scoring):
    docs = spark.createDataFrame(random_docs(seed, 400), "id long, text string")
    questions = [(1, ["the", "rare3", "rare4", "w5"]), (2, ["the", "of"]), (3, ["w1", "w2", "w2", "the", "rare9"]), (4, ["nowhere"]), (5, ["rare1"]), (6, [])]
    questions = spark.createDataFrame(questions, "qid long, words array<string>")
    index = se.build_index(docs, ["id"])
    for n in (1, 7, 100):
        want = se.find_terms(index, questions, "qid", "words", n, scoring)
        got = se.find_terms(si.write_index(index), questions, "qid", "words", n, scoring)
        key = ["qid", "id", F.round("score", 9).alias("score"), "rank"]
        assert rows(got, *key) == rows(want, *key)


def test_a_common_word_is_hardly_read(spark):
    rng = random.Random(4)
    texts = [" ".join(["the"] * rng.choice((1, 2, 3)) + [f"x{rng.randrange(3000)}" for _ in range(rng.choice((20, 60, 200)))]) for _ in range(3000)]
    texts += [f"the needle in the hay {i} " + "pin " * (i % 7) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    questions = spark.createDataFrame([(1, ["the", "needle", "pin"])], "qid long, words array<string>")
    index = se.build_index(docs, ["id"])
    stored = si.write_index(index)
    assert rows(se.find_terms(stored, questions, "qid", "words", 10)) == rows(se.find_terms(index, questions, "qid", "words", 10))
    read = {r["term"]: (r["df"], r["read"]) for r in si.postings_read(stored, se.clauses(questions, "qid", "words"), "qid", 10).collect()}
    assert read["the"][0] == 3040 and read["the"][1] * 5 < read["the"][0]


def test_segments(spark, tmp_path):
    first, later = random_docs(5, 200), random_docs(6, 260)
    index = si.write_index(se.build_index(spark.createDataFrame(first, "id long, text string"), ["id"]), str(tmp_path / "i"))
    assert not si.has_index(spark, str(tmp_path / "none")) and si.has_index(spark, str(tmp_path / "i"))
    # 60 new documents, 100 replaced, 20 deleted, unknown ones ignored
    index = si.add_documents(index, spark.createDataFrame(later[100:], "id long, text string"))
    index = si.delete_documents(index, spark.createDataFrame([(i,) for i in [*range(20), 9999]], "id long"))
    assert si.delete_documents(index, spark.createDataFrame([(5,)], "id long")).segments == index.segments
    now = first[20:100] + later[100:]
    whole = se.build_index(spark.createDataFrame(now, "id long, text string"), ["id"])
    questions = spark.createDataFrame([(1, ["the", "rare3", "w5"]), (2, ["of", "w7"])], "qid long, words array<string>")
    key = ["qid", "id", F.round("score", 9).alias("score"), "rank"]
    for scoring in ("classic", "bm25"):
        want = rows(se.find_terms(whole, questions, "qid", "words", 30, scoring), *key)
        for stored in (index, si.read_index(spark, str(tmp_path / "i")), si.merge_segments(index)):
            assert rows(se.find_terms(stored, questions, "qid", "words", 30, scoring), *key) == want
    assert rows(index.frequencies, "field", "term", "df") == rows(se.document_frequency(whole), "field", "term", "df")
    # a segment that was not finished is not there
    spark.range(3).selectExpr("id", "'text' AS field", "1 AS length", "array(struct('the' AS term, 1 AS tf)) AS terms").write.parquet(str(tmp_path / "i" / "documents" / "segment=9"))
    assert rows(index.total) == rows(si.read_index(spark, str(tmp_path / "i")).total) == [(len(now),)]
    assert si.read_index(spark, str(tmp_path / "i")).documents.count() == len(now)


def gazetteer_of(spark, surfaces):
    rows_ = [(x, f"u{i}", "LOC", ["LOC"], 50, 0.9) for i, x in enumerate(surfaces)]
    return spark.createDataFrame(rows_, "surface string, uri string, label string, types array<string>, support int, score double")


def test_only_beginnings_of_surfaces_become_runs(spark):
    rng = random.Random(1)
    words = ["New", "York", "Times", "Square", "Garden", "City", "the", "of", "a"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(30)] + [(99, None), (98, "")], "k int, text string")
    surfaces = ["New York", "New York Times Square", "New York Times", "City of the New York Garden City", "Square"]
    long_one = " ".join(["New", "York"] + ["zz"] * 198)
    runs = {}
    for name, extra in (("short", []), ("long", [long_one])):
        entries = en.gazetteer_keys(gazetteer_of(spark, surfaces + extra))
        assert len(en.prefix_tables(entries)) == (8 if extra else 3)
        runs[name] = rows(en.candidate_runs(docs, entries, "k"), "k", "at", "n", "_key")
    assert runs["short"] == runs["long"]  # a surface of 200 tokens adds no run
    texts = {r["k"]: (r["text"] or "").split() for r in docs.collect()}
    # of a run of four tokens the first two are a beginning, too
    begins = [s.split() for s in surfaces]
    for k, at, n, run in runs["short"]:
        assert texts[k][at : at + n] == run.split()
        assert any(b[:1] == run.split()[:1] and len(b) == n and b[: 1 << (n.bit_length() - 1)] == run.split()[: 1 << (n.bit_length() - 1)] for b in begins)
    whole = {(k, i, len(b)) for k, t in texts.items() for b in begins for i in range(len(t)) if t[i : i + len(b)] == b}
    assert whole <= {r[:3] for r in runs["short"]}


def test_links_against_brute_force(spark):
    rng = random.Random(3)
    words = ["A", "B", "C", "d", "e"]
    surfaces = sorted({" ".join(rng.choices(words[:4], k=rng.choice((1, 2, 3, 5, 9)))) for _ in range(25)})
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(10)]
    got = rows(en.link_entities(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), gazetteer_of(spark, surfaces), "k"), "k", "start", "surface_form")
    want = []
    for k, t in enumerate(texts):
        toks, at = t.split(), 0
        while at < len(toks):
            fit = max((s for s in surfaces if toks[at : at + len(s.split())] == s.split()), key=lambda s: len(s.split()), default=None)
            if fit:
                want.append((k, 2 * at, fit))
            at += len(fit.split()) if fit else 1
    assert got == sorted(want)


@pytest.mark.parametrize("scoring", ["classic", "bm25"])
def test_rows_score_like_joined_postings(spark, scoring, monkeypatch):
    draw = random.Random(5)
    text = lambda: " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 12)))
    docs = spark.createDataFrame([(i % 50, text(), text()) for i in range(60)] + [(None, "a b", "c")], "id int, text string, topic string")
    index = se.build_index(docs, ["id"], {"text": "text", "topic": "topic"})
    asked_ = spark.createDataFrame([(q, [draw.choice("abcdefghx") for _ in range(4)], ["a", "h"]) for q in range(8)], "qid int, words array<string>, topics array<string>")
    clauses = se.clauses(asked_, "qid", "words").unionByName(se.clauses(asked_, "qid", "topics", "topic"))
    found = lambda: [(r[0], r[1], round(r[2], 9), r[3]) for r in rows(se.search(index, clauses, "qid", 7, scoring).select("qid", F.coalesce("id", F.lit(-1)), "score", "rank"))]
    by_row = found()
    joined = []
    monkeypatch.setattr(se.sc, "fits", lambda *a: joined.append(1) or False)
    assert by_row == found() and joined and len(by_row) == 56


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    docs = spark.range(400, numPartitions=2).select("id", F.lit("the same words for all").alias("text"), )
    docs = docs.withColumn("text", F.concat_ws(" ", "text", F.repeat(F.lit("x "), (F.col("id") % 40).cast("int"))))
    asked_ = spark.range(20).select(F.col("id").alias("qid"), F.array(F.lit("the"), F.lit("same")).alias("words"))
    grouped = se.clauses(asked_, "qid", "words").groupBy("qid", "field", "term").agg(F.count(F.lit(1)).alias("_m"))
    scored = se._score_rows(se.build_index(docs, ["id"]), grouped, "qid", 3, "classic")
    assert scored.count() < 20 * 400 / 4  # of 8,000 pairs


def test_open_documents_score_in_their_rows(spark, monkeypatch):
    draw = random.Random(3)
    text = lambda: " ".join(["the"] * draw.randint(1, 9) + [draw.choice("abcdefgh") for _ in range(draw.randint(1, 20))])
    docs = [(i, text()) for i in range(300)]
    index = si.write_index(se.build_index(spark.createDataFrame(docs + docs[:20], "id int, text string"), ["id"]))
    asked_ = spark.createDataFrame([(q, ["the", draw.choice("abcd"), draw.choice("efgh")]) for q in range(6)], "qid int, words array<string>")
    found = lambda: [(r[0], r[1], round(r[2], 9), r[3]) for r in rows(se.find_terms(index, asked_, "qid", "words", n=3))]
    scored, best = [], si.sc.best_scores
    monkeypatch.setattr(si.sc, "best_scores", lambda *a: scored.append(1) or best(*a))
    by_row = found()
    monkeypatch.setattr(si.sc, "fits", lambda *a: False)
    assert scored and by_row == found()


def test_texts_are_linked_in_their_rows(spark, monkeypatch):
    # as by joins: long surfaces, blanks of all kinds, joined words, characters beyond the first plane
    words = ["New", "York", "City", "the", "O'Neil", "x-Ray", "É", "\U0001d400B", "\U0001f600", "—", "Été", "11", "Ǆ"]
    rng = np.random.default_rng(3)
    blanks = [" ", "  ", "\n", "\t ", " ", "", ","]
    text = lambda: "".join(words[rng.integers(len(words))] + blanks[rng.integers(len(blanks))] for _ in range(40))
    docs = spark.createDataFrame([(i, text()) for i in range(60)] + [(60, None), (61, ""), (62, " New York \n ")], "k long, text string")
    surfaces = ["New York", "York", "New York City New", "O'Neil", "É Été", "Été"]
    taken = []
    joined = en._link_joined
    monkeypatch.setattr(en, "_link_joined", lambda *a: taken.append(1) or joined(*a))
    monkeypatch.setattr(en, "BLOCK_TOKENS", 50)
    for more in ([], ["the", "x-Ray York", "11 the"]):
        gaz = spark.createDataFrame([(s, f"http://{i}", "LOC", ["LOC"], 20, 0.9) for i, s in enumerate(surfaces + more)],
                                    "surface string, uri string, label string, types array<string>, support int, score double")
        with monkeypatch.context() as m:
            m.setattr(en, "fits_broadcast", lambda df: False)
            want = rows(en.link_entities(docs, gaz, "k"))
        taken.clear()
        assert len(want) > 50 and rows(en.link_entities(docs, gaz, "k")) == want and not taken
        # rows of one key compete, and so do those without one
        again = docs.withColumn("k", F.when(F.col("k") % 7 == 0, None).otherwise(F.floor(F.col("k") / 2) * F.when(F.col("k") < 20, 1).otherwise(2) + F.col("k") % 2))
        with monkeypatch.context() as m:
            m.setattr(en, "fits_broadcast", lambda df: False)
            want = sorted(map(repr, en.link_entities(again, gaz, "k").collect()))
        taken.clear()
        assert sorted(map(repr, en.link_entities(again, gaz, "k").collect())) == want and taken


def test_capitalised_tokens_are_counted(spark):
    words = ["New", "York", "the", "O'Neil", "x-Ray", "a-B", "'B", "\U0001d400b", "\U0001d552B", "\U0001f600A", "Éa", "11", "ǅa"]
    rng = np.random.default_rng(4)
    texts = ["".join(words[rng.integers(len(words))] + [" ", "\n ", "", " "][rng.integers(4)] for _ in range(30)) for _ in range(50)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("no one",)], "text string")
    # token by token
    tok = docs.select(F.transform(tx.tokens(F.col("text")), lambda w: F.struct(w.alias("w"), w.rlike(r"^\p{Lu}").alias("big"))).alias("t"))
    want = {}
    for r in tok.filter("t IS NOT NULL").collect():
        for i, x in enumerate(r["t"]):
            for s in [x["w"]] + ([f"{r['t'][i - 1]['w']} {x['w']}"] if i and r["t"][i - 1]["big"] else []):
                if x["big"]:
                    want[s] = want.get(s, 0) + 1
    assert dict(rows(en.capital_counts(docs))) == want and len(want) > 20
