from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpusqa.operators import pairs
from corpusqa.operators import profile as pf
from corpusqa.operators import tables as tb


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_word_count_and_frequency(spark):
    d = docs(spark, "hello hello my friend.")
    assert rows(pf.word_count(d)) == [(".", 1), ("friend", 1), ("hello", 2), ("my", 1)]
    got = {r["token"]: r["frequency"] for r in pf.word_frequency(d).collect()}
    assert got == {"hello": 0.4, "my": 0.2, "friend": 0.2, ".": 0.2}
    assert pf.word_frequency_per_document(d, "doc_id").agg(F.sum("frequency")).first()[0] == pytest.approx(1.0)


def test_sentence_pairs(spark):
    assert rows(pf.cooc_sentence(docs(spark, "foo bar baz? baz bar!"))) == [
        ("bar", "baz", 2), ("bar", "foo", 1), ("baz", "foo", 1)]
    assert rows(pf.cooc_sentence(docs(spark, "a b a c"))) == [("a", "b", 2), ("a", "c", 2), ("b", "c", 1)]


def test_sentence_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pf, "PAIR_BLOCK", 4)
    words = [f"w{i % 23}" for i in range(60)]
    text = " ".join(words) + ". " + "a b. " * 5
    got = {(a, b): n for a, b, n in rows(pf.cooc_sentence(docs(spark, text, text)))}
    tf = Counter(words)
    want = {(a, b): 2 * tf[a] * tf[b] for a in tf for b in tf if a < b}
    want[("a", "b")] = 10
    assert got == want


def test_adjacent_pairs(spark):
    assert rows(pf.cooc_adjacent(docs(spark, "what should we do. we do not know."))) == [
        ("do", "not", 1), ("do", "we", 2), ("know", "not", 1), ("should", "we", 1), ("should", "what", 1)]
    assert rows(pf.cooc_adjacent(docs(spark, "a b b c"))) == [("a", "b", 1)]
    assert rows(pf.cooc_adjacent(docs(spark, "a b b c"), stop_on_repeat=False)) == [("a", "b", 1), ("b", "c", 1)]
    assert rows(pf.cooc_adjacent(docs(spark, "a", ""))) == []


def test_profile_sections_agree_with_single_operators(spark):
    d = docs(spark, "One two. Two three!", "one").withColumn("dep", F.lit("d")).withColumn("mod", F.lit(None).cast("string"))
    prof = pf.corpus_profile(d, "dep", "mod", sentence_cooc=True)
    section = lambda s: rows(prof.filter(F.col("section") == s), "key", "count")
    low = d.withColumn("text", F.lower("text"))
    assert section("word") == rows(pf.word_count(low))
    assert section("general") == [("docs", 2)]
    assert section("module") == [("", 2)]
    assert section("word_pair") == [(f"{a},{b}", n) for a, b, n in rows(pf.cooc_adjacent(low))]
    assert section("sentence_pair") == [(f"{a},{b}", n) for a, b, n in rows(pf.cooc_sentence(low))]


def test_tag_table_of_another_tagger(spark):
    tags = spark.createDataFrame([("cat", "NN")], "token string, tag string")
    got = rows(pf.tag_counts(docs(spark, "Who saw the cat"), tags=tags))
    assert got == [("NN", "cat", 1), ("NP", "saw", 1), ("SW", "the", 1), ("WP", "who", 1)]


def test_counts_merge_on_cut_keys(spark):
    old = spark.createDataFrame([("word", "x" * 250 + "a", 2)], "section string, key string, count bigint")
    new = spark.createDataFrame([("word", "x" * 250 + "b", 3)], "section string, key string, count bigint")
    assert rows(tb.upsert_counts(old, new)) == [("word", "x" * 250 + "a", 2), ("word", "x" * 250 + "b", 3)]
    assert rows(tb.upsert_counts(old, new, key_chars=250)) == [("word", "x" * 250, 5)]


def test_report_and_count_files(spark, tmp_path):
    d = docs(spark, "b a. a").withColumn("dep", F.lit("d")).withColumn("mod", F.lit("m"))
    prof = pf.corpus_profile(d, "dep", "mod")
    tb.write_profile_report(prof, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert {"# Documents;1", "# Words;4", "# Unique Words;3", "Department;count", "word;frequency;count", "a;0.500000;2"} <= set(lines)
    tb.write_kv_csv(prof, str(tmp_path / "kv"))
    assert "a;2" in {r["value"] for r in spark.read.text(str(tmp_path / "kv" / "section=word")).collect()}
    tb.overwrite_counts(prof, str(tmp_path / "counts"))
    assert spark.read.parquet(str(tmp_path / "counts")).count() == prof.count()


def test_pairs_of_a_long_sentence(spark):
    words = [f"w{i:04d}" for i in range(400)] + ["w0000", "w0399"]
    docs = spark.createDataFrame([(" ".join(words),), (" ".join(words),), ("w0001 w0000",)], "text string")
    got = {(r["first"], r["second"]): r["count"] for r in pf.cooc_sentence(docs).collect()}
    assert len(got) == 400 * 399 // 2
    assert got["w0000", "w0001"] == 2 * 2 + 1 and got["w0000", "w0399"] == 2 * 4 and got["w0005", "w0300"] == 2


def test_long_sentences_in_blocks_and_cells(spark, monkeypatch):
    texts = ["c b a b d e a f g", "b a c b! a b", "x y", "c b a b d e a f g", None]
    frame = spark.createDataFrame([(i % 2 or None, t) for i, t in enumerate(texts)], "corpus int, text string")
    want = Counter()
    for corpus, text in [(r["corpus"], r["text"]) for r in frame.collect() if r["text"]]:
        for sentence in text.split("!"):
            tf = Counter(sentence.split())
            want.update({(corpus, a, b): tf[a] * tf[b] for a in tf for b in tf if a < b})
    for block, cell in ((2048, 1 << 22), (3, 4)):
        monkeypatch.setattr(pf, "PAIR_BLOCK", block)
        monkeypatch.setattr(pairs, "CELL_PAIRS", cell)
        monkeypatch.setattr(pairs, "BLOCK_WORDS", 2 * block)
        got = pf.cooc_sentence(frame, keys=["corpus"]).collect()
        assert {(r["corpus"], r["first"], r["second"]): r["count"] for r in got} == want and len(got) == len(want)


def test_pairs_travel_as_numbers_of_cells(spark):
    # a row for each block of texts and cell, not for each pair
    words = [f"w{i:03d}" for i in range(300)]
    frame = spark.createDataFrame([(words, 1, 0, -1)] * 3, "_words array<string>, _copies long, _group long, _split int").coalesce(1)
    batches = [pa.RecordBatch.from_pylist([r.asDict() for r in frame.collect()])]
    (cell,) = pairs._count(iter(batches), None, None, 1)
    assert cell.num_rows == 1 and len(cell["a"][0]) == 300 * 299 // 2 and len(cell["words"][0]) == 300


def test_report_reads_its_profile_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    d = docs(spark, "Who b a. a").select("doc_id", "text", F.lit("d").alias("dep"), F.lit("m").alias("mod"))
    read = d.mapInArrow(count, d.schema)
    got = {r["row"] for r in tb.profile_report(pf.corpus_profile(read, "dep", "mod")).collect()}
    assert {"# Documents;1", "# Words;5", "# Unique Words;4", "SW,a;2", "WP,who;1"} <= got
    assert seen.value == 1
