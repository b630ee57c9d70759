from __future__ import annotations

import random

from pyspark.sql import functions as F

from conftest import rows
from corpusqa.functions import text as tx
from corpusqa.operators import snippets as sn
from corpusqa.plans import data
from corpusqa.sources import wiki


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_tokens_keep_case_and_punctuation(spark):
    assert one(spark, "Don't stop, Ünal-Öz!", tx.tokens) == ["Don't", "stop", ",", "Ünal-Öz", "!"]


def test_bag_of_words(spark):
    text = "hello world, who are you? hello world. who are you!"
    assert set(one(spark, text, tx.bag_of_words)) == {"hello", "world", "who", "are", "you", ",", "?", "!", "."}


def test_stopwords_are_case_sensitive_and_keep_duplicates(spark):
    out = one(spark, "The the cat cat", lambda c: tx.without_stopwords(tx.tokens(c)))
    assert out == ["The", "cat", "cat"]
    assert one(spark, "the cat", lambda c: tx.without_stopwords(tx.tokens(c), [])) == ["the", "cat"]


def test_terminate_question(spark):
    for given, wanted in (("Why?", "Why?"), ("Stop!", "Stop!"), ("It is.", "It is."), ("why is it", "why is it?")):
        assert one(spark, given, tx.terminate_question) == wanted


def test_wh_types(spark):
    assert one(spark, "Why is it?", tx.wh_types) == ["Why1"]
    assert one(spark, "So, how can I?", tx.wh_types) == ["How", "Can"]
    assert one(spark, "I don't know why?", tx.wh_types) == ["Why", "Not"]


def test_question_type_and_focus(spark):
    assert one(spark, "In which town is it?", lambda c: tx.question_type(tx.tokens(c))) == "which"
    assert one(spark, "Name it.", lambda c: tx.question_type(tx.tokens(c))) == "other"
    assert one(spark, "Who is Iron Man, the hero?", lambda c: tx.focus(tx.tokens(c))) == ["Iron Man", "hero"]


def test_prefix_sums_over_block_borders(spark):
    values = [random.Random(1).randint(0, 9) for _ in range(1000)]
    df = spark.createDataFrame([(values,), ([],), ([5],)], "v array<int>")
    got = [r["s"] for r in df.select(tx.prefix_sums(F.col("v")).alias("s")).collect()]
    sums = [sum(values[: i + 1]) for i in range(len(values))]
    assert got == [sums, [], [5]]


def test_located_tokens_point_into_the_text(spark):
    text = "A  b,\ncäd ef.\n\n" * 50
    for piece, start in one(spark, text, tx.located_tokens):
        assert text[start : start + len(piece)] == piece
    for piece, start in one(spark, text, tx.located_sentences):
        assert text[start : start + len(piece)] == piece


def test_term_frequencies(spark):
    got = one(spark, "b a b c b", lambda c: tx.term_frequencies(F.split(c, " ")))
    assert [tuple(r) for r in got] == [("a", 1), ("b", 3), ("c", 1)]


def test_snippet_windows(spark):
    def words(n, last="ww"):
        return " ".join([f"w{i}" for i in range(n - 1)] + [last]) if n else ""

    cases = [(0, "", [0]), (100, "ww", [0]), (101, "x", [0]), (101, "ww", [0, 75]), (250, "ww", [0, 75, 150]),
             (251, "ww", [0, 75, 150, 225])]
    df = spark.createDataFrame([(i, words(n, last)) for i, (n, last, _) in enumerate(cases)], "id int, text string")
    got = {}
    for r in sn.split_snippets(df).collect():
        got.setdefault(r["id"], []).append((r["offset"], r["text"]))
    for i, (n, last, starts) in enumerate(cases):
        text = words(n, last)
        found = sorted(got[i])
        assert [len(text[:o].split(" ")) - 1 if o else 0 for o, _ in found] == starts
        for offset, snippet in found:
            assert text[offset : offset + len(snippet)] == snippet
        assert found[-1][0] + len(found[-1][1]) == len(text)


def test_chunks_against_plain_fold(spark):
    rng = random.Random(7)
    texts = [" ".join("x" * rng.randint(0, 40) for _ in range(rng.randint(0, 300))) for _ in range(20)] + ["y" * 900, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows(sn.chunk_by_chars(df, max_chars=100), "id", "offset", "chunk")
    want = []
    for i, text in enumerate(texts):
        chunk, offset = "", 0
        for word in text.split(" "):
            if len(word) + len(chunk) > 100:
                want.append((i, offset, chunk))
                offset, chunk = offset + len(chunk) + 1, word
            else:
                chunk = chunk + " " + word
        if chunk:
            want.append((i, offset, chunk))
    assert got == sorted(want)


def test_word_blocks_and_lines(spark):
    df = spark.createDataFrame([(1, "(a) b. c, -- d"), (2, "...")], "id int, text string")
    got = [(r["id"], r["label"], r["words"]) for r in sn.word_blocks(df, size=3).orderBy("id", "block").collect()]
    assert got == [(1, "SENT_1", ["a", "b", "c"]), (1, "SENT_2", ["d"])]
    lines = spark.createDataFrame([(1, "a b c d e")], "id int, text string")
    assert rows(sn.word_lines(lines, size=2), "line_no", "line") == [(1, "a b"), (2, "c d"), (3, "e")]


def test_epochs_split_all_lines(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "d")], "id int, text string")
    halves = [rows(sn.sample_lines(df, "id", e), "id", "line_no") for e in (0, 1)]
    assert sorted(halves[0] + halves[1]) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert not set(halves[0]) & set(halves[1])
    assert rows(sn.sample_lines(df, "id", 2, 1.0)) == rows(sn.sample_lines(df, "id", 3, 1.0))


def test_wiki_text(spark):
    markup = "a [[File|The Cat]] {{box}} &lt;ref&gt;x&lt;/ref&gt; Größe 2"
    assert one(spark, markup, tx.spell_wiki) == " a the cat groe e two "


def test_sample_passage(spark):
    assert one(spark, "x#a#b#c#d#e", tx.sample_passage) == "#a#b#c#d#"
    assert one(spark, "x#a#b", tx.sample_passage) is None


def test_lines_are_written(spark, tmp_path):
    lines = wiki.articles_to_lines(spark.createDataFrame([("a b, c",), ("d",)], "text string"))
    wiki.write_lines(lines, str(tmp_path))
    assert rows(spark.read.text(str(tmp_path))) == [("a b , c",), ("d",)]


def test_cuts_of_odd_texts(spark):
    rng = random.Random(2)
    texts = ["", " ", "\n", "x" * 30, "x" * 30 + " b", "b " + "x" * 30, "a b  c", "a " * 40 + "x" * 25 + "  ", "\n".join(["a b c"] * 50), "word\n" * 40]
    texts += [" ".join("y" * rng.randrange(0, 14) for _ in range(rng.randrange(1, 60))) + "\n" * rng.randrange(3) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id int, text string")

    def chunks(text, most):
        out, chunk, offset = [], "", 0
        for w in text.split(" "):
            w = w.strip("".join(map(chr, range(33))))
            if len(w) + len(chunk) > most:
                out.append((offset, chunk))
                offset, chunk = offset + len(chunk) + 1, w
            else:
                chunk += " " + w
        return out + [(offset, chunk)] if chunk else out

    def lines(text, most):
        out, line, spaces = [], "", 0
        for record in text.split("\n"):
            line, spaces = line + record, spaces + record.count(" ")
            if spaces > most:
                out.append(line)
                line, spaces = "", 0
        return out + [line] if line else out

    got = sn.chunk_by_chars(df, max_chars=20)
    assert rows(got, "id", "offset", "chunk") == sorted((i, o, c) for i, t in enumerate(texts) for o, c in chunks(t, 20))
    for most in (0, 3):
        got = sn.pack_by_spaces(df, max_spaces=most)
        assert rows(got, "id", "line_no", "line") == sorted((i, n, x) for i, t in enumerate(texts) for n, x in enumerate(lines(t, most)))


def test_cuts_of_one_long_text(spark):
    # breaks beyond several blocks of places
    df = spark.createDataFrame([(1, "\n".join(f"{i} x y" for i in range(5000)))], "id int, text string")
    assert sn.pack_by_spaces(df, max_spaces=1).count() == 5000
    assert sn.chunk_by_chars(df, max_chars=5).count() > 4000


def test_terms_are_the_tokens_with_a_letter_or_digit(spark):
    texts = ["It's «rock-'n'-roll», 3-4 a--b -x x- ’s d’été 𝟙𐐷! 日本  nbsp é", "...", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.filter(tx.tokens(F.lower("text")), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    got = frame.select(tx.terms(F.col("text")).alias("terms"), plain.alias("plain")).collect()
    assert all(r["terms"] == r["plain"] for r in got) and len(got[0]["terms"]) > 8
    # read off at once: no test for each token
    assert "rlike" not in tx.terms(F.col("text"))._jc.toString().lower()


def test_gazetteer_takes_capitalised_words_and_pairs(spark, tmp_path):
    frame = spark.createDataFrame([(1, "The Big cat. Éa Big Big-X a B"), (2, None), (3, "")], "doc_id bigint, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["surface"]: r["support"] for r in data.gazetteer(spark, str(tmp_path)).collect()}
    assert got == {"The": 1, "The Big": 1, "Big": 2, "Éa": 1, "Éa Big": 1, "Big Big-X": 1, "Big-X": 1, "B": 1}
