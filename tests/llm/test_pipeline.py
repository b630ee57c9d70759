"""The pipeline, and the queries that have SQL, on the small tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from test_pairs_and_passages import WORD, brute_components, brute_removed

import corpus_pipeline
from check_oracle import compare
from corpusqa.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, note = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "12 34 !!", "en", "s", 8), (None, "The text of a row without an id.", None, "s", 3)]
    copy = docs.filter("doc_id = 3").withColumn("doc_id", docs["doc_id"] + 20_000)
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(copy).cache()
    one = corpus_pipeline.language_id(spark, docs, SF).cache()
    assert one.columns == docs.columns
    before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in one.collect()}
    assert set(before) - set(after) == {9001, 9002}
    assert all(after[d]["text"] == before[d]["text"] for d in after) and after[None]["lang"] is not None

    two = corpus_pipeline.near_copies(spark, one, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = {d for d, n, c in brute_components([r for r in rows if r[0] is not None]) if d == c} | {None}
    assert Counter(r["doc_id"] for r in two.collect()) == Counter(want) and two.columns == docs.columns

    three = corpus_pipeline.repeated_passages(spark, two, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    removed = {d: n for d, _, n, _ in brute_removed(rows, 35)}
    words = {d: len(WORD.findall(t)) for d, t in rows}
    for r in three.collect():
        assert len(WORD.findall(r["text"])) == words[r["doc_id"]] - removed[r["doc_id"]]
        if not removed[r["doc_id"]]:
            assert r["text"] == dict(rows)[r["doc_id"]]
    assert three.count() == two.count() and three.columns == docs.columns

    four = corpus_pipeline.packing(spark, three, SF)
    assert {r["doc_id"] for r in four.select("doc_id").distinct().collect()} == {r["doc_id"] for r in three.collect()}


def test_near_copies_leave_one_row_of_each_group(spark):
    def text(seed, n=60):
        return " ".join(f"w{seed}x{i}" for i in range(n))

    rows = [
        (None, text(1), "a"), (None, text(1), "b"), (None, text(1) + " more", "a"),  # no member has an id
        (3, text(2), "a"), (None, text(2), "a"), (5, text(2) + " end", "a"), (5, text(3), "a"),  # 5: a copy of 3, and a text of its own
        (7, text(4), "a"), (7, text(4) + " near", "a"), (8, text(4), "a"),  # two near texts under one id
        (9, text(5), "a"), (9, text(5), "a"), (9, text(5), None),  # repeated rows
        (None, text(6), "a"), (None, text(6), "a"),
        (10, "", "a"), (10, "", "a"), (None, None, "a"),  # nothing to compare
    ]
    docs = spark.createDataFrame([(d, t, None, s, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    got = corpus_pipeline.near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    groups = Counter((r[1] or "").split("x")[0] for r in found)
    assert groups == {**{f"w{i}": 1 for i in range(1, 7)}, "": 3}
    by = {t.split("x")[0]: d for d, t in found if t}
    assert by == {"w1": None, "w2": 3, "w3": 5, "w4": 7, "w5": 9, "w6": None}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


CLASHING = ("score", "held_out", "lang_pred", "n_words", "n_removed", "kept_text", "_row", "doc", "rows", "component", "_letters", "_keep_0", "_c0", "bits_per_byte")


def test_columns_of_any_name_come_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[docs["doc_id"].cast("string").alias(c) for c in CLASHING]).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF).cache()
        assert out.columns == wide.columns and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema]
        assert 0 < out.count() == out.filter(" AND ".join(f"`{c}` = doc_id" for c in CLASHING)).count()
        wide = out
    assert corpus_pipeline.packing(spark, wide, SF).count() > 0


def test_last_stage_keeps_every_id(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, fill = {}, Counter()
    for r in corpus_pipeline.packing(spark, docs, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and set(fill) == set(range(len(fill)))
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc, n in sorted(pieces.pop(r["doc_id"])):
            assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not pieces
