from __future__ import annotations

from pyspark.sql import functions as F

from conftest import rows
from corpusqa.operators import corpora as co
from corpusqa.operators import reports as rp
from corpusqa.operators import stats as st
from corpusqa.operators import tables as tb
from corpusqa.sources import pages as pg
from corpusqa.sources import records as rc
from corpusqa.sources import transcripts as ts
from corpusqa.streaming import reports as sr

ID1, ID2 = 1433595428400, 1433595428500


def messages(spark):
    def m(seq, kind, id_, time, **f):
        return (seq, kind, id_, time, f.get("question"), f.get("sender"), f.get("node"), f.get("step"), f.get("json"),
                f.get("success"), f.get("answer"), f.get("ranking"), f.get("candidates"))

    json = '{"corpus": "sample", "id": 20, "time":100, "details":"hello world"}'
    return spark.createDataFrame(
        [
            m(1, "create", ID1, ID1 + 1, question="Why?", sender="Ms. Foo", json=json),
            m(2, "node", ID1, ID1 + 2, node="Node1"),
            m(3, "step", ID1, ID1 + 3, step="process", json="{S1: yay}"),
            m(4, "finish", ID1, ID1 + 4, answer="Because", ranking=0.5, success=True, candidates=[("nope", 0.05), ("of", 0.1)]),
            m(5, "node", ID2, ID2 + 2, node="Node2"),
            m(6, "step", ID2, ID1 + 3, step="process", json="{S1: yay}"),
            m(7, "step", ID2, ID1 + 3, step="process", json="{S1: yay}"),
            m(8, "basic", ID2, ID2),
        ],
        rc.REPORT_SCHEMA,
    )


def records(df):
    return {r["id"]: r.asDict(recursive=True) for r in df.collect()}


def test_merge(spark):
    got = records(rp.merge_process(messages(spark)))
    one, two = got[ID1], got[ID2]
    assert one["details"] == {"corpus": "sample", "id": 20, "time": 100, "details": "hello world"}
    assert one["times"] == {"create": ID1 + 1, "node": ID1 + 2, "process": ID1 + 3, "finish": ID1 + 4}
    assert (one["question"], one["answer"], one["ranking"], one["finished"]) == ("Why?", "Because", 0.5, True)
    assert [c["answer"] for c in one["candidates"]] == ["of", "nope"]
    assert two["question"] is None and two["answer"] is None and two["candidates"] is None
    assert set(two["details"].values()) == {None}
    assert two["times"] == {"node": ID2 + 2, "process": ID1 + 3}
    assert two["steps"] == {"process": "{S1: yay}"}


def test_merge_rules(spark):
    base = "seq bigint, kind string, id bigint, time bigint, step string, json string, question string"
    df = spark.createDataFrame(
        [
            (1, "step", 1, 5, "s", "short", None),
            (2, "step", 1, 4, "s", "longest!", None),
            (3, "step", 1, 9, "s", "x", None),
            (4, "create", 1, 8, None, "no json", "second"),
            (5, "create", 1, 7, None, "[", "first"),
        ],
        base,
    )
    full = spark.createDataFrame([], rc.REPORT_SCHEMA).unionByName(df, allowMissingColumns=True)
    got = records(rp.merge_process(full))[1]
    assert got["steps"] == {"s": "longest!"}
    assert got["times"] == {"s": 9, "create": 8}
    assert got["question"] == "first"
    assert set(got["details"].values()) == {None}


def stored_batches(spark, table):
    return {r["batch"]: r["n"] for r in spark.read.parquet(f"{table}/changes").groupBy("batch").agg(F.countDistinct("id").alias("n")).collect()}


def test_stream_equals_batch_under_redelivery(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    everything = messages(spark)
    expected = records(rp.merge_process(everything))
    for n, part in enumerate(("id = %d" % ID1, "seq > 4", "seq IN (1, 3, 5)")):
        everything.filter(part).coalesce(1).write.mode("append").parquet(src)
        sr.merge_process_stream(rc.stream_reports(spark, src, 1), table, state).awaitTermination()
        if n == 1:  # compacted while the stream goes on
            assert sr.compact(spark, table) >= 1 and sr.compact(spark, table) == max(stored_batches(spark, table))
    assert records(sr.merged_records(spark, table)) == expected
    last = sr.compact(spark, table)
    assert last == max(stored_batches(spark, table)) and sr.vacuum(spark, table) > 0
    assert records(sr.merged_records(spark, table)) == expected
    assert sr.vacuum(spark, table) == 0


def report(seq, id_, time, kind="node"):
    return (seq, kind, id_, time, None, None, f"n{seq}", None, None, None, None, None, None)


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    day = 86_400_000
    batches = [
        [report(i, i, day * 10 + i) for i in range(500)],
        [report(1000 + i, i, day * 11) for i in range(10)],  # ten ids
        [report(1000 + i, i, day * 11) for i in range(10)],  # delivered again
        [report(2000, 7, day * 60)],
        [report(2001, 8, day * 61), report(2002, 8, day), report(2003, 9, day)],  # two of them behind the watermark
    ]
    late, everything = 0, spark.createDataFrame([], rc.REPORT_SCHEMA)
    for rows_ in batches:
        df = spark.createDataFrame(rows_, rc.REPORT_SCHEMA)
        everything = everything.unionByName(df.filter(f"time <> {day}"))
        df.coalesce(1).write.mode("append").parquet(src)
        query = sr.merge_process_stream(rc.stream_reports(spark, src, 1), table, state, lateness="20 days")
        query.awaitTermination()
        late += sr.late_rows(query)
    assert late == 2
    sizes = [n for n in stored_batches(spark, table).values()]
    assert sorted(sizes) == [1, 1, 10, 500]
    assert records(sr.merged_records(spark, table)) == records(rp.merge_process(everything))


def test_running_counts(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    for words in (["a", "b", "a"], ["a"], ["c"]):
        spark.createDataFrame([("w", x) for x in words], "section string, key string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("section string, key string").parquet(src)
        sr.running_counts(stream, table, state).awaitTermination()
    assert rows(sr.latest_counts(spark, table)) == [("w", "a", 3), ("w", "b", 1), ("w", "c", 1)]
    changed = spark.read.parquet(f"{table}/changes").groupBy("batch").count()
    assert sorted(r["count"] for r in changed.collect()) == [1, 1, 2]
    assert sr.compact_counts(spark, table) == 2 and sr.vacuum(spark, table) == 3
    assert rows(sr.latest_counts(spark, table)) == [("w", "a", 3), ("w", "b", 1), ("w", "c", 1)]


def test_newest_and_exists(spark):
    m = rc.stored_reports(messages(spark))
    assert set(records(rp.newest(m, 1))) == {ID2} == set(records(rp.latest(m)))
    assert set(records(rp.newest(m, 5))) == {ID1, ID2}
    ids = spark.createDataFrame([(ID1,), (1,)], "id bigint")
    assert rows(rp.exists(ids, m)) == [(1, False), (ID1, True)]
    assert rows(rp.create_if_absent(ids, m)) == [(1,)]


def test_corpora(spark):
    corpora = spark.createDataFrame([("old", "x", False)], "name string, description string, deprecated boolean")
    new = spark.createDataFrame(
        [(1, "scalatest", "a simple example corpus"), (2, "scalatest", "again"), (3, "old", "y")],
        "seq int, name string, description string",
    )
    accepted, rejected = co.create_corpora(new, corpora)
    assert rows(accepted, "name") == [("scalatest",)]
    assert rows(rejected, "seq") == [(2,), (3,)]
    none = spark.createDataFrame([], "id bigint, corpus string, question string, qtype string, atype string, deprecated boolean")
    batch = spark.createDataFrame(
        [("scalatest", 1, "Why is this?", "why", "text", ["Because", "of"]), ("scalatest", 2, "How do your do?", "how", "text", ["Foo", "Bar"])],
        "corpus string, seq int, question string, qtype string, atype string, answers array<string>",
    )
    added = co.add_questions(batch, none, ["seq"])
    answers = co.question_answers(added)
    every = corpora.unionByName(accepted.select("name", "description", "deprecated"))
    got = co.get_corpus(every, added, answers)
    assert sorted((r["corpus"], r["question_id"] or 0, r["answer"] or "") for r in got.collect()) == [
        ("old", 0, ""), ("scalatest", 1, "Because"), ("scalatest", 1, "of"), ("scalatest", 2, "Bar"), ("scalatest", 2, "Foo")]
    name = spark.createDataFrame([("scalatest",)], "name string")
    assert rows(co.deprecate_corpus(every, name), "name", "deprecated") == [("old", False), ("scalatest", True)]
    which = spark.createDataFrame([("scalatest", 2)], "corpus string, id bigint")
    assert rows(co.deprecate_question(added.select(none.columns), which), "id", "deprecated") == [(1, False), (2, True)]
    c, q, a = co.cascade_delete(every, added, answers, name)
    assert (c.count(), q.count(), a.count()) == (1, 0, 0)


def test_statistics(spark):
    verdicts = spark.createDataFrame(
        [
            ("c", 1, 1, "why", 10, True, True, 2, True),
            ("c", 2, 1, "why", 20, True, True, 2, True),
            ("c", 2, 2, "how", 21, False, False, 1, False),
            ("c", 2, 3, "how", 22, True, True, 1, False),
            ("c", 2, 4, "how", 23, None, False, 0, False),
        ],
        "corpus string, run int, question_id int, qtype string, time bigint, finished boolean, answered boolean, candidates int, correct boolean",
    )
    got = st.corpus_stats_run(verdicts).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["run"], r["total"], r["completed"], r["correct"], r["candidates"], r["incorrect"]) == (2, 4, 3, 1, 3, 1)
    assert (r["precision"], r["recall"], round(r["f1"], 4)) == (0.5, 0.25, 0.3333)
    none = st.question_type_stats(verdicts, 21, 23).filter("qtype = 'how'").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_table_upkeep(spark):
    stored = spark.createDataFrame([("1", 0, "x")], "id string, n int, t string")
    new = spark.createDataFrame([("1", 1, "y"), ("2", 2, "b"), ("2", 1, "a"), (None, 1, "u"), (None, 2, "v")], "id string, n int, t string")
    assert sorted(r["t"] for r in tb.insert_if_absent(stored, new, "id", ["n"]).collect()) == ["a", "u", "v", "x"]
    assert tb.delete_where(new, new["id"] == "2").count() == 3
    q = spark.createDataFrame([("Why?", "7", ["S", "Math"], True, ["Why1", "Not"]), ("x", "8", ["S"], None, ["Why1"])],
                              "question string, id string, category array<string>, taken boolean, types array<string>")
    assert rows(tb.export_selected_questions(q, "S")) == [("Why?#7#Math#, Why1, Not#1",)]


def test_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "17.05.2015 - 19:19:22.174 \t[Test: \twarning] \tLog Data 1\n"
        "17.05.2015 - 19:19:22.5 \t[Test: \tnotice] \tLog Data 2\n"
        "99.05.2015 - 19:19:22.5 \t[Test: \terror] \tbad\nnonsense\n"
    )
    log = rc.read_log(spark, str(tmp_path))
    assert rows(log) == [(1431890362005, "info", "Log Data 2", "Test"), (1431890362174, "warning", "Log Data 1", "Test")]
    assert rc.log_between(log, 1431890362100, 1431890362200).count() == 1
    assert rc.log_between(log, 2, 1).count() == 0


def test_question_page(spark):
    html = (
        '<div id="ya-question-detail" data-ya-question-id="q1"><h1>Why &amp; how?</h1><span class="ya-q-text">Some <b>detail</b></span></div>'
        '<ol id="brdCrb"><a href="/a">All</a><a href="/b">Physics</a></ol>'
        '<div id="ya-best-answer"><span class="ya-q-full-text">Best.</span></div>'
        '<ul id="ya-qn-answers"><li><span class="ya-q-full-text">One</span></li><li><span class="ya-q-full-text">Two</span></li></ul>'
    )
    pages = spark.createDataFrame([("u1", html), ("u2", "<h1>no question</h1>")], "url string, html string")
    got = pg.parse_question_page(pages).collect()
    assert [tuple(r) for r in got] == [
        ("q1", "u1", "Why & how?", "Some detail", ["All", "Physics"], "Best.", ["One", "Two"])]


def test_transcripts(spark, tmp_path):
    items = "".join(f'<item n="{n}"><item>{n}!</item></item>' for n in ts.META_ITEMS)
    (tmp_path / "a.xml").write_text(f"<TEI><keywords><list>{items}</list></keywords><text><u>one\n  two</u><u><x/>three</u></text></TEI>")
    got = ts.read_transcript_xml(spark, str(tmp_path / "a.xml")).collect()
    assert [(r["name"], r["module"], r["text"]) for r in got] == [("a.xml", "module!", "one twothree")]
    (tmp_path / "b.json").write_text(
        '[{"id": 3, "title": "t", "transkription": "<r><decoded-data><general><projectname>P &amp; Q</projectname></general><text>x<p>y</p></text></decoded-data></r>"},'
        ' {"id": 4, "title": "no text"}]'
    )
    got = ts.read_transcript_json(spark, str(tmp_path / "b.json")).collect()
    assert [tuple(r) for r in got] == [(3, "t", "P & Q", " x y  ")]


def test_word_vector_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 2\nson 3 4\nboy 1 0\n")
    vocab = {r["word"]: r["vec"] for r in rc.read_word_vectors(spark, str(tmp_path)).collect()}
    assert vocab == {"son": [0.6, 0.8], "boy": [1.0, 0.0]}


def test_annotations_and_triples(spark):
    good = '{"Resources":[{"@URI":"http://x/A","@support":"5","@types":"T,U","@surfaceForm":"a","@offset":"3","@similarityScore":"0.5"},{"@URI":"b"}]}'
    df = spark.createDataFrame([(good, 10), ("{bad", 0), ("{}", 0)], "json string, offset int")
    assert [tuple(r) for r in rc.parse_annotations(df).collect()] == [("<http://x/A>", 5, ["T", "U"], "a", 13, 0.5)]
    lines = spark.createDataFrame([('<a> <p> "x \\"y\\""@en .',), ("<a> <p> <b> .",), ("# no",)], "value string")
    assert rows(rc.parse_triples(lines)) == [("a", "p", "b", ""), ("a", "p", 'x "y"', "en")]


def test_update_field_applies_changes_in_order(spark):
    table = spark.createDataFrame([(1, "o", ["a"], {"x": "0"}), (2, "p", None, None)], "k int, f string, l array<string>, m map<string,string>")
    changes = spark.createDataFrame([(1, 2, "y"), (1, 1, "z"), (2, 1, None), (2, 2, "w"), (None, 1, "n"), (9, 1, "q")], "k int, at int, v string")
    one = changes.select("k", "at", changes["v"].alias("value"))
    got = {r["k"]: r["f"] for r in tb.update_field(table, one, "k", "f", order_by="at").collect()}
    assert got == {1: "y", 2: "w"}
    lists = changes.filter("v is not null").selectExpr("k", "at", "array(v) AS value")
    got = {r["k"]: r["l"] for r in tb.update_field(table, lists, "k", "l", append=True, order_by="at").collect()}
    assert got == {1: ["a", "z", "y"], 2: ["w"]}
    maps = changes.filter("v is not null").selectExpr("k", "at", "map('x', v, 'k' || at, v) AS value")
    got = {r["k"]: r["m"] for r in tb.update_field(table, maps, "k", "m", append=True, order_by="at").collect()}
    assert got == {1: {"x": "y", "k1": "z", "k2": "y"}, 2: {"x": "w", "k2": "w"}}


def test_stored_pages(spark, tmp_path):
    df = spark.range(5000).selectExpr("id % 7 AS a", "id AS b", "cast(id AS string) AS c").repartition(6)
    path = tb.store_pages(df, ["a", "b"], str(tmp_path / "t"), file_rows=100)
    every = [tuple(r) for r in df.orderBy("a", "b").collect()]
    for start, size in ((0, 10), (4321, 50), (95, 10), (4990, 100), (700, 300), (9000, 5), (3, 0)):
        page = tb.stored_page(spark, path, start, size)
        assert [tuple(r) for r in page.collect()] == every[start : start + size]
        if size == 50:
            assert tb.page_files(spark, path, start, size).count() <= 2 and len(page.inputFiles()) <= 2
    empty = tb.store_pages(df.limit(0), ["a", "b"], str(tmp_path / "e"))
    assert tb.stored_page(spark, empty, 0, 5).collect() == []


def test_a_table_of_several_files_streams(spark, tmp_path):
    from corpusqa.plans import all_queries

    docs = spark.createDataFrame([(1, "a b a"), (2, "b. c"), (3, None)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = all_queries()["running_counts"](spark, str(tmp_path))
    assert rows(got, "key", "count") == [(".", 1), ("a", 2), ("b", 2), ("c", 1)]
