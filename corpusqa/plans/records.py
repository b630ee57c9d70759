"""Corpora, reports, statistics, table upkeep and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusqa.operators import corpora as co
from corpusqa.operators import reports as rp
from corpusqa.operators import stats as st
from corpusqa.operators import tables as tb
from corpusqa.operators.profile import token_rows
from corpusqa.plans import data as d
from corpusqa.plans.registry import query
from corpusqa.plans.search import joined_map
from corpusqa.session import new_folder
from corpusqa.sources import pages as pg
from corpusqa.sources import records as rc
from corpusqa.sources import transcripts as ts
from corpusqa.streaming import reports as sr

# ---- corpora ----


def _corpora(spark, sf):
    names = d.table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return names.select(
        "name", F.concat(F.lit("documents of "), F.col("name")).alias("description"), F.lit(False).alias("deprecated")
    )


def _corpus_questions(spark, sf):
    return d.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"),
        F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("corpus"),
        F.col("text").alias("question"),
        F.lit("other").alias("qtype"),
        F.lit("text").alias("atype"),
        F.lit(False).alias("deprecated"),
    )


def _corpus_answers(spark, sf):
    turns = d.table(spark, sf, "conversations").filter("role = 'assistant'")
    question = F.col("conv_id") % 35
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        question.alias("question"),
        F.concat(F.lit("src"), (question % 7).cast("string")).alias("corpus"),
        F.col("text").alias("answer"),
    )


_CORPORA = """corpora AS (
  SELECT source AS name, 'documents of ' || source AS description, false AS deprecated FROM (SELECT DISTINCT source FROM documents)),
questions AS (
  SELECT item_id AS id, 'src' || (item_id % 7) AS corpus, text AS question, 'other' AS qtype, 'text' AS atype, false AS deprecated FROM benchmark),
answers AS (
  SELECT conv_id * 100 + turn AS id, conv_id % 35 AS question, 'src' || (conv_id % 35 % 7) AS corpus, text AS answer
  FROM conversations WHERE role = 'assistant')"""


def _region_names(spark, sf):
    """Corpora named by the regions' keys: src0 to src4."""
    return d.table(spark, sf, "region").select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("name"))


_REGION_NAMES = "region_names AS (SELECT 'src' || r_regionkey AS name FROM region)"


@query(f"""WITH {_CORPORA}, names AS (SELECT 'src' || n_nationkey AS name FROM nation)
SELECT name, name IN (SELECT name FROM corpora) AS exists FROM names""")
def corpus_exists(spark, sf):
    names = d.table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"))
    return co.corpus_exists(names, _corpora(spark, sf))


def _new_corpora(spark, sf):
    return d.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.concat(F.lit("src"), (F.col("c_nationkey") + 10).cast("string")).alias("name"),
        F.col("c_name").alias("description"),
    )


_NEW_CORPORA = f"""{_CORPORA},
new AS (SELECT c_custkey AS seq, 'src' || (c_nationkey + 10) AS name, c_name AS description FROM customer),
decided AS (SELECT *, name NOT IN (SELECT name FROM corpora) AND row_number() OVER (PARTITION BY name ORDER BY seq) = 1 AS taken FROM new)"""


@query(f"""WITH {_NEW_CORPORA} SELECT seq, name, description, CASE WHEN taken THEN 'accepted' ELSE 'rejected' END AS result FROM decided""")
def create_corpora(spark, sf):
    accepted, rejected = co.create_corpora(_new_corpora(spark, sf), _corpora(spark, sf))
    shown = ["seq", "name", "description"]
    return accepted.select(*shown, F.lit("accepted").alias("result")).unionByName(
        rejected.select(*shown, F.lit("rejected").alias("result"))
    )


@query(f"WITH {_CORPORA}, {_REGION_NAMES} SELECT name, description, name IN (SELECT name FROM region_names) AS deprecated FROM corpora")
def deprecate_corpus(spark, sf):
    return co.deprecate_corpus(_corpora(spark, sf), _region_names(spark, sf))


@query(f"""WITH {_CORPORA} SELECT id, corpus, question, qtype, atype,
  EXISTS (SELECT 1 FROM answers a WHERE a.corpus = q.corpus AND a.question = q.id) AS deprecated FROM questions q""")
def deprecate_question(spark, sf):
    """Questions that have an answer are deprecated."""
    answered = _corpus_answers(spark, sf).select("corpus", F.col("question").alias("id"))
    return co.deprecate_question(_corpus_questions(spark, sf), answered)


def _added(spark, sf):
    turns = d.table(spark, sf, "conversations").filter("role = 'user'")
    new = turns.select(
        F.concat(F.lit("src"), (F.col("conv_id") % 9).cast("string")).alias("corpus"),
        F.col("text").alias("question"),
        F.lit("other").alias("qtype"),
        F.lit("text").alias("atype"),
        F.array(F.concat(F.lit("first "), F.col("turn").cast("string")), F.lit("second")).alias("answers"),
        "conv_id",
        "turn",
    )
    return co.add_questions(new, _corpus_questions(spark, sf), ["conv_id", "turn"])


_ADDED = f"""{_CORPORA},
new AS (SELECT 'src' || (conv_id % 9) AS corpus, text AS question, conv_id, turn FROM conversations WHERE role = 'user'),
added AS (
  SELECT n.corpus, n.question, turn, row_number() OVER (PARTITION BY n.corpus ORDER BY conv_id, turn) + coalesce(highest, 0) AS id
  FROM new n LEFT JOIN (SELECT corpus, max(id) AS highest FROM questions GROUP BY corpus) m USING (corpus))"""


@query(f"WITH {_ADDED} SELECT corpus, id, question FROM added")
def add_question_batch(spark, sf):
    return _added(spark, sf).select("corpus", "id", "question")


@query(f"""WITH {_ADDED} SELECT corpus, id AS question, 1 AS id, 'first ' || turn AS answer FROM added
UNION ALL SELECT corpus, id, 2, 'second' FROM added""")
def add_question(spark, sf):
    """The answer rows that belong to added questions."""
    return co.question_answers(_added(spark, sf))


@query(f"""WITH {_CORPORA} SELECT c.name AS corpus, description, c.deprecated AS corpus_deprecated, q.id AS question_id, q.question, qtype, atype,
  q.deprecated AS question_deprecated, a.id AS answer_id, a.answer
FROM corpora c LEFT JOIN questions q ON q.corpus = c.name LEFT JOIN answers a ON a.corpus = q.corpus AND a.question = q.id""")
def get_corpus(spark, sf):
    return co.get_corpus(_corpora(spark, sf), _corpus_questions(spark, sf), _corpus_answers(spark, sf))


@query(f"WITH {_CORPORA} SELECT name, description, deprecated FROM corpora")
def list_corpora(spark, sf):
    return co.list_corpora(_corpora(spark, sf))


@query(f"""WITH {_CORPORA}, {_REGION_NAMES}
SELECT 'corpus' AS kind, name AS corpus, NULL::BIGINT AS id FROM corpora WHERE name NOT IN (SELECT name FROM region_names)
UNION ALL SELECT 'question', corpus, id FROM questions WHERE corpus NOT IN (SELECT name FROM region_names)
UNION ALL SELECT 'answer', corpus, id FROM answers a WHERE NOT EXISTS (
  SELECT 1 FROM questions q WHERE q.corpus = a.corpus AND q.id = a.question AND q.corpus IN (SELECT name FROM region_names))""")
def cascade_delete(spark, sf):
    c, q, a = co.cascade_delete(
        _corpora(spark, sf), _corpus_questions(spark, sf), _corpus_answers(spark, sf), _region_names(spark, sf)
    )
    parts = [
        c.select(F.lit("corpus").alias("kind"), F.col("name").alias("corpus"), F.lit(None).cast("bigint").alias("id")),
        q.select(F.lit("question").alias("kind"), "corpus", "id"),
        a.select(F.lit("answer").alias("kind"), "corpus", "id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- reports ----

_MESSAGE_COLUMNS = "seq, kind, id, time"


@query(f"WITH {d.SQL_REPORTS} SELECT {_MESSAGE_COLUMNS} FROM reports WHERE kind <> 'node'")
def read_reports(spark, sf):
    """Messages stored as parquet and read back; node messages stand in for the basic kind."""
    path = new_folder(spark, "messages")
    kind = F.when(F.col("kind") == "node", "basic").otherwise(F.col("kind"))
    d.reports(spark, sf).withColumn("kind", kind).write.parquet(path)
    return rc.read_reports(spark, path).select("seq", "kind", "id", "time")


def flat_records(records):
    """Merged records with their nested parts as text."""
    names = F.transform("candidates", lambda c: c["answer"])
    return records.select(
        "id", "question", "sender", "node",
        F.col("details.corpus").alias("details_corpus"), F.col("details.id").alias("details_id"),
        F.col("details.time").alias("details_time"), F.col("details.details").alias("details_text"),
        "answer", F.round("ranking", 4).alias("ranking"), "finished",
        F.array_join(names, "|").alias("candidates"),
        joined_map("times").alias("times"), joined_map("steps").alias("steps"),
    )


_RECORDS = f"""WITH {d.SQL_REPORTS} SELECT id, question, sender, node, details_corpus, details_id, details_time, details_text,
  answer, round(ranking, 4) AS ranking, finished, candidates, times, steps FROM records"""


@query(_RECORDS)
def merge_process(spark, sf):
    return flat_records(rp.merge_process(d.reports(spark, sf)))


@query(_RECORDS)
def merge_process_stream(spark, sf):
    """The events file as a stream of messages, every message delivered twice; then compacted."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    events = d.stream(spark, sf, "events", schema)
    twice = events.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    table, state = new_folder(spark, "merged"), new_folder(spark, "state")
    sr.merge_process_stream(d.as_reports(twice), table, state, lateness="400 days").awaitTermination()
    sr.compact(spark, table)
    return flat_records(sr.merged_records(spark, table))


def _entries(spark, sf, kind):
    """Entries of a kind of message, their values as text; rankings in ten thousandths."""
    rows = rp.report_entries(d.reports(spark, sf).filter(F.col("kind") == kind))

    def shown(ranking):
        return F.round(ranking * 10_000).cast("bigint").cast("string")

    candidates = F.array_join(F.transform("first.c", lambda c: F.concat(c["answer"], F.lit("="), shown(c["ranking"]))), "|")
    value = F.coalesce("first.s", F.col("first.l").cast("string"), F.col("first.b").cast("string"), shown(F.col("first.d")), candidates)
    return rows.select(F.col("first_ord.seq").alias("seq"), "id", "section", "key", value.alias("value"))


def _entries_sql(*rows: str) -> str:
    kinds = " UNION ALL ".join(rows)
    return f"WITH {d.SQL_REPORTS} {kinds}"


def _entry(kind: str, section: str, key: str, value: str) -> str:
    return f"SELECT seq, id, '{section}' AS section, {key} AS key, {value} AS value FROM ordered WHERE kind = '{kind}'"


@query(_entries_sql(
    _entry("create", "scalar", "'question'", "'question ' || k"), _entry("create", "scalar", "'sender'", "'user ' || id"),
    _entry("create", "scalar", "'details.corpus'", "'c' || k"), _entry("create", "scalar", "'details.id'", "seq::VARCHAR"),
    _entry("create", "scalar", "'details.time'", "'0'"), _entry("create", "scalar", "'details.details'", "''"),
    _entry("create", "time", "'create'", "time::VARCHAR")))
def report_create(spark, sf):
    return _entries(spark, sf, "create")


@query(_entries_sql(_entry("node", "scalar", "'node'", "'node ' || k"), _entry("node", "time", "'node'", "time::VARCHAR")))
def report_node(spark, sf):
    return _entries(spark, sf, "node")


@query(_entries_sql(_entry("step", "step", "step", "props"), _entry("step", "time", "step", "time::VARCHAR")))
def report_step(spark, sf):
    return _entries(spark, sf, "step")


@query(_entries_sql(
    _entry("finish", "scalar", "'answer'", "'answer ' || k"), _entry("finish", "scalar", "'finished'", "success::VARCHAR"),
    _entry("finish", "scalar", "'ranking'", "round(value * 10000)::BIGINT::VARCHAR"),
    _entry("finish", "scalar", "'candidates'", "'answer ' || k || '=' || round(value * 10000)::BIGINT || '|other=' || round(value / 2 * 10000)::BIGINT"),
    _entry("finish", "time", "'finish'", "time::VARCHAR")))
def report_finish(spark, sf):
    return _entries(spark, sf, "finish")


@query("""WITH c AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
cleaned AS (SELECT id, i, CASE WHEN x > 0.2 THEN 0 ELSE x END AS x FROM c)
SELECT id, 'answer ' || i AS answer, round(x, 4) + 0 AS ranking, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, i) AS rank FROM cleaned) WHERE rank <= 10""")
def clean_candidates(spark, sf):
    """The elements of a vector as rankings, the large ones replaced by NaN and infinity."""
    found = F.transform(
        "vec",
        lambda x, i: F.struct(
            F.concat(F.lit("answer "), i.cast("string")).alias("answer"),
            F.when((x > 0.2) & (i % 2 == 0), float("nan")).when(x > 0.2, float("inf")).otherwise(x).alias("ranking"),
        ),
    )
    cleaned = d.embeddings(spark, sf).select(F.col("vec_id").alias("id"), rp.clean_candidates(found).alias("c"))
    return cleaned.select("id", F.posexplode("c").alias("pos", "c")).select(
        "id", "c.answer", (F.round("c.ranking", 4) + F.lit(0.0)).alias("ranking"), (F.col("pos") + 1).alias("rank")
    )


def _label_ids(spark, sf):
    return d.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))


@query(f"WITH {d.SQL_REPORTS} SELECT DISTINCT doc_id AS id, doc_id IN (SELECT id FROM reports) AS exists FROM labels")
def exists(spark, sf):
    return rp.exists(_label_ids(spark, sf), d.reports(spark, sf))


@query(f"WITH {d.SQL_REPORTS} SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT id FROM reports)")
def create_if_absent(spark, sf):
    return rp.create_if_absent(_label_ids(spark, sf), d.reports(spark, sf))


@query(f"WITH {d.SQL_REPORTS} SELECT {_MESSAGE_COLUMNS} FROM reports")
def list_(spark, sf):
    return d.reports(spark, sf).select("seq", "kind", "id", "time")


@query(f"{_RECORDS} WHERE id IN (SELECT doc_id FROM labels)")
def get(spark, sf):
    return flat_records(rp.get(d.reports(spark, sf), _label_ids(spark, sf)))


@query(f"{_RECORDS} WHERE id = (SELECT max(id) FROM reports)")
def latest(spark, sf):
    return flat_records(rp.latest(d.reports(spark, sf)))


@query(f"{_RECORDS} WHERE id IN (SELECT DISTINCT id FROM reports ORDER BY id DESC LIMIT 20)")
def newest(spark, sf):
    return flat_records(rp.newest(d.reports(spark, sf), 20))


@query("SELECT count(*) AS docs FROM events")
def count_docs(spark, sf):
    return rp.count_docs(d.reports(spark, sf))


@query(f"SELECT 'word' AS section, token AS key, count(*) AS count FROM (SELECT unnest({d.sql_words('text')}) AS token FROM documents) GROUP BY ALL")
def running_counts(spark, sf):
    """Words of the documents file, counted as a stream."""
    docs = d.stream(spark, sf, "documents", "doc_id bigint, text string")
    entries = token_rows(docs).select(F.lit("word").alias("section"), F.col("token").alias("key"))
    table, state = new_folder(spark, "counts"), new_folder(spark, "state")
    sr.running_counts(entries, table, state).awaitTermination()
    return sr.latest_counts(spark, table)


# ---- statistics ----


def _asked(spark, sf):
    reports = d.reports(spark, sf)
    wh = F.array(*[F.lit(w.lower()) for w in d.WH])
    return reports.groupBy(F.col("id").alias("question_id")).agg(F.max("time").alias("time")).select(
        F.concat(F.lit("corpus"), (F.col("question_id") % 3).cast("string")).alias("corpus"),
        F.floor(F.col("question_id") / 100).alias("run"),
        "question_id",
        F.get(wh, (F.col("question_id") % 8).cast("int")).alias("qtype"),
        "time",
    )


def _gold(spark, sf):
    labels = d.table(spark, sf, "labels")
    return d.table(spark, sf, "events").join(labels.filter("quality = 1"), F.col("user_id") == F.col("doc_id")).select(
        F.col("user_id").alias("question_id"), F.concat(F.lit("answer "), F.get_json_object("props", "$.k")).alias("answer")
    )


def _verdicts(spark, sf):
    return st.analyze_docs(_asked(spark, sf), rp.merge_process(d.reports(spark, sf)), _gold(spark, sf))


_VERDICTS = f"""{d.SQL_REPORTS},
asked AS (SELECT 'corpus' || (id % 3) AS corpus, id // 100 AS run, id AS question_id,
    [{', '.join(d.q(w.lower()) for w in d.WH)}][(id % 8 + 1)::INT] AS qtype, max(time) AS time FROM reports GROUP BY id),
gold AS (SELECT DISTINCT user_id AS question_id, 'answer ' || json_extract_string(props, '$.k') AS answer
  FROM events JOIN labels ON user_id = doc_id WHERE quality = 1),
verdicts AS (SELECT a.*, r.finished, coalesce(r.finished, false) AS answered, CASE WHEN r.candidates IS NULL THEN 0 ELSE 2 END AS candidates,
    coalesce(r.finished, false) AND (a.question_id, r.answer) IN (SELECT (question_id, answer) FROM gold) AS correct
  FROM asked a LEFT JOIN records r ON r.id = a.question_id)"""


def _measures_sql(keys: str, where: str = "true") -> str:
    return f"""WITH {_VERDICTS},
hits AS (SELECT {keys}, count(*) AS total, count(finished) AS completed, count(*) FILTER (WHERE correct) AS correct,
    count(*) FILTER (WHERE candidates > 0) AS candidates, count(*) FILTER (WHERE answered AND NOT correct) AS incorrect
  FROM verdicts v WHERE {where} GROUP BY {keys}),
rates AS (SELECT *, CASE WHEN correct + incorrect > 0 THEN correct / (correct + incorrect) ELSE 0 END AS p, correct / total AS r FROM hits)
SELECT {keys}, total, completed, correct, candidates, incorrect, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM rates"""


def _rounded(df):
    for c in ("precision", "recall", "f1"):
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(f"WITH {_VERDICTS} SELECT * FROM verdicts")
def analyze_docs(spark, sf):
    return _verdicts(spark, sf)


@query(f"WITH {_VERDICTS} SELECT * FROM verdicts WHERE question_id = (SELECT max(doc_id) FROM labels WHERE quality = 1 AND doc_id IN (SELECT id FROM reports))")
def analyze_doc(spark, sf):
    """The newest question whose document is labelled good."""
    asked = _asked(spark, sf)
    good = d.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("question_id"))
    newest = asked.join(good, "question_id", "left_semi").agg(F.max("question_id")).first()[0]
    return st.analyze_doc(asked, rp.merge_process(d.reports(spark, sf)), _gold(spark, sf), newest)


@query(f"WITH {_VERDICTS} SELECT * FROM verdicts")
def reanalyze(spark, sf):
    path = new_folder(spark, "verdicts")
    st.reanalyze(_asked(spark, sf), rp.merge_process(d.reports(spark, sf)), _gold(spark, sf), path)
    return spark.read.parquet(path)


# 2024-01-10 to 2024-01-20 UTC
_START, _END = 1704844800000, 1705708800000


@query(f"""WITH {d.SQL_REPORTS} SELECT time // 86400000 * 86400000 AS slot, min(time) AS start, max(time) AS "end", count(*) AS reports
FROM reports WHERE time BETWEEN {_START} AND {_END} GROUP BY ALL""")
def time_stats(spark, sf):
    return st.time_stats(d.reports(spark, sf), _START, _END, 86_400_000)


@query(_measures_sql("corpus, run", "(corpus, run) IN (SELECT (corpus, max(run)) FROM verdicts GROUP BY corpus)"))
def corpus_stats_run(spark, sf):
    return _rounded(st.corpus_stats_run(_verdicts(spark, sf)))


@query(_measures_sql("corpus, run"))
def corpus_history(spark, sf):
    return _rounded(st.corpus_history(_verdicts(spark, sf)))


_LATE = 1706400000000  # 2024-01-28 UTC


@query(_measures_sql("qtype", f"time BETWEEN {_LATE} AND {_LATE + 2 * 86400000}"))
def question_type_stats(spark, sf):
    return _rounded(st.question_type_stats(_verdicts(spark, sf), _LATE, _LATE + 2 * 86_400_000))


@query(_measures_sql("corpus, run, qtype"))
def question_type_stats_run(spark, sf):
    return _rounded(st.question_type_stats_run(_verdicts(spark, sf)))


# ---- table upkeep ----


@query(f"WITH {d.SQL_TRANSCRIPTS} SELECT id, corpus, department FROM transcripts WHERE corpus <> 'base'")
def delete_where(spark, sf):
    kept = tb.delete_where(d.transcripts(spark, sf), F.col("corpus") == "base")
    return kept.select("id", "corpus", "department")


@query("""SELECT 'department' AS section, source AS key, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY ALL
UNION ALL SELECT 'module', lang, count(*) FROM documents GROUP BY ALL""")
def reset(spark, sf):
    """Counts of a first run stored; a second run, over fewer documents, replaces one of two sections."""
    docs = d.table(spark, sf, "documents")

    def counts(rows, section, key):
        return rows.groupBy(F.lit(section).alias("section"), F.col(key).alias("key")).count()

    path = new_folder(spark, "counts")
    tb.overwrite_counts(counts(docs, "department", "source").unionByName(counts(docs, "module", "lang")), path)
    tb.overwrite_counts(counts(docs.filter("lang = 'en'"), "department", "source"), path)
    return spark.read.parquet(path).select("section", "key", "count")


def _keyed(turns):
    """Conversation turns keyed by conversation; system turns have no key."""
    return turns.select(
        F.when(F.col("role") != "system", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("id"),
        "turn",
        F.col("text").alias("question"),
    )


@query("""WITH stored AS (SELECT 'c' || doc_id AS id, 0 AS turn, 'stored' AS question FROM labels WHERE toxic = 0),
new AS (SELECT CASE WHEN role <> 'system' THEN 'c' || conv_id END AS id, turn, text AS question FROM conversations)
SELECT * FROM stored UNION ALL SELECT * FROM new WHERE id IS NULL
UNION ALL SELECT id, turn, question FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS nth FROM new WHERE id IS NOT NULL)
WHERE nth = 1 AND id NOT IN (SELECT id FROM stored)""")
def insert_if_absent(spark, sf):
    stored = d.table(spark, sf, "labels").filter("toxic = 0").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.lit(0).cast("bigint").alias("turn"),
        F.lit("stored").alias("question"),
    )
    return tb.insert_if_absent(stored, _keyed(d.table(spark, sf, "conversations")), "id", ["turn"])


@query(f"""WITH {d.SQL_SNIPPETS} SELECT corpus, id, "offset" FROM snippets s
WHERE NOT ("offset" = 0 AND id IN (SELECT doc_id::VARCHAR FROM labels))""")
def incremental_docs(spark, sf):
    """The first snippet of every labelled document is present already."""
    snippets = d.snippets(spark, sf)
    labelled = d.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    present = d.transcripts(spark, sf).join(labelled, "id", "left_semi").select("corpus", "id", F.lit(0).alias("offset"))
    return tb.incremental_docs(snippets, present).select("corpus", "id", "offset")


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL THEN lang ELSE 'q' || quality END AS lang,
  CASE WHEN toxic IS NULL THEN 'src=' || source ELSE 'src=' || source || ',toxic=' || toxic END AS tags,
  CASE WHEN toxic IS NULL THEN lang ELSE lang || '>t' || toxic || '>q' || quality END AS path
FROM documents d LEFT JOIN labels USING (doc_id)""")
def update_field(spark, sf):
    """Each label makes two changes, in order: the last one set stays, appended ones follow one another."""
    docs = d.table(spark, sf, "documents").select("doc_id", "lang", F.create_map(F.lit("src"), F.col("source")).alias("tags"), F.array("lang").alias("path"))
    labels = d.table(spark, sf, "labels")
    q = F.concat(F.lit("q"), F.col("quality").cast("string"))
    t = F.concat(F.lit("t"), F.col("toxic").cast("string"))

    def changes(first, second):
        return labels.select("doc_id", F.posexplode(F.array(first, second)).alias("seq", "value"))

    def tag(value):
        return F.create_map(F.lit("toxic"), value)

    out = tb.update_field(docs, changes(t, q), "doc_id", "lang", order_by="seq")
    out = tb.update_field(out, changes(tag(q), tag(F.col("toxic").cast("string"))), "doc_id", "tags", append=True, order_by="seq")
    out = tb.update_field(out, changes(F.array(t), F.array(q)), "doc_id", "path", append=True, order_by="seq")
    return out.select("doc_id", "lang", joined_map("tags").alias("tags"), F.array_join("path", ">").alias("path"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS taken FROM documents")
def set_flag(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", F.lit(False).alias("taken"))
    return tb.set_flag(docs, d.table(spark, sf, "labels").filter("quality = 1"), ["doc_id"], "taken", True)


@query(r"""SELECT doc_id::VARCHAR AS id, 'base' AS corpus, lang AS module, source AS department, '' AS title,
  CASE lang WHEN 'en' THEN 'lecture' WHEN 'de' THEN 'seminar' ELSE 'other' END AS type,
  regexp_replace(text, '[ ]*(\r)?\n[ ]*', ' ', 'g') AS text, 0 AS "offset" FROM documents""")
def to_transcript(spark, sf):
    docs = d.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("module"), F.col("source").alias("department"),
        F.lit(None).cast("string").alias("title"),
        F.when(F.col("lang") == "en", "ls").when(F.col("lang") == "de", "ss").otherwise("xx").alias("code"), "text",
    )
    return tb.to_transcript(docs, "base", "code").drop("clues", "vectors")


@query(f"WITH {d.SQL_TRANSCRIPTS} SELECT id, corpus, text FROM transcripts")
def get_all(spark, sf):
    return d.transcripts(spark, sf).select("id", "corpus", "text")


@query("SELECT count(*) AS docs FROM documents")
def count_all(spark, sf):
    return d.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def get_page(spark, sf):
    return tb.get_page(d.table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 100, 50)


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 100 OFFSET 30000")
def get_page_deep(spark, sf):
    lines = d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    page = tb.get_page(lines, ["l_orderkey", "l_linenumber", "l_partkey"], 30_000, 100)
    return page.select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 100 OFFSET 30000")
def get_page_stored(spark, sf):
    """The same deep page of a table stored for paging: the files it lies in are read."""
    lines = d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    path = tb.store_pages(lines, ["l_orderkey", "l_linenumber", "l_partkey"], file_rows=1000)
    return tb.stored_page(spark, path, 30_000, 100).select("l_orderkey", "l_linenumber")


# ---- sources ----

_PAGES = pg.PagePatterns(
    question=r"(?s)<h1>(.*?)</h1>",
    id=r'track\(([0-9]+)\)',
    categories=r"(?s)<nav>.*?</nav>",
    category=r"(?s)<a [^>]*>(.*?)</a>",
    detail=r'(?s)<div class="ad">(.*?)</div>',
    best=r"(?s)<p>(.*?)<p>",
    others=r"(?s)<article>.*</article>",
    other=r"(?s)<p>([^<]*)",
)


def _plain_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({out}, '[ \t\r\n\f]+', ' ', 'g'))"


def _part_sql(p: str) -> str:
    return f"CASE WHEN regexp_matches(html, {d.q(p)}) THEN {_plain_sql(f'regexp_extract(html, {d.q(p)}, 1)')} END"


def _parts_sql(area: str, p: str) -> str:
    inner = f"regexp_extract_all(regexp_extract(html, {d.q(area)}, 0), {d.q(p)}, 1)"
    return f"array_to_string(list_transform({inner}, lambda x: {_plain_sql('x')}), '|')"


@query(f"""SELECT {_part_sql(_PAGES.id)} AS id, url, {_part_sql(_PAGES.question)} AS question, {_part_sql(_PAGES.detail)} AS questiondetail,
  CASE WHEN regexp_matches(html, {d.q(_PAGES.categories)}) THEN {_parts_sql(_PAGES.categories, _PAGES.category)} END AS category,
  {_part_sql(_PAGES.best)} AS bestanswer,
  CASE WHEN regexp_matches(html, {d.q(_PAGES.others)}) THEN {_parts_sql(_PAGES.others, _PAGES.other)} END AS otheranswers
FROM pages WHERE regexp_matches(html, {d.q(_PAGES.question)})""")
def parse_question_page(spark, sf):
    found = pg.parse_question_page(d.table(spark, sf, "pages"), _PAGES)
    return found.withColumn("category", F.array_join("category", "|")).withColumn(
        "otheranswers", F.array_join("otheranswers", "|")
    )


@query(f"""WITH {d.SQL_QA} SELECT id, question, '' AS url, '' AS questiondetail, '' AS bestanswer, taken,
  'All|' || area || '|' || last AS category, '' AS otheranswers, '' AS types FROM qa_questions""")
def decode_question(spark, sf):
    out = pg.decode_question(d.qa_questions(spark, sf))
    for c in ("category", "otheranswers", "types"):
        out = out.withColumn(c, F.array_join(c, "|"))
    return out


@query("""SELECT epoch_us(ts) // 1000 AS time, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'debug' WHEN 'view' THEN 'warning' ELSE 'info' END AS level,
  'event ' || event_id AS message, 'User' || user_id AS sender FROM events WHERE event_type <> 'purchase'""")
def read_log(spark, sf):
    """Events written as log lines and read back; purchases are no valid lines."""
    return rc.read_log(spark, _log_file(spark, sf))


def _log_file(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("error", "error", "click", "debug", "view", "warning", "signup", "notice", "purchase", "info")])
    ms = F.unix_millis(F.col("ts").cast("timestamp")) % 1000
    line = F.format_string(
        "%s.%d \t[User%d: \t%s] \tevent %d",
        F.date_format("ts", "dd.MM.yyyy - HH:mm:ss"), ms, "user_id", names[F.col("event_type")], "event_id",
    )
    broken = F.when(F.col("event_type") == "purchase", F.concat(F.lit("at "), line)).otherwise(line)
    path = new_folder(spark, "log")
    d.table(spark, sf, "events").select(broken.alias("value")).write.text(path)
    return path


@query(f"""SELECT epoch_us(ts) // 1000 AS time, 'event ' || event_id AS message FROM events
WHERE event_type <> 'purchase' AND epoch_us(ts) // 1000 BETWEEN {_START} AND {_END}""")
def log_between(spark, sf):
    return rc.log_between(rc.read_log(spark, _log_file(spark, sf)), _START, _END).select("time", "message")


@query("""SELECT event_id, '<http://kb.example/' || event_type || '>' AS uri, user_id AS support, 'Thing|' || event_type AS types,
  event_type AS surface_form, user_id + 1000 AS "offset", value AS score FROM events WHERE event_type <> 'error'""")
def parse_annotations(spark, sf):
    """Events as annotation answers of one resource; errors hold a bad number, clicks another bad row."""
    kind = F.col("event_type")
    number = F.col("user_id").cast("string")

    def resource(support):
        return F.struct(
            F.concat(F.lit("http://kb.example/"), kind).alias("@URI"), support.alias("@support"),
            F.concat(F.lit("Thing,"), kind).alias("@types"), kind.alias("@surfaceForm"),
            number.alias("@offset"), F.col("value").cast("string").alias("@similarityScore"),
        )

    bad = resource(F.lit("many"))
    rows = F.when(kind == "error", F.array(bad)).when(kind == "click", F.array(bad, resource(number))).otherwise(
        F.array(resource(number))
    )
    json = F.to_json(F.struct(rows.alias("Resources")))
    answers = d.table(spark, sf, "events").select("event_id", json.alias("json"), F.lit(1000).alias("offset"))
    broken = answers.withColumn("json", F.lit("{not json"))
    found = rc.parse_annotations(answers.unionByName(broken), keys=("event_id",))
    return found.withColumn("types", F.array_join("types", "|"))


@query("SELECT doc_id, text, source AS lecture, CASE WHEN lang = 'de' THEN '' ELSE lang END AS topic FROM documents")
def project_corpus_doc(spark, sf):
    module = F.when(F.col("lang") != "de", F.col("lang"))
    docs = d.documents(spark, sf).select(
        "doc_id", F.to_json(F.struct("text", F.col("source").alias("acaddept"), module.alias("module"))).alias("json")
    )
    return ts.project_corpus_doc(docs, keys=("doc_id",))


def _xml_escaped(c):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


@query(r"""SELECT page_id::VARCHAR AS name, 'talk' AS speechevent, 'm' || (page_id % 3) AS module, 'p' AS partlevel, 'd' || (page_id % 5) AS acaddept,
  'v' AS acaddiv, regexp_replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[ ]*(\r)?\n[ ]*', ' ', 'g') || 'end' AS text FROM pages""")
def read_transcript_xml(spark, sf):
    """Pages' URLs wrapped as transcript files of two utterances."""
    def item(name, value):
        return F.concat(F.lit(f'<item n="{name}"><item>'), value, F.lit("</item></item>"))

    xml = F.concat(
        F.lit("<TEI><keywords><list>"),
        item("speechevent", F.lit("talk")),
        item("module", F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string"))),
        item("partlevel", F.lit("p")),
        item("acaddept", F.concat(F.lit("d"), (F.col("page_id") % 5).cast("string"))),
        item("acaddiv", F.lit("v")),
        F.lit('</list></keywords><text><u who="a">'),
        _xml_escaped(F.col("url")),
        F.lit("</u>\n<u><b>end</b></u></text></TEI>"),
    )
    files = d.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("name"), xml.alias("xml"))
    return ts.parse_transcript_xml(files)


@query(r"""SELECT page_id AS id, url AS title, 'Project ' || (page_id % 4) AS department,
  ' ' || 'first part ' || page_id || ' ' || 'second part ' AS text FROM pages WHERE page_id % 5 <> 0""")
def read_transcript_json(spark, sf):
    """Pages as JSON objects whose last field holds XML, written and read back; every fifth has no title."""
    xml = F.concat(
        F.lit("<r><decoded-data><general><projectname>Project "), (F.col("page_id") % 4).cast("string"),
        F.lit("</projectname></general>\n<text>first part "), F.col("page_id").cast("string"),
        F.lit("<br/>second part</text></decoded-data></r>"),
    )
    rows = d.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("title"), xml.alias("transkription")
    )
    path = new_folder(spark, "json")
    # one array per file, of at most 100 pages
    array = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("id", "title", "transkription"))), ","), F.lit("]"))
    files = rows.groupBy(F.floor(F.col("id") / 100).alias("part")).agg(array.alias("value"))
    files.write.partitionBy("part").text(path)
    return ts.read_transcript_json(spark, path)
