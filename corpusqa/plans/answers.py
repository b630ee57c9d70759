"""Question analysis, retrieval, candidates, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusqa.functions import text as tx
from corpusqa.functions import fixed
from corpusqa.operators import answers as an
from corpusqa.operators import embeddings as em
from corpusqa.operators import questions as qu
from corpusqa.operators import search as se
from corpusqa.operators.joins import lookup_join
from corpusqa.plans import data as d
from corpusqa.plans.registry import query
from corpusqa.plans.search import _LINKED, _ENTITY_TERMS, _Q_ENTITIES, joined_map, _linked
from corpusqa.plans.vectors import _paragraphs, elements, sql_nearest
from corpusqa.session import new_folder, settle
from corpusqa.streaming.ask import ask_stream as start_ask_stream

_CLOSED = f"""{d.SQL_QUESTIONS},
closed AS (SELECT qid, CASE WHEN right(question, 1) IN ('.', '?', '!') THEN question ELSE question || '?' END AS question FROM questions),
bows AS (SELECT qid, question, {d.sql_tokens('question')} AS bow FROM closed),
tagged AS (SELECT qid, i, t, {d.sql_tag('t')} AS tag FROM (SELECT qid, unnest(bow) AS t, unnest(range(len(bow))) AS i FROM bows)),
wh AS (SELECT qid, lower(arg_min(t, i)) AS w FROM tagged WHERE tag IN ('WP', 'WRB') GROUP BY qid),
qtypes AS (SELECT b.qid, CASE WHEN w IN ('why', 'how', 'who', 'where', 'what', 'when', 'which') THEN w ELSE 'other' END AS qtype
  FROM bows b LEFT JOIN wh USING (qid)),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY qid ORDER BY i) AS island FROM tagged WHERE tag = 'NP'),
phrases AS (SELECT qid, min(i) AS i, string_agg(t, ' ' ORDER BY i) AS phrase FROM islands GROUP BY qid, island),
focuses AS (SELECT qid, list(phrase ORDER BY i) AS focus FROM phrases GROUP BY qid)"""


@query(f"WITH {_CLOSED} SELECT qid, qtype FROM qtypes")
def question_type(spark, sf):
    asked = d.questions(spark, sf)
    return asked.select("qid", tx.question_type(tx.tokens(F.col("question"))).alias("qtype"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'location' WHEN 'view' THEN 'person'
  WHEN 'click' THEN 'date' WHEN 'purchase' THEN 'entity' ELSE 'unknown' END AS atype FROM events""")
def answer_type(spark, sf):
    labels = {"signup": "LANG", "view": "PER", "click": "TIME", "purchase": "ORG"}
    label = F.lit(None).cast("string")
    for kind, name in labels.items():
        label = F.when(F.col("event_type") == kind, name).otherwise(label)
    return d.table(spark, sf, "events").select("event_id", tx.answer_type(label).alias("atype"))


@query(f"""WITH {_Q_ENTITIES} SELECT qid, surface AS topic FROM q_once""")
def topic(spark, sf):
    analysed = qu.analyze_questions(d.questions(spark, sf), d.gazetteer(spark, sf))
    return analysed.select("qid", F.explode("topics").alias("topic"))


@query(f"WITH {_CLOSED} SELECT qid, unnest(focus) AS phrase, unnest(range(len(focus))) AS pos FROM focuses")
def focus(spark, sf):
    asked = d.questions(spark, sf)
    return asked.select("qid", F.posexplode(tx.focus(tx.tokens(F.col("question")))).alias("pos", "phrase"))


@query(f"""WITH {_Q_ENTITIES}, {_CLOSED.replace(d.SQL_QUESTIONS + ',', '')},
tags AS (SELECT qid, string_agg(tag, ' ' ORDER BY i) AS tags FROM tagged GROUP BY qid)
SELECT b.qid, b.question, array_to_string(bow, ' ') AS bow, tags, qtype,
  CASE last_label WHEN 'LOC' THEN 'location' WHEN 'LANG' THEN 'location' WHEN 'PER' THEN 'person'
    WHEN 'DATE' THEN 'date' WHEN 'TIME' THEN 'date' WHEN 'ORG' THEN 'entity' ELSE 'unknown' END AS atype,
  CASE WHEN last_label = 'ORG' THEN last_entity END AS atype_entity,
  coalesce(array_to_string(focus, '|'), '') AS focus, coalesce(entities, '') AS entities
FROM bows b JOIN tags USING (qid) JOIN qtypes USING (qid) LEFT JOIN focuses USING (qid) LEFT JOIN q_entities USING (qid)""")
def analyze_questions(spark, sf):
    analysed = qu.analyze_questions(d.questions(spark, sf), d.gazetteer(spark, sf))
    return analysed.select(
        "qid", "question", F.array_join("bow", " ").alias("bow"), F.array_join("tags", " ").alias("tags"),
        "qtype", "atype", "atype_entity", F.array_join("focus", "|").alias("focus"),
        joined_map("entities").alias("entities"),
    )


_BOW_CLAUSES = f"""clauses AS (
  SELECT qid, 'text' AS field, unnest({d.sql_terms('word')}) AS term
  FROM (SELECT qid, unnest(bow) AS word FROM bows)%s)"""
_ALL_CLAUSES = _BOW_CLAUSES % ""
_KEPT_CLAUSES = _BOW_CLAUSES % f" WHERE word NOT IN ({d.STOP})"


def _scored(df, column="score"):
    return df.withColumn(column, F.round(column, 4) + F.lit(0.0))


@query(f"""WITH {_CLOSED}, {_ALL_CLAUSES}, {d.sql_search('clauses', 'documents', ['doc_id'], 100)}
SELECT qid, doc_id, round(score, 4) + 0 AS score, rank FROM hits""")
def extract_fulltext(spark, sf):
    analysed = qu.analyze_questions(d.questions(spark, sf))
    index = se.build_index(d.documents(spark, sf), ["doc_id"])
    return _scored(an.extract(analysed, index, "fulltext"))


@query(f"""WITH {_LINKED}, {_CLOSED.replace(d.SQL_QUESTIONS + ',', '')},
q_once AS (SELECT qid, lower(surface_form) AS surface, arg_max(label, start) AS label FROM q_links GROUP BY ALL),
clauses AS (
  SELECT qid, 'text' AS field, unnest({d.sql_terms('phrase')}) AS term FROM phrases
  UNION ALL SELECT qid, 'entity', lower(label) FROM q_once
  UNION ALL SELECT qid, 'topic', unnest({d.sql_terms('surface')}) FROM q_once),
{d.sql_search('clauses', 'linked_docs', ['doc_id'], 10,
              {'text': d.sql_terms('text'), 'entity': _ENTITY_TERMS, 'topic': d.sql_terms('source')})}
SELECT qid, doc_id, round(score, 4) + 0 AS score, rank FROM hits""")
def extract_vector_doc(spark, sf):
    docs, _ = _linked(spark, sf)
    analysed = qu.analyze_questions(d.questions(spark, sf), d.gazetteer(spark, sf))
    index = se.build_index(docs, ["doc_id"], {"text": "text", "entity": "uris", "topic": "source"})
    return _scored(an.extract(analysed, index, "vector-doc"))


@query(f"WITH {d.SQL_QUESTIONS} SELECT qid, question, 0 AS docs FROM questions")
def extract_passing(spark, sf):
    """The passing mode finds no documents for any question."""
    asked = d.questions(spark, sf)
    found = an.extract(qu.analyze_questions(asked), None, "passing")
    return asked.join(found, "qid", "left").groupBy("qid", "question").agg(F.count("id").alias("docs"))


_MEANS = """label_means AS (
  SELECT label AS qid, list(m ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
    GROUP BY ALL) GROUP BY label)"""


@query(f"""WITH {_MEANS}, items AS (SELECT 'doc' || vec_id AS item, embedding::DOUBLE[] AS vec FROM embeddings),
{sql_nearest('label_means', 'items', 40)} SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest""")
def nearest_docs(spark, sf):
    emb = d.embeddings(spark, sf)
    means = em.average(emb, "label", 64).select(F.col("label").alias("qid"), "vec")
    stored = emb.select(F.concat(F.lit("doc"), F.col("vec_id").cast("string")).alias("key"), F.col("vec").alias("vector"))
    return _scored(an.nearest_docs(means, stored, "key"))


_BASELINE = f"""{_CLOSED}, {d.SQL_SNIPPETS}, {_KEPT_CLAUSES}, {d.sql_search('clauses', 'snippets', ['id', '"offset"'], 100)}"""


@query(f"""WITH {_BASELINE}
SELECT qid, id, h."offset", round(score, 4) + 0 AS ranking, rank,
  '[id: ' || id || ', corpus: ' || corpus || ', department: ' || department || ', module: ' || module || ']' || chr(10) || text AS candidate
FROM hits h JOIN snippets USING (id, "offset")""")
def candidates_baseline(spark, sf):
    snippets = d.snippets(spark, sf)
    found = an.candidates_baseline(qu.analyze_questions(d.questions(spark, sf)), snippets)
    return _scored(found, "ranking")


_FOCUS_CLAUSES = f"""clauses AS (SELECT qid, 'text' AS field, unnest({d.sql_terms('phrase')}) AS term FROM phrases)"""


@query(f"""WITH {_CLOSED}, {d.SQL_SNIPPETS}, {_FOCUS_CLAUSES}, {d.sql_search('clauses', 'snippets', ['id', '"offset"'], 100)}
SELECT qid, id, "offset", round(score, 4) + 0 AS ranking, rank FROM hits""")
def candidates_focus(spark, sf):
    analysed = qu.analyze_questions(d.questions(spark, sf))
    found = an.candidates_baseline(analysed, d.snippets(spark, sf), use_focus=True, with_text=False)
    return _scored(found, "ranking")


_SNIPPET_PARAS = f"""keyed AS (SELECT id || '@' || "offset" AS item, text FROM snippets),
{_paragraphs('keyed', 'item')},
items AS (SELECT item, list(x ORDER BY pos) AS vec FROM paras GROUP BY item HAVING max(abs(x)) > 0)"""


@query(f"""WITH {d.SQL_VOCAB}, {_CLOSED}, {d.SQL_SNIPPETS}, {_SNIPPET_PARAS},
focus_words AS (SELECT qid, i, unnest({d.sql_tokens('phrase')}) AS word FROM phrases),
focus_sizes AS (SELECT qid, i, count(*) AS n FROM focus_words GROUP BY ALL),
focus_counts AS (SELECT qid, count(*) AS parts FROM focus_sizes GROUP BY qid),
focus_elements AS (SELECT qid, i, unnest(vec) AS x, unnest(range(64)) AS pos FROM focus_words JOIN vocab USING (word)),
targets AS (SELECT qid, list(x ORDER BY pos) AS vec FROM (
  SELECT qid, pos, sum(x / n) / any_value(parts) AS x
  FROM focus_elements JOIN focus_sizes USING (qid, i) JOIN focus_counts USING (qid) GROUP BY ALL) GROUP BY qid),
{sql_nearest('targets', 'items', 40)}
SELECT qid, item, round(score, 4) + 0 AS ranking, rank FROM nearest
UNION ALL SELECT qid, item, 'NaN'::DOUBLE, rank FROM focus_counts, (
  SELECT item, row_number() OVER (ORDER BY item) AS rank FROM keyed) WHERE rank <= 40 AND qid NOT IN (SELECT qid FROM targets)""")
def candidates_vectors_focus(spark, sf):
    """A question without a known word has a zero vector: all its rankings are NaN, ties go by item."""
    analysed = qu.analyze_questions(d.questions(spark, sf))
    found = an.candidates_vectors(analysed, d.snippets(spark, sf), d.vocabulary(spark, sf), use_focus=True)
    return _scored(found.select("qid", F.concat_ws("@", "id", "offset").alias("item"), "ranking", "rank"), "ranking")


@query(f"""WITH {d.SQL_VOCAB}, {d.SQL_SNIPPETS}, {_SNIPPET_PARAS},
asked AS (SELECT word AS qid, vec FROM vocab WHERE NOT word IN ({d.STOP})),
{sql_nearest('asked', 'items', 40)}
SELECT qid, item, round(score, 4) + 0 AS ranking, rank FROM nearest""")
def candidates_vectors(spark, sf):
    """Each known word as a question of one word."""
    vocab = d.vocabulary(spark, sf)
    asked = vocab.select(
        F.col("word").alias("qid"), F.array("word").alias("bow"), F.array().cast("array<string>").alias("focus")
    )
    found = an.candidates_vectors(asked, d.snippets(spark, sf), vocab)
    return _scored(found.select("qid", F.concat_ws("@", "id", "offset").alias("item"), "ranking", "rank"), "ranking")


def _asked_docs(spark, sf):
    """Documents found for a question, with the question's words."""
    analysed = qu.analyze_questions(d.questions(spark, sf))
    docs = d.documents(spark, sf).select("doc_id", "text")
    hits = an.extract(analysed, se.build_index(docs, ["doc_id"]), "fulltext").select("qid", "doc_id")
    return docs, settle(hits.join(analysed.select("qid", "bow"), "qid"))


_PIECES = d.q(fixed.SENTENCE_PATTERN + r"|[.!?\n]")

_PASSAGES = f"""WITH {_CLOSED}, {_ALL_CLAUSES}, {d.sql_search('clauses', 'documents', ['doc_id'], 100)},
pieces AS (SELECT doc_id, unnest(l) AS piece, unnest(range(len(l))) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, {_PIECES}) AS l FROM documents)),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS start FROM pieces),
sents AS (SELECT doc_id, piece, start, list_distinct({d.sql_tokens('piece')}) AS toks,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM placed WHERE NOT regexp_matches(piece, '^[.!?\\n]')),
scored AS (SELECT h.qid, s.doc_id, k, piece, start,
    len(list_intersect(toks, b.bow)) / len(b.bow) AS overlap
  FROM hits h JOIN sents s USING (doc_id) JOIN bows b USING (qid)),
kept AS (SELECT *, k - row_number() OVER (PARTITION BY qid, doc_id ORDER BY k) AS run FROM scored WHERE overlap >= 0.2)
SELECT qid, doc_id, string_agg(piece, ' ' ORDER BY k) AS passage, round(product(overlap), 6) AS ranking, min(start)::BIGINT AS "offset"
FROM kept GROUP BY qid, doc_id, run"""


@query(_PASSAGES)
def extract_passages(spark, sf):
    docs, asked = _asked_docs(spark, sf)
    found = an.extract_passages(lookup_join(docs, asked, "doc_id"), threshold=0.2)  # the texts stay where they are
    return found.withColumn("ranking", F.round("ranking", 6))


@query(_PASSAGES)
def find_passages(spark, sf):
    """The same over stored sentences, each document tokenised once."""
    docs, asked = _asked_docs(spark, sf)
    path = new_folder(spark, "sentences")
    an.sentence_table(docs, "doc_id").write.parquet(path)
    found = an.find_passages(spark.read.parquet(path), asked, "doc_id", threshold=0.2)
    return found.withColumn("ranking", F.round("ranking", 6)).withColumn("offset", F.col("offset").cast("long"))


_RANKED = f"""{_BASELINE},
ranked AS (SELECT qid, id, "offset", score AS ranking, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id, "offset") AS rank FROM hits)"""


def _candidates(spark, sf):
    snippets = d.snippets(spark, sf)
    return an.candidates_baseline(qu.analyze_questions(d.questions(spark, sf)), snippets, with_text=False)


@query(f"""WITH {_RANKED} SELECT qid, id, "offset", round(ranking, 4) + 0 AS ranking, rank, '' AS topic, '' AS lecture FROM ranked""")
def rank_passing(spark, sf):
    return _scored(an.rank_passing(_candidates(spark, sf)), "ranking")


@query(f"""WITH {_RANKED} SELECT qid, id, "offset", round(ranking, 4) + 0 AS ranking, rank, module AS topic, type AS lecture
FROM ranked JOIN transcripts USING (id) WHERE corpus = 'base'""")
def rank_metadata(spark, sf):
    """Metadata from one of the two corpora; candidates of the other drop out."""
    base = d.transcripts(spark, sf).filter("corpus = 'base'")
    return _scored(an.rank_metadata(_candidates(spark, sf), base), "ranking")


@query(f"""WITH {_RANKED} SELECT count(*) AS dropped FROM ranked
WHERE id NOT IN (SELECT id FROM transcripts WHERE corpus = 'base')""")
def unmatched_candidates(spark, sf):
    base = d.transcripts(spark, sf).filter("corpus = 'base'")
    return an.unmatched_candidates(_candidates(spark, sf), base)


@query(f"""WITH {_RANKED} SELECT qid, id, "offset", round(ranking, 4) + 0 AS ranking, ranking > 0.4 AS accepted FROM ranked WHERE rank = 1""")
def select_answer(spark, sf):
    best = an.select_answer(_candidates(spark, sf))
    return _scored(best.select("qid", "id", "offset", "ranking", "accepted"), "ranking")


_OUTCOME = f"""best AS (SELECT *, '' AS topic, '' AS lecture FROM ranked WHERE rank = 1),
outcome AS (SELECT q.qid, CASE WHEN b.qid IS NULL THEN 'failed' WHEN ranking > 0.4 THEN 'answered' ELSE 'no_answer' END AS status,
  CASE WHEN b.qid IS NULL THEN '[FAILED]' WHEN ranking > 0.4 THEN
    '[id: ' || id || ', corpus: ' || corpus || ', department: ' || department || ', module: ' || module || ']' || chr(10) || text
    ELSE '[NO ANSWER]' END AS answer,
  CASE WHEN b.qid IS NULL THEN 0 WHEN ranking > 0.4 THEN round(ranking, 4) + 0 ELSE 1 END::DOUBLE AS ranking,
  CASE WHEN ranking > 0.4 THEN id END AS id, CASE WHEN ranking > 0.4 THEN b."offset" END AS "offset",
  CASE WHEN ranking > 0.4 THEN topic END AS topic, CASE WHEN ranking > 0.4 THEN lecture END AS lecture
FROM %s q LEFT JOIN best b USING (qid) LEFT JOIN snippets USING (id, "offset"))"""

_ASK = f"{_RANKED}, {_OUTCOME % 'questions'}"


@query(f"""WITH {_RANKED}, asked AS (SELECT qid FROM questions UNION ALL SELECT -1 - n_nationkey FROM nation),
{_OUTCOME % 'asked'} SELECT qid, status, ranking FROM outcome""")
def classify_outcome(spark, sf):
    """Questions of the benchmark, and one per nation that finds nothing."""
    asked = d.questions(spark, sf).select("qid")
    silent = d.table(spark, sf, "nation").select((F.lit(-1) - F.col("n_nationkey")).cast("bigint").alias("qid"))
    best = an.select_answer(_candidates(spark, sf))
    found = an.classify_outcome(asked.unionByName(silent), best)
    return _scored(found.select("qid", "status", "ranking"), "ranking")


@query(f"WITH {_ASK} SELECT * FROM outcome")
def ask_batch(spark, sf):
    return _scored(an.ask_batch(d.questions(spark, sf), d.snippets(spark, sf)), "ranking")


_META = _OUTCOME.replace("""SELECT *, '' AS topic, '' AS lecture FROM ranked WHERE rank = 1""", """SELECT r.*, module AS topic, type AS lecture
  FROM ranked r JOIN transcripts USING (id) WHERE corpus = 'base'
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(r.ranking, 6) DESC, id, "offset") = 1""")


@query(f"WITH {_RANKED}, {_META % 'questions'} SELECT * FROM outcome")
def ask_batch_metadata(spark, sf):
    """Topic and lecture from the documents of one corpus; candidates of the other drop out."""
    base = d.transcripts(spark, sf).filter("corpus = 'base'")
    return _scored(an.ask_batch(d.questions(spark, sf), d.snippets(spark, sf), ranking="metadata", docs=base), "ranking")


@query(f"""WITH {d.SQL_VOCAB}, {_CLOSED}, {d.SQL_SNIPPETS}, {_SNIPPET_PARAS},
focus_words AS (SELECT qid, i, unnest({d.sql_tokens('phrase')}) AS word FROM phrases),
focus_sizes AS (SELECT qid, i, count(*) AS n FROM focus_words GROUP BY ALL),
focus_counts AS (SELECT qid, count(*) AS parts FROM focus_sizes GROUP BY qid),
focus_elements AS (SELECT qid, i, unnest(vec) AS x, unnest(range(64)) AS pos FROM focus_words JOIN vocab USING (word)),
targets AS (SELECT qid, list(x ORDER BY pos) AS vec FROM (
  SELECT qid, pos, sum(x / n) / any_value(parts) AS x
  FROM focus_elements JOIN focus_sizes USING (qid, i) JOIN focus_counts USING (qid) GROUP BY ALL) GROUP BY qid),
{sql_nearest('targets', 'items', 40)},
best AS (SELECT qid, item, score FROM nearest WHERE rank = 1)
SELECT q.qid, CASE WHEN f.qid IS NULL THEN 'failed' WHEN score > 0.4 THEN 'answered' ELSE 'no_answer' END AS status,
  CASE WHEN f.qid IS NULL THEN 0 WHEN score > 0.4 THEN round(score, 4) + 0 ELSE 1 END::DOUBLE AS ranking,
  CASE WHEN score > 0.4 THEN item END AS item,
  CASE WHEN score > 0.4 THEN ', topics: List()]' || chr(10) || text END AS tail
FROM questions q LEFT JOIN focus_counts f USING (qid) LEFT JOIN best USING (qid) LEFT JOIN keyed USING (item)""")
def ask_batch_vectors(spark, sf):
    """Vector candidates from stored snippet vectors."""
    snippets, vocab = d.snippets(spark, sf), d.vocabulary(spark, sf)
    path = new_folder(spark, "snippet-vectors")
    an.snippet_vectors(snippets, vocab).write.parquet(path)
    out = an.ask_batch(d.questions(spark, sf), snippets, vocab=vocab, use_focus=True, stored=spark.read.parquet(path))
    item = F.when(F.col("status") == "answered", F.concat_ws("@", "id", "offset")).alias("item")
    tail = F.when(F.col("status") == "answered", F.regexp_extract("answer", r"(?s)(, topics: List\(\)\]\n.*)$", 1)).alias("tail")
    return _scored(out.select("qid", "status", "ranking", item, tail), "ranking")


@query(f"WITH {_ASK} SELECT * FROM outcome")
def ask_stream(spark, sf):
    """The benchmark file as a stream of questions."""
    wh = F.array(*[F.lit(w) for w in d.WH])
    live = d.stream(spark, sf, "benchmark", "item_id bigint, text string").select(
        F.col("item_id").alias("qid"),
        F.concat_ws(" ", F.get(wh, (F.col("item_id") % 8).cast("int")), "text").alias("question"),
    )
    answers, state = new_folder(spark, "answers"), new_folder(spark, "state")
    start_ask_stream(live, d.snippets(spark, sf), answers, state).awaitTermination()
    return _scored(spark.read.parquet(answers).drop("batch"), "ranking")


@query("""SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts), event_id) + 999 AS qid FROM events""")
def assign_question_ids(spark, sf):
    requests = d.table(spark, sf, "events").select("event_id", "ts")
    return an.assign_question_ids(requests, ["ts", "event_id"], first=1000).select("event_id", "qid")
