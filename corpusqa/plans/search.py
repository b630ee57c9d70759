"""Full-text search, entity linking and triple queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusqa.functions import text as tx
from corpusqa.operators import entities as en
from corpusqa.operators import search as se
from corpusqa.operators import stored_index as si
from corpusqa.operators import triple_store as ts
from corpusqa.operators import triples as tr
from corpusqa.plans import data as d
from corpusqa.plans.registry import query
from corpusqa.session import new_folder
from corpusqa.sources import records

_DOC_TERMS = f"""terms AS (
  SELECT doc_id, len(l) AS length, unnest(l) AS term FROM (SELECT doc_id, {d.sql_terms('text')} AS l FROM documents))"""


def _index(spark, sf):
    return se.build_index(d.documents(spark, sf), ["doc_id"])


@query(f"WITH {_DOC_TERMS} SELECT doc_id, 'text' AS field, term, length, count(*) AS tf FROM terms GROUP BY ALL")
def build_index(spark, sf):
    return _index(spark, sf).postings


@query(f"WITH {_DOC_TERMS} SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df FROM terms GROUP BY ALL")
def document_frequency(spark, sf):
    return se.document_frequency(_index(spark, sf))


def _question_words(spark, sf):
    return d.questions(spark, sf).withColumn("words", tx.tokens(F.col("question")))


_CLAUSES = f"""{d.SQL_QUESTIONS},
clauses AS (SELECT qid, 'text' AS field, unnest({d.sql_terms('question')}) AS term FROM questions)"""


def _ranked(hits):
    return hits.withColumn("score", F.round("score", 4))


@query(f"""WITH {_CLAUSES}, {d.sql_search('clauses', 'documents', ['doc_id'], 100)}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find_terms(spark, sf):
    return _ranked(se.find_terms(_index(spark, sf), _question_words(spark, sf), "qid", "words"))


@query(f"""WITH {_CLAUSES}, {d.sql_search('clauses', 'documents', ['doc_id'], 100, scoring='bm25')}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find_terms_bm25(spark, sf):
    return _ranked(se.find_terms(_index(spark, sf), _question_words(spark, sf), "qid", "words", scoring="bm25"))


@query(f"""WITH {_CLAUSES}, {d.sql_search('clauses', 'documents', ['doc_id'], 100)}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find_terms_stored_index(spark, sf):
    """The same search on a stored index, which skips postings by score bounds."""
    index = si.write_index(_index(spark, sf))
    return _ranked(se.find_terms(index, _question_words(spark, sf), "qid", "words"))


@query(f"""WITH {_CLAUSES}, {d.sql_search('clauses', 'documents', ['doc_id'], 100, scoring='bm25')}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find_terms_stored_bm25(spark, sf):
    index = si.write_index(_index(spark, sf))
    return _ranked(se.find_terms(index, _question_words(spark, sf), "qid", "words", scoring="bm25"))


def _segmented(spark, sf):
    # first a part of the documents, some of them in an older form; then the rest, and the newer forms
    docs = d.documents(spark, sf).select("doc_id", "text")
    older = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old form "), "text")).otherwise(F.col("text"))
    index = si.write_index(se.build_index(docs.filter("doc_id % 3 <> 0").withColumn("text", older), ["doc_id"]))
    return si.add_documents(index, docs.filter("doc_id % 3 = 0 OR doc_id % 5 = 0"))


@query(f"""WITH {_CLAUSES}, {d.sql_search('clauses', 'documents', ['doc_id'], 100)}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find_terms_segments(spark, sf):
    """Search over an index in segments, with replaced documents: as over one index of all."""
    return _ranked(se.find_terms(_segmented(spark, sf), _question_words(spark, sf), "qid", "words"))


@query(f"""WITH kept AS (SELECT * FROM documents WHERE lang <> 'de'), {_DOC_TERMS.replace('FROM documents', 'FROM kept')}
SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df FROM terms GROUP BY ALL""")
def delete_from_index(spark, sf):
    """Document frequencies of an index after documents were deleted from it."""
    index = si.write_index(_index(spark, sf))
    gone = d.documents(spark, sf).filter("lang = 'de'").select("doc_id")
    return si.delete_documents(index, gone).frequencies.select("field", "term", "df")


@query(f"""WITH {_CLAUSES}, {_DOC_TERMS}
SELECT qid, 'text' AS field, c.term, count(DISTINCT t.doc_id) AS df FROM (SELECT DISTINCT qid, term FROM clauses) c JOIN terms t ON t.term = c.term GROUP BY ALL""")
def postings_read(spark, sf):
    """The terms of the questions whose postings a search looks at; at least one of them, at most all."""
    read = si.postings_read(si.write_index(_index(spark, sf)), se.clauses(_question_words(spark, sf), "qid", "words"), "qid")
    return read.filter("read between 0 and df").select("qid", "field", "term", "df")


def _linked(spark, sf):
    """Documents with the URIs of their links, and questions with theirs."""
    gaz = d.gazetteer(spark, sf)
    docs = d.documents(spark, sf)
    asked = d.questions(spark, sf)
    uris = F.array_sort(F.collect_list("uri")).alias("uris")
    doc_links = en.link_entities(docs.select("doc_id", "text"), gaz, "doc_id").groupBy("doc_id").agg(uris)
    q_links = en.link_entities(asked, gaz, "qid", "question").groupBy("qid").agg(uris)
    return docs.join(doc_links, "doc_id", "left"), asked.join(q_links, "qid", "left")


_LINKED = f"""{d.SQL_GAZETTEER}, {d.SQL_QUESTIONS},
{d.sql_links('doc_links', 'documents', 'doc_id')},
{d.sql_links('q_links', 'questions', 'qid', 'question')},
linked_docs AS (
  SELECT doc_id, source, text, coalesce(uris, []) AS uris FROM documents
  LEFT JOIN (SELECT doc_id, list(uri) AS uris FROM doc_links GROUP BY doc_id) USING (doc_id))"""

_ENTITY_TERMS = f"flatten(list_transform(uris, lambda u: {d.sql_terms('u')}))"
_ENTITY_CLAUSES = f"SELECT qid, 'entity' AS field, unnest({d.sql_terms('uri')}) AS term FROM q_links"


@query(f"""WITH {_LINKED}, clauses AS ({_ENTITY_CLAUSES}),
{d.sql_search('clauses', 'linked_docs', ['doc_id'], 10, {'entity': _ENTITY_TERMS})}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find_entities(spark, sf):
    docs, asked = _linked(spark, sf)
    index = se.build_index(docs, ["doc_id"], {"entity": "uris"})
    asked = asked.filter(F.col("uris").isNotNull())
    return _ranked(se.find_entities(index, asked, "qid", "uris"))


@query(f"""WITH clauses AS (SELECT source AS qid, 'topic' AS field, unnest({d.sql_terms('source')}) AS term
  FROM (SELECT DISTINCT source FROM documents)),
{d.sql_search('clauses', 'documents', ['doc_id'], 10, {'topic': d.sql_terms('source')})}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find_topics(spark, sf):
    docs = d.documents(spark, sf)
    index = se.build_index(docs, ["doc_id"], {"topic": "source"})
    topics = docs.select(F.col("source").alias("qid"), F.array("source").alias("topics")).distinct()
    return _ranked(se.find_topics(index, topics, "qid", "topics"))


@query(f"""WITH {_LINKED}, clauses AS (
  SELECT qid, 'text' AS field, unnest({d.sql_terms('question')}) AS term FROM questions
  UNION ALL {_ENTITY_CLAUSES}
  UNION ALL SELECT qid, 'topic', 'src' || (qid % 20) FROM questions),
{d.sql_search('clauses', 'linked_docs', ['doc_id'], 10,
              {'text': d.sql_terms('text'), 'entity': _ENTITY_TERMS, 'topic': d.sql_terms('source')})}
SELECT qid, doc_id, round(score, 4) AS score, rank FROM hits""")
def find(spark, sf):
    docs, asked = _linked(spark, sf)
    index = se.build_index(docs, ["doc_id"], {"text": "text", "entity": "uris", "topic": "source"})
    asked = asked.select(
        "qid",
        tx.tokens(F.col("question")).alias("words"),
        F.coalesce("uris", F.array().cast("array<string>")).alias("uris"),
        F.array(F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))).alias("topics"),
    )
    return _ranked(se.find(index, asked, "qid", "words", "uris", "topics"))


@query(f"""WITH {d.SQL_SNIPPETS} SELECT id, "offset", text FROM snippets
WHERE id IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)""")
def find_id(spark, sf):
    wanted = d.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return se.find_id(d.snippets(spark, sf), wanted).select("id", "offset", "text")


@query("""SELECT item_id * 11 AS doc_id, lang, n_chars FROM benchmark
LEFT JOIN documents ON documents.doc_id = item_id * 11""")
def get_id(spark, sf):
    wanted = d.table(spark, sf, "benchmark").select((F.col("item_id") * 11).alias("doc_id"))
    docs = d.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return se.get_id(docs, wanted, "doc_id")


def _stored_vectors(spark, sf):
    # every third vector is stored for another model only; labels stand in as elements that are no numbers
    emb = d.embeddings(spark, sf)
    strings = F.transform("vec", lambda x: x.cast("string"))
    texts = F.concat(strings, F.array(F.concat(F.lit("n"), F.col("label").cast("string"))))
    model = F.when(F.col("vec_id") % 3 == 0, "other").otherwise("main")
    return emb.select(
        F.concat(F.lit("key"), F.col("vec_id").cast("string")).alias("key"),
        F.col("label").cast("string").alias("id"),
        F.create_map(model, texts).alias("vectors"),
    )


_STORED = """stored AS (
  SELECT 'key' || vec_id AS key, label::VARCHAR AS id, unnest(embedding::DOUBLE[] || [0.0::DOUBLE]) AS value, unnest(range(65)) AS pos
  FROM embeddings WHERE vec_id % 3 <> 0)"""


def _elements(df, keys, vec="vector"):
    return df.select(*keys, F.posexplode(vec).alias("pos", "value")).withColumn(
        "value", F.round("value", 4) + F.lit(0.0)
    )


@query(f"WITH {_STORED} SELECT key, id, pos, round(value, 4) + 0 AS value FROM stored")
def vectors(spark, sf):
    return _elements(se.vectors(_stored_vectors(spark, sf), "main", "key"), ["key", "id"])


@query(f"""WITH {_STORED} SELECT key, id, pos, round(value, 4) + 0 AS value FROM stored
WHERE id IN (SELECT n_regionkey::VARCHAR FROM nation)""")
def vector_doc(spark, sf):
    wanted = d.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("id"))
    found = se.vector_doc(_stored_vectors(spark, sf), wanted, "main", "key")
    return _elements(found, ["key", "id"])


_ENTITY_ROWS = """entity_rows AS (
  SELECT p_name || ' ' || p_type AS key, 'http://kb.example/part' || p_partkey AS entity FROM part)"""


@query(f"""WITH {_ENTITY_ROWS},
clauses AS (SELECT DISTINCT p_name AS qid, 'text' AS field, unnest({d.sql_terms('p_name')}) AS term
  FROM (SELECT DISTINCT p_name FROM part)),
{d.sql_search('clauses', 'entity_rows', ['entity', 'key'], 10, {'text': d.sql_terms('key')})}
SELECT qid, entity, key, round(score, 4) AS score, rank FROM hits""")
def search_entity(spark, sf):
    part = d.table(spark, sf, "part")
    rows = part.select(
        F.concat_ws(" ", "p_name", "p_type").alias("key"),
        F.concat(F.lit("http://kb.example/part"), F.col("p_partkey").cast("string")).alias("entity"),
    )
    asked = part.select(F.col("p_name").alias("qid"), F.col("p_name").alias("text")).distinct()
    return _ranked(se.search_entity(rows, asked, "qid", "text"))


@query("""SELECT event_id AS id, 'http://kb.example/' || event_type AS uri, value AS probability, user_id AS start
FROM events WHERE event_type <> 'error'""")
def parse_clues(spark, sf):
    events = d.table(spark, sf, "events")
    raw = F.create_map(
        F.lit("id"), F.concat(F.lit("http://kb.example/"), F.col("event_type")),
        F.lit("type"), F.lit("entity"),
        F.lit("probability"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")),
        F.lit("start"), F.col("user_id").cast("string"),
        F.lit("length"), F.lit("3"),
        F.lit("surfaceForm"), F.col("event_type"),
    )
    docs = events.select(F.col("event_id").alias("id"), F.array(raw).alias("clues"))
    return se.parse_clues(docs).select("id", F.explode("clues").alias("c")).select(
        "id", F.col("c.id").alias("uri"), "c.probability", "c.start"
    )


# ---- entities ----


@query(f"""WITH {d.SQL_GAZETTEER}, {d.sql_links('links', 'documents', 'doc_id')} SELECT * FROM links""")
def link_entities(spark, sf):
    docs = d.documents(spark, sf).select("doc_id", "text")
    return en.link_entities(docs, d.gazetteer(spark, sf), "doc_id").drop("types")


@query(f"WITH {d.SQL_GAZETTEER} SELECT surface, uri, label, support, score FROM strong")
def filter_links(spark, sf):
    return en.filter_links(d.gazetteer(spark, sf)).drop("types")


@query(f"""WITH {d.SQL_GAZETTEER}, {d.sql_links('links', 'documents', 'doc_id')}
SELECT doc_id, coalesce(n, 0) AS n_clues, coalesce(clues, '') AS clues FROM documents LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(uri || '@' || start, ' ' ORDER BY start) AS clues FROM links GROUP BY doc_id) USING (doc_id)""")
def attach_clues(spark, sf):
    docs = en.clear_clues(d.documents(spark, sf).select("doc_id", "text"))
    links = en.link_entities(docs, d.gazetteer(spark, sf), "doc_id")
    done = en.attach_clues(docs, links, "doc_id")
    shown = F.transform("clues", lambda c: F.concat(c["id"], F.lit("@"), c["start"].cast("string")))
    return done.select("doc_id", F.size("clues").cast("bigint").alias("n_clues"), F.array_join(shown, " ").alias("clues"))


@query("SELECT doc_id, lang, n_chars, 0 AS n_clues FROM documents")
def clear_clues(spark, sf):
    """Documents that hold a clue each, cleared; their other columns stay."""
    docs = d.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.array(F.col("source")).alias("clues"))
    return en.clear_clues(docs).select("doc_id", "lang", "n_chars", F.size("clues").alias("n_clues"))


_Q_ENTITIES = f"""{d.SQL_GAZETTEER}, {d.SQL_QUESTIONS}, {d.sql_links('q_links', 'questions', 'qid', 'question')},
q_once AS (
  SELECT qid, lower(surface_form) AS surface, arg_max(label, start) AS label, max(start) AS start
  FROM q_links GROUP BY ALL),
q_entities AS (
  SELECT qid, string_agg(surface || '=' || label, ',' ORDER BY surface) AS entities,
         arg_max(label, start) AS last_label, arg_max(surface, start) AS last_entity FROM q_once GROUP BY qid)"""


@query(f"WITH {_Q_ENTITIES} SELECT * FROM q_entities")
def question_entities(spark, sf):
    found = en.question_entities(d.questions(spark, sf), d.gazetteer(spark, sf), "qid")
    return found.withColumn("entities", joined_map("entities"))


def joined_map(column: str):
    """A map as ``key=value,...`` in key order."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query(f"""SELECT conv_id, pos, token, {d.sql_tag('token')} AS tag FROM (
  SELECT conv_id || '-' || turn AS conv_id, unnest(l) AS token, unnest(range(len(l))) AS pos
  FROM (SELECT conv_id, turn, {d.sql_tokens('text')} AS l FROM conversations))""")
def tag_tokens(spark, sf):
    turns = d.table(spark, sf, "conversations")
    return en.tag_tokens(turns.select(F.concat_ws("-", "conv_id", "turn").alias("conv_id"), "text"), "conv_id")


# ---- triples ----

_BASE = "http://kb.example/ontology/"


def _triples(spark, sf):
    def rows(df, s, p, o, lang=""):
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(lang).alias("lang"))

    nation, region = d.table(spark, sf, "nation"), d.table(spark, sf, "region")
    customer, supplier = d.table(spark, sf, "customer"), d.table(spark, sf, "supplier")
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        rows(nations, F.col("n_name"), f"{_BASE}inRegion", F.col("r_name")),
        rows(customers, F.col("c_name"), f"{_BASE}inNation", F.col("n_name")),
        rows(suppliers, F.col("s_name"), f"{_BASE}inNation", F.col("n_name")),
        rows(nation, F.col("n_name"), tr.RDF_TYPE, F.lit("Nation")),
        rows(region, F.col("r_name"), tr.RDF_TYPE, F.lit("Region")),
        rows(customer, F.col("c_name"), tr.RDF_TYPE, F.lit("Customer")),
        rows(customer, F.col("c_mktsegment"), tr.RDF_TYPE, F.lit(tr.RDF_PROPERTY)),
        rows(customer, F.col("c_mktsegment"), tr.RDFS_LABEL, F.lower("c_mktsegment"), "en"),
        rows(customer, F.col("c_mktsegment"), tr.RDFS_LABEL, F.lower("c_name"), "de"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_TRIPLES = f"""triples AS (
  SELECT n_name AS s, '{_BASE}inRegion' AS p, r_name AS o, '' AS lang FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, '{_BASE}inNation', n_name, '' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, '{_BASE}inNation', n_name, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, '{tr.RDF_TYPE}', 'Nation', '' FROM nation
  UNION ALL SELECT r_name, '{tr.RDF_TYPE}', 'Region', '' FROM region
  UNION ALL SELECT c_name, '{tr.RDF_TYPE}', 'Customer', '' FROM customer
  UNION ALL SELECT c_mktsegment, '{tr.RDF_TYPE}', '{tr.RDF_PROPERTY}', '' FROM customer
  UNION ALL SELECT c_mktsegment, '{tr.RDFS_LABEL}', lower(c_mktsegment), 'en' FROM customer
  UNION ALL SELECT c_mktsegment, '{tr.RDFS_LABEL}', lower(c_name), 'de' FROM customer)"""


@query(f"WITH {_TRIPLES} SELECT * FROM triples")
def read_triples(spark, sf):
    """Triples written as N-Triples files and read back."""
    t = _triples(spark, sf)
    iri = F.format_string("<%s>", "p")
    obj = F.when(F.col("lang") != "", F.format_string('"%s"@%s', "o", "lang")).otherwise(F.format_string('"%s"', "o"))
    lines = t.select(F.concat(F.format_string("<%s> ", "s"), iri, F.lit(" "), obj, F.lit(" .")).alias("value"))
    path = new_folder(spark, "triples")
    lines.write.text(path)
    return records.read_triples(spark, path)


@query(f"WITH {_TRIPLES} SELECT o AS object, s AS subject FROM triples WHERE p = '{_BASE}inNation'")
def entities_of_predicate(spark, sf):
    return tr.entities_of_predicate(_triples(spark, sf), f"{_BASE}inNation")


@query(f"""WITH {_TRIPLES} SELECT s, o FROM triples WHERE p = '{tr.RDFS_LABEL}' AND lang = 'en'
AND s IN (SELECT s FROM triples WHERE p = '{tr.RDF_TYPE}' AND o = '{tr.RDF_PROPERTY}')""")
def predicate_list(spark, sf):
    return tr.predicate_list(_triples(spark, sf))


@query(f"WITH {_TRIPLES} SELECT o AS key, s AS entity FROM triples WHERE p IN ('{_BASE}inNation', '{_BASE}inRegion')")
def build_entity_index(spark, sf):
    return tr.build_entity_index(_triples(spark, sf), ["inNation", f"{_BASE}inRegion"])


@query(f"""WITH {_TRIPLES} SELECT DISTINCT s AS name FROM triples WHERE p = '{tr.RDF_TYPE}' AND o = 'Customer'
AND s IN (SELECT s FROM triples WHERE p = '{_BASE}inNation' AND contains(o, '1'))""")
def of_type(spark, sf):
    triples = _triples(spark, sf)
    clause = triples.filter((F.col("p") == f"{_BASE}inNation") & F.col("o").contains("1")).select("s")
    return tr.of_type(triples, "Customer", clause)


def _stored_triples(spark, sf):
    path = new_folder(spark, "triple-store")
    ts.write_triples(_triples(spark, sf), path)
    return ts.open_triples(spark, path)


@query(f"WITH {_TRIPLES} SELECT o AS object, s AS subject FROM triples WHERE p = '{_BASE}inNation'")
def entities_of_predicate_stored(spark, sf):
    """By local name, from the folder of that name."""
    return ts.entities_of_predicate(_stored_triples(spark, sf), "inNation")


@query(f"""WITH {_TRIPLES} SELECT s, o FROM triples WHERE p = '{tr.RDFS_LABEL}' AND lang = 'en'
AND s IN (SELECT s FROM triples WHERE p = '{tr.RDF_TYPE}' AND o = '{tr.RDF_PROPERTY}')""")
def predicate_list_stored(spark, sf):
    return ts.predicate_list(_stored_triples(spark, sf))


@query(f"WITH {_TRIPLES} SELECT o AS key, s AS entity FROM triples WHERE p IN ('{_BASE}inNation', '{_BASE}inRegion')")
def build_entity_index_stored(spark, sf):
    return ts.build_entity_index(_stored_triples(spark, sf), ["inNation", f"{_BASE}inRegion"])


@query(f"""WITH {_TRIPLES} SELECT DISTINCT s AS name FROM triples WHERE p = '{tr.RDF_TYPE}' AND o = 'Customer'
AND s IN (SELECT s FROM triples WHERE p = '{_BASE}inNation' AND contains(o, '1'))""")
def of_type_stored(spark, sf):
    store = _stored_triples(spark, sf)
    clause = store.of_predicates(["inNation"]).filter(F.col("o").contains("1")).select("s")
    return ts.of_type(store, "Customer", clause)
