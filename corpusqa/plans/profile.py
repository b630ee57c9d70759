"""Corpus profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.operators import profile, tables
from corpusqa.plans import data as d
from corpusqa.plans.registry import query
from corpusqa.session import new_folder
from corpusqa.sources import pages


def _lower(spark, sf):
    return d.documents(spark, sf).withColumn("text", F.lower("text"))


_COUNTS = f"""words AS (SELECT doc_id, unnest({d.sql_words('lower(text)')}) AS token FROM documents)"""


@query(f"WITH {_COUNTS} SELECT token, count(*) AS count FROM words GROUP BY token")
def word_count(spark, sf):
    return profile.word_count(_lower(spark, sf))


@query(f"WITH {_COUNTS} SELECT doc_id, token, count(*) AS count FROM words GROUP BY ALL")
def word_count_per_document(spark, sf):
    return profile.word_count(_lower(spark, sf), ["doc_id"])


@query(f"""WITH {_COUNTS} SELECT token, count(*) AS count,
  round(count(*) / (SELECT count(*) FROM words), 8) AS frequency FROM words GROUP BY token""")
def word_frequency(spark, sf):
    return profile.word_frequency(_lower(spark, sf)).withColumn("frequency", F.round("frequency", 8))


@query(f"""WITH {_COUNTS} SELECT doc_id, token, count(*) AS count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 8) AS frequency FROM words GROUP BY doc_id, token""")
def word_frequency_per_document(spark, sf):
    out = profile.word_frequency_per_document(_lower(spark, sf), "doc_id")
    return out.withColumn("frequency", F.round("frequency", 8))


_SENTS = f"""sents AS (
  SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos
  FROM (SELECT doc_id, {d.sql_sentences('lower(text)')} AS s FROM documents)),
kept AS (SELECT doc_id, pos, {d.sql_without_punctuation(d.sql_tokens('sentence'))} AS t FROM sents)"""

_COOC = f"""{_SENTS},
tfs AS (SELECT doc_id, pos, w, count(*) AS tf FROM (SELECT doc_id, pos, unnest(t) AS w FROM kept) GROUP BY ALL),
cooc AS (
  SELECT a.w AS first, b.w AS second, sum(a.tf * b.tf)::BIGINT AS count
  FROM tfs a JOIN tfs b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.w < b.w GROUP BY ALL)"""


@query(f"WITH {_COOC} SELECT * FROM cooc")
def cooc_sentence(spark, sf):
    return profile.cooc_sentence(_lower(spark, sf))


def _adjacent(stop: bool) -> str:
    cut = (
        "coalesce(nullif(list_position(list_transform(range(1, len(t)), lambda i: t[i] = t[i + 1]), true), 0), len(t))"
        if stop
        else "len(t)"
    )
    same = "" if stop else "WHERE t[i] <> t[i + 1]"
    return f"""adjacent AS (
  SELECT least(t[i], t[i + 1]) AS first, greatest(t[i], t[i + 1]) AS second, count(*) AS count
  FROM (SELECT t, unnest(range(1, {cut})) AS i FROM kept WHERE len(t) > 1) {same} GROUP BY ALL)"""


@query(f"WITH {_SENTS}, {_adjacent(True)} SELECT * FROM adjacent")
def cooc_adjacent(spark, sf):
    return profile.cooc_adjacent(_lower(spark, sf))


@query(f"WITH {_SENTS}, {_adjacent(False)} SELECT * FROM adjacent")
def cooc_adjacent_all(spark, sf):
    return profile.cooc_adjacent(_lower(spark, sf), stop_on_repeat=False)


_HIST = f"""lengths AS (
  SELECT len({d.sql_tokens('s')}) AS length FROM (SELECT unnest({d.sql_sentences('text')}) AS s FROM documents))"""


@query(f"WITH {_HIST} SELECT length, count(*) AS count FROM lengths GROUP BY length")
def sentence_length_hist(spark, sf):
    return profile.sentence_length_hist(d.documents(spark, sf))


@query(f"WITH {_HIST} SELECT round(avg(length), 6) AS avg_sentence_length FROM lengths")
def avg_sentence_length(spark, sf):
    out = profile.avg_sentence_length(d.documents(spark, sf))
    return out.select(F.round("avg_sentence_length", 6).alias("avg_sentence_length"))


@query("""SELECT 'department' AS dimension, source AS key, count(*) AS count FROM documents GROUP BY source
UNION ALL SELECT 'module', lang, count(*) FROM documents GROUP BY lang""")
def dimension_count(spark, sf):
    docs = d.table(spark, sf, "documents")
    parts = [
        profile.dimension_count(docs, column).withColumn("dimension", F.lit(name))
        for name, column in (("department", "source"), ("module", "lang"))
    ]
    return parts[0].unionByName(parts[1])


@query("SELECT count(*) AS docs FROM documents")
def doc_count(spark, sf):
    return profile.doc_count(d.table(spark, sf, "documents"))


@query(f"""WITH {_HIST}, {d.SQL_WORDS}
SELECT count(*) AS docs, (SELECT sum(count)::BIGINT FROM word_counts) AS words, (SELECT count(*) FROM word_counts) AS unique_words,
  count(DISTINCT source) AS departments, count(DISTINCT lang) AS modules,
  (SELECT round(avg(length), 6) FROM lengths) AS avg_sentence_length FROM documents""")
def corpus_stats(spark, sf):
    out = profile.corpus_stats(d.documents(spark, sf), "source", "lang")
    return out.withColumn("avg_sentence_length", F.round("avg_sentence_length", 6))


_PROFILE = f"""{_COUNTS}, {_SENTS}, {_adjacent(True)},
profile AS (
  SELECT 'general' AS section, 'docs' AS key, count(*) AS count FROM documents
  UNION ALL SELECT 'department', source, count(*) FROM documents GROUP BY source
  UNION ALL SELECT 'module', lang, count(*) FROM documents GROUP BY lang
  UNION ALL SELECT 'sentence_length', len({d.sql_tokens('sentence')})::VARCHAR, count(*) FROM sents GROUP BY ALL
  UNION ALL SELECT 'word', token, count(*) FROM words GROUP BY ALL
  UNION ALL SELECT 'tag', {d.sql_tag('token')} || ',' || token, count(*) FROM words GROUP BY ALL
  UNION ALL SELECT 'word_pair', first || ',' || second, count FROM adjacent)"""


@query(f"WITH {_PROFILE} SELECT * FROM profile")
def corpus_profile(spark, sf):
    return profile.corpus_profile(d.documents(spark, sf), "source", "lang")


@query("""SELECT key, sum(count)::BIGINT AS count FROM (
  SELECT source AS key, count(*) AS count FROM documents GROUP BY source
  UNION ALL SELECT 'src' || (doc_id % 7), count(*) FROM labels GROUP BY ALL) GROUP BY key""")
def merge_counts(spark, sf):
    one = profile.dimension_count(d.table(spark, sf, "documents"), "source")
    labels = d.table(spark, sf, "labels")
    two = profile.dimension_count(
        labels.select(F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("k")), "k"
    )
    return profile.merge_counts(one, two, keys=["key"])


@query(f"""WITH {d.SQL_WORDS} SELECT {d.sql_tag('token')} AS tag, lower(token) AS surface, sum(count)::BIGINT AS count
FROM word_counts GROUP BY ALL""")
def tag_counts(spark, sf):
    return profile.tag_counts(d.documents(spark, sf))


@query(f"""WITH {d.SQL_GAZETTEER}, {d.sql_links('links', 'documents', 'doc_id')}
SELECT label, lower(surface_form) AS surface, count(*) AS count FROM links GROUP BY ALL""")
def tag_counts_entities(spark, sf):
    return profile.tag_counts_entities(d.documents(spark, sf), d.gazetteer(spark, sf))


@query(f"""WITH {d.SQL_QA}, inside AS (SELECT * FROM qa_questions WHERE area = 'Science')
SELECT 'category' AS kind, last AS key, count(*) AS count FROM inside GROUP BY last
UNION ALL SELECT 'total', 'sum', count(*) FROM inside
UNION ALL SELECT 'total', 'taken', count(*) FROM inside WHERE taken""")
def category_counts(spark, sf):
    return profile.category_counts(d.qa_questions(spark, sf), "Science")


@query("SELECT len(embedding) AS dimension, count(*) AS count FROM embeddings GROUP BY ALL")
def vector_dimensions(spark, sf):
    return profile.vector_dimensions(d.embeddings(spark, sf))


@query(f"""WITH {_PROFILE}, nos AS (
  SELECT * FROM (VALUES ('department', 1), ('module', 2), ('sentence_length', 3), ('tag', 5), ('word_pair', 6), ('word', 8)) v(section, section_no))
SELECT 0 AS section_no, 'general' AS section, '# Documents;' || count AS "row" FROM profile WHERE section = 'general'
UNION ALL SELECT 0, 'general', '# Words;' || sum(count)::BIGINT FROM profile WHERE section = 'word'
UNION ALL SELECT 0, 'general', '# Unique Words;' || count(*) FROM profile WHERE section = 'word'
UNION ALL SELECT section_no, section, key || ';' || CASE WHEN section = 'word'
  THEN format('{{:.6f}}', count / (SELECT sum(count) FROM profile WHERE section = 'word')) || ';' ELSE '' END || count
FROM profile JOIN nos USING (section)""")
def profile_report(spark, sf):
    return tables.profile_report(profile.corpus_profile(d.documents(spark, sf), "source", "lang"))


@query(f"""WITH {d.SQL_WORDS}, old AS (
  SELECT 'word' AS section, token AS key, count FROM word_counts),
new AS (SELECT 'word', unnest({d.sql_words('text')}), 1 FROM conversations
  UNION ALL SELECT 'long', text, 1 FROM documents)
SELECT section, key, sum(count)::BIGINT AS count
FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY ALL""")
def upsert_counts(spark, sf):
    docs = d.documents(spark, sf)
    section = F.lit("word").alias("section")
    old = profile.word_count(docs).select(section, F.col("token").alias("key"), "count")
    turns = d.table(spark, sf, "conversations")
    added = profile.word_count(turns).select(section, F.col("token").alias("key"), "count")
    long_keys = docs.select(F.lit("long").alias("section"), F.col("text").alias("key"), F.lit(1).cast("bigint").alias("count"))
    return tables.upsert_counts(old, added.unionByName(long_keys))


@query(f"""WITH {d.SQL_WORDS} SELECT 'word' AS section, token AS key, count FROM word_counts
UNION ALL SELECT 'department', source, count(*) FROM documents GROUP BY source""")
def write_kv_csv(spark, sf):
    """Counts written as ``key;count`` files and read back."""
    docs = d.documents(spark, sf)
    words = profile.word_count(docs).select(F.lit("word").alias("section"), F.col("token").alias("key"), "count")
    places = profile.dimension_count(docs, "source").select(F.lit("department").alias("section"), "key", "count")
    path = new_folder(spark, "kv")
    tables.write_kv_csv(words.unionByName(places), path)
    # a key may hold the separator: the count is what follows the last one
    lines = spark.read.text(path)
    return lines.select(
        F.col("section").cast("string").alias("section"),
        F.regexp_extract("value", r"^(.*);([0-9]+)$", 1).alias("key"),
        F.regexp_extract("value", r"^(.*);([0-9]+)$", 2).cast("bigint").alias("count"),
    )


def _forms(x: str) -> str:
    flags = ", ".join(f"CASE WHEN regexp_matches({x}, {d.q(p)}) THEN ', {n}' ELSE '' END" for n, p in fixed.WH_FORMS)
    return f"concat({flags})"


@query(f"""WITH {d.SQL_QA}, typed AS (SELECT *, {_forms('question')} AS types FROM qa_questions)
SELECT question || '#' || id || '#' || last || '#' || types || '#1' AS "row"
FROM typed WHERE area = 'Science' AND taken AND types <> ''""")
def export_selected_questions(spark, sf):
    return tables.export_selected_questions(pages.annotate_wh(d.qa_questions(spark, sf)), "Science")
