"""Text and cutting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.functions import text as tx
from corpusqa.operators import profile, snippets
from corpusqa.plans import data as d
from corpusqa.plans.registry import query
from corpusqa.sources import pages as pg
from corpusqa.sources import wiki


def _rows(expr: str, name: str, source: str = "documents", key: str = "doc_id") -> str:
    return (
        f"SELECT {key}, unnest(l) AS {name}, unnest(range(len(l))) AS pos "
        f"FROM (SELECT {key}, {expr} AS l FROM {source})"
    )


@query(_rows(d.sql_tokens("text"), "token"))
def tokenize(spark, sf):
    docs = d.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))


@query(_rows(d.sql_sentences("text"), "sentence"))
def sentences(spark, sf):
    docs = d.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT DISTINCT doc_id, unnest({d.sql_words('lower(text)')}) AS token FROM documents")
def bag_of_words(spark, sf):
    docs = d.documents(spark, sf)
    return docs.select("doc_id", F.explode(tx.bag_of_words(F.lower("text"))).alias("token"))


@query(f"""SELECT doc_id, array_to_string(list_filter({d.sql_words('lower(text)')}, lambda t: t NOT IN ({d.STOP})), ' ') AS kept
FROM documents""")
def drop_stopwords(spark, sf):
    kept = tx.without_stopwords(tx.words(F.lower("text")))
    return d.documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query(f"""SELECT doc_id, array_to_string({d.sql_without_punctuation(d.sql_words('text'))}, ' ') AS kept FROM documents""")
def drop_punct_tokens(spark, sf):
    kept = tx.without_punctuation(tx.words(F.col("text")))
    return d.documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query(r"""SELECT page_id, regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<.+?>\s*', '', 'g'),
  '[ ]*(\r)?\n[ ]*', ' ', 'g'), '\''', ''), chr(9), ' '), '[ ]+', ' ', 'g') AS text FROM pages""")
def flatten_markup(spark, sf):
    return d.table(spark, sf, "pages").select(
        "page_id", tx.flatten_markup(F.col("html")).alias("text")
    )


@query(f'WITH {d.SQL_SNIPPETS} SELECT id, corpus, "offset", text FROM snippets')
def split_snippets(spark, sf):
    return d.snippets(spark, sf).select("id", "corpus", "offset", "text")


@query(r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_replace(unnest(l), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS word, unnest(range(len(l))) AS i, len(l) AS n
  FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
walk AS (
  SELECT doc_id, -1::BIGINT AS i, any_value(n) AS n, '' AS chunk, 0::BIGINT AS "offset", 0::BIGINT AS closed_at, '' AS closed, false AS full_ FROM words GROUP BY doc_id
  UNION ALL
  SELECT doc_id, i, n, CASE WHEN f THEN word ELSE chunk || ' ' || word END, CASE WHEN f THEN "offset" + length(chunk) + 1 ELSE "offset" END, "offset", chunk, f
  FROM (SELECT w.doc_id, s.i, w.n, w.chunk, w."offset", s.word, length(s.word) + length(w.chunk) > 500 AS f
        FROM walk w JOIN words s ON s.doc_id = w.doc_id AND s.i = w.i + 1))
SELECT doc_id, closed_at AS "offset", closed AS chunk FROM walk WHERE full_
UNION ALL SELECT doc_id, "offset", chunk FROM walk WHERE i = n - 1 AND chunk <> ''""")
def chunk_by_chars(spark, sf):
    return snippets.chunk_by_chars(d.documents(spark, sf).select("doc_id", "text"))


_BARE = (
    r"list_filter(list_transform(regexp_split_to_array(text, '[ \t\n\r\f]+'), "
    r"lambda w: regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')), lambda w: w <> '')"
)


@query(f"""SELECT doc_id, block, 'SENT_' || block AS label, array_to_string(l[(block - 1) * 100 + 1:block * 100], ' ') AS words
FROM (SELECT doc_id, l, unnest(range(1, ceil(len(l) / 100.0)::BIGINT + 1)) AS block
      FROM (SELECT doc_id, {_BARE} AS l FROM documents))""")
def word_blocks(spark, sf):
    blocks = snippets.word_blocks(d.documents(spark, sf).select("doc_id", "text"))
    return blocks.withColumn("words", F.array_join("words", " "))


_SPACED = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@query(f"""SELECT doc_id, line_no, array_to_string(l[(line_no - 1) * 101 + 1:line_no * 101], ' ') AS line
FROM (SELECT doc_id, l, unnest(range(1, ceil(len(l) / 101.0)::BIGINT + 1)) AS line_no
      FROM (SELECT doc_id, {_SPACED} AS l FROM documents))""")
def word_lines(spark, sf):
    return snippets.word_lines(d.documents(spark, sf).select("doc_id", "text"))


@query(r"""WITH RECURSIVE recs AS (
  SELECT doc_id, unnest(l) AS rec, unnest(range(len(l))) AS i, len(l) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
sized AS (SELECT *, length(rec) - length(replace(rec, ' ', '')) AS blanks FROM recs),
walk AS (
  SELECT doc_id, i, n, rec AS line, blanks AS spaces, 0 AS line_no FROM sized WHERE i = 0
  UNION ALL
  SELECT s.doc_id, s.i, s.n, CASE WHEN w.spaces > 100 THEN s.rec ELSE w.line || s.rec END,
         CASE WHEN w.spaces > 100 THEN s.blanks ELSE w.spaces + s.blanks END,
         CASE WHEN w.spaces > 100 THEN w.line_no + 1 ELSE w.line_no END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
SELECT doc_id, line_no, line FROM walk WHERE spaces > 100 OR (i = n - 1 AND line <> '')""")
def pack_by_spaces(spark, sf):
    return snippets.pack_by_spaces(d.documents(spark, sf).select("doc_id", "text"))


@query(f"SELECT doc_id, array_to_string({_BARE}, ' ') AS words FROM documents")
def strip_token_punct(spark, sf):
    bare = tx.strip_token_punctuation(F.col("text"))
    return d.documents(spark, sf).select("doc_id", F.array_join(bare, " ").alias("words"))


@query("""WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no, len(l) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
SELECT 0 AS epoch, doc_id, line_no, line FROM lines WHERE line_no * 2 < n
UNION ALL SELECT 1, doc_id, line_no, line FROM lines WHERE line_no * 2 >= n
UNION ALL SELECT 2, doc_id, line_no, line FROM lines WHERE substr(md5('2-' || doc_id || '-' || line_no), 1, 8) < '80000000'
UNION ALL SELECT 3, doc_id, line_no, line FROM lines WHERE substr(md5('3-' || doc_id || '-' || line_no), 1, 8) < '40000000'""")
def sample_lines(spark, sf):
    return snippets.sample_epochs(d.documents(spark, sf), "doc_id", {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.25})


@query("SELECT doc_id, text FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 1")
def random_document(spark, sf):
    docs = d.table(spark, sf, "documents")
    return snippets.random_document(docs.select("doc_id", "text"), "doc_id", 42)


@query(r"""SELECT doc_id, CASE WHEN p <> '' THEN p END AS passage FROM (
  SELECT doc_id, regexp_extract(substr(text, 11), '#[^\n]*?(?:#[^\n]*?){3}#') AS p FROM documents)""")
def sample_passage(spark, sf):
    return d.documents(spark, sf).select("doc_id", tx.sample_passage(F.col("text"), 10).alias("passage"))


_LINKS = _rows(f"regexp_extract_all(html, {d.q(fixed.LINK_PATTERN)}, 1)", "link", "pages", "page_id")


@query(_LINKS)
def extract_links(spark, sf):
    return pg.extract_links(d.table(spark, sf, "pages"))


@query(f"""WITH links AS ({_LINKS}) SELECT DISTINCT link AS url FROM links
WHERE link NOT IN (SELECT link FROM links WHERE pos = 0)""")
def new_urls(spark, sf):
    links = pg.extract_links(d.table(spark, sf, "pages")).withColumnRenamed("link", "url")
    return pg.new_urls(links, links.filter(F.col("pos") == 0))


def _wh_sql(x: str) -> str:
    flags = ", ".join(f"CASE WHEN regexp_matches({x}, {d.q(p)}) THEN '{n}' END" for n, p in fixed.WH_FORMS)
    return f"array_to_string(list_filter([{flags}], lambda t: t IS NOT NULL), ',')"


@query(f"WITH {d.SQL_QA} SELECT id, {_wh_sql('question')} AS types FROM qa_questions")
def annotate_wh(spark, sf):
    found = pg.annotate_wh(d.qa_questions(spark, sf))
    return found.select("id", F.array_join("types", ",").alias("types"))


@query("""SELECT conv_id, turn, CASE WHEN right(text, 1) IN ('.', '?', '!') THEN text ELSE text || '?' END AS question
FROM conversations""")
def terminate_question(spark, sf):
    turns = d.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", tx.terminate_question(F.col("text")).alias("question"))


def _clean_sql(x: str) -> str:
    out = x
    for pattern, replacement in fixed.WIKI_STEPS:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        out = f"regexp_replace({out}, {d.q(pattern.replace('(?i)', ''))}, {d.q(replacement.replace('$1', chr(92) + '1'))}, '{flags}')"
    out = f"translate(' ' || {out} || ' ', '{fixed.UPPER}', '{fixed.LOWER}')"
    for letter, spelled in fixed.SPELLED:
        out = f"replace({out}, '{letter}', '{spelled}')"
    return f"regexp_replace({out}, '[^a-z]+', ' ', 'g')"


@query(f"""SELECT page_id, {_clean_sql('html')} AS text FROM pages
WHERE html <> '' AND NOT regexp_matches(html, '(?i)#redirect')""")
def clean_wiki_markup(spark, sf):
    return wiki.clean_wiki_markup(_articles(spark, sf))


def _articles(spark, sf):
    wrapped = F.concat(F.lit('<page><text xml:space="preserve">'), F.col("html"), F.lit("</text></page>"))
    return d.table(spark, sf, "pages").select("page_id", wrapped.alias("markup"))


@query(f"""WITH cleaned AS (SELECT page_id, {_clean_sql('html')} AS text FROM pages
  WHERE html <> '' AND NOT regexp_matches(html, '(?i)#redirect'))
SELECT page_id, array_to_string({d.sql_tokens('text')}, ' ') AS line FROM cleaned""")
def articles_to_lines(spark, sf):
    return wiki.articles_to_lines(wiki.clean_wiki_markup(_articles(spark, sf)), ["page_id"])


@query(f"""SELECT conv_id, (sum(len(t)) OVER (PARTITION BY conv_id ORDER BY turn) - len(t))::BIGINT AS start,
  array_to_string(t, ' ') AS tokens FROM (SELECT conv_id, turn, {d.sql_tokens('text')} AS t FROM conversations)""")
def group_concat_tokens(spark, sf):
    turns = d.table(spark, sf, "conversations")
    out = wiki.group_concat_tokens(turns, "conv_id", ["turn"])
    return out.withColumn("tokens", F.array_join("tokens", " "))
