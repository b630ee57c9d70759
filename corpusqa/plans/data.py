"""Operator inputs derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.operators.entities import capital_counts
from corpusqa.operators.joins import number_rows
from corpusqa.operators.profile import word_count
from corpusqa.operators.snippets import split_snippets
from corpusqa.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it lies, or dealt to as many partitions as the session's ``corpusqa.spread``
    says (for measurements on one machine, whose tables may be one file with one row group)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("corpusqa.spread", None)
    return df.repartition(int(spread)) if spread else df


def stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files. As a pattern, because a plain path of a
    stream must be a folder."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: id, corpus, department, module, title, type, text."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, "base").otherwise("aiv").alias("corpus"),
        F.col("source").alias("department"),
        F.col("lang").alias("module"),
        F.lit("").alias("title"),
        F.lit("lecture").alias("type"),
        "text",
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_snippets(transcripts(spark, sf_dir))


WH = ("Why", "How", "Who", "Where", "What", "When", "Which", "Can")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions (qid, question)."""
    wh = F.array(*[F.lit(w) for w in WH])
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.concat_ws(" ", F.get(wh, (F.col("item_id") % 8).cast("int")), "text").alias("question"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def ranked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, rank): words of the documents by falling count."""
    counts = word_count(documents(spark, sf_dir))
    order = [F.col("count").desc(), F.col("token")]
    return number_rows(counts, order, name="rank").select(F.col("token").alias("word"), "rank")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, vec, rank, label): the r-th word has embedding r - 1. Stored, as it is used often."""
    vecs = embeddings(spark, sf_dir).withColumn("rank", F.col("vec_id") + 1)
    return settle(ranked_words(spark, sf_dir).join(vecs, "rank").select("word", "vec", "rank", "label"))


LABELS = ("LOC", "MISC", "PER", "ORG", "DATE", "LANG")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words and pairs of them, supported by how often they occur. Stored."""
    counts = capital_counts(documents(spark, sf_dir)).select("surface", F.col("n").cast("int").alias("support"))
    n = F.length("surface")
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), n % 6)
    return settle(
        counts.select(
            "surface",
            F.concat(F.lit("http://kb.example/"), F.replace("surface", F.lit(" "), F.lit("_"))).alias("uri"),
            label.alias("label"),
            F.array(label).alias("types"),
            "support",
            F.when(n % 5 == 0, 0.3).otherwise(0.8).alias("score"),
        )
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as report messages."""
    return as_reports(table(spark, sf_dir, "events"))


def as_reports(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    finish = kind.isin("purchase", "error")
    create, node, step = kind == "signup", kind == "view", kind == "click"
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(create, "create").when(node, "node").when(step, "step").otherwise("finish").alias("kind"),
        F.col("user_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.when(create, F.concat(F.lit("question "), k)).alias("question"),
        F.when(create, F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("sender"),
        F.when(node, F.concat(F.lit("node "), k)).alias("node"),
        F.when(step, F.concat(F.lit("step"), (k.cast("int") % 5).cast("string"))).alias("step"),
        F.when(
            create, F.concat(F.lit('{"corpus": "c'), k, F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}"))
        ).when(step, F.col("props")).alias("json"),
        F.when(finish, kind == "purchase").alias("success"),
        F.when(finish, F.concat(F.lit("answer "), k)).alias("answer"),
        F.when(finish, F.col("value")).alias("ranking"),
        F.when(
            finish,
            F.array(
                F.struct(F.concat(F.lit("answer "), k).alias("answer"), F.col("value").alias("ranking")),
                F.struct(F.lit("other").alias("answer"), (F.col("value") / 2).alias("ranking")),
            ),
        ).alias("candidates"),
    )


def qa_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as question records; the category path is role and question length class."""
    turns = table(spark, sf_dir, "conversations")
    good = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("conv_id"))
    users = turns.filter(F.col("role") == "user").join(
        good.distinct().withColumn("taken", F.lit(True)), "conv_id", "left"
    )
    wh = F.array(*[F.lit(w) for w in WH])
    start = F.get(wh, ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    return users.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(start, F.lit(" "), F.col("text"), F.lit("?")).alias("question"),
        F.array(
            F.lit("All"),
            F.when(F.col("conv_id") % 2 == 0, "Science").otherwise("Arts"),
            F.concat(F.lit("turn "), F.col("turn").cast("string")),
        ).alias("category"),
        F.col("taken"),
        F.array().cast("array<string>").alias("types"),
    )


# ---- the same inputs as SQL ----


def q(text: str) -> str:
    """A text as SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


TOKEN = q(fixed.TOKEN_PATTERN)
SENTENCE = q(fixed.SENTENCE_PATTERN)
STOP = ", ".join(q(w) for w in fixed.STOPWORDS)


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {TOKEN})"


def sql_sentences(x: str) -> str:
    return f"regexp_extract_all({x}, {SENTENCE})"


def sql_words(x: str) -> str:
    return f"flatten(list_transform({sql_sentences(x)}, lambda s: {sql_tokens('s')}))"


def sql_terms(x: str) -> str:
    return rf"list_filter({sql_tokens(f'lower({x})')}, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))"


def sql_without_punctuation(x: str) -> str:
    return f"list_filter({x}, lambda t: NOT regexp_full_match(t, '[#?.,&!*]+'))"


def sql_tag(t: str) -> str:
    wp = ", ".join(q(w) for w in fixed.WP_WORDS)
    wrb = ", ".join(q(w) for w in fixed.WRB_WORDS)
    return (
        f"CASE WHEN lower({t}) IN ({wp}) THEN 'WP' WHEN lower({t}) IN ({wrb}) THEN 'WRB' "
        f"WHEN lower({t}) IN ({STOP}) THEN 'SW' "
        rf"WHEN NOT regexp_matches({t}, '[\p{{L}}\p{{N}}]') THEN 'PUNCT' ELSE 'NP' END"
    )


SQL_TRANSCRIPTS = """transcripts AS (
  SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'aiv' END AS corpus,
         source AS department, lang AS module, '' AS title, 'lecture' AS type, text
  FROM documents)"""

SQL_SNIPPETS = f"""{SQL_TRANSCRIPTS},
split_words AS (SELECT * EXCLUDE (text), string_split(text, ' ') AS w FROM transcripts),
window_count AS (
  SELECT *, greatest(ceil((len(w) - CASE WHEN length(w[-1]) <= 1 THEN 101 ELSE 100 END) / 75.0), 0)::BIGINT AS last
  FROM split_words),
windows AS (SELECT *, unnest(range(0, last + 1)) AS k FROM window_count),
snippets AS (
  SELECT id, corpus, department, module, title, type,
         CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(w[1:k * 75], ' ')) + 1 END AS "offset",
         CASE WHEN k < last THEN array_to_string(w[k * 75 + 1:k * 75 + 100], ' ') || ' '
              ELSE array_to_string(w[k * 75 + 1:], ' ') END AS text
  FROM windows)"""

SQL_QUESTIONS = f"""questions AS (
  SELECT item_id AS qid, [{', '.join(q(w) for w in WH)}][(item_id % 8 + 1)::INT] || ' ' || text AS question
  FROM benchmark)"""

SQL_WORDS = f"""word_rows AS (SELECT unnest({sql_words('text')}) AS token FROM documents),
word_counts AS (SELECT token, count(*) AS count FROM word_rows GROUP BY token)"""

SQL_VOCAB = f"""{SQL_WORDS},
ranked_words AS (SELECT token AS word, row_number() OVER (ORDER BY count DESC, token) AS rank FROM word_counts),
vocab AS (
  SELECT word, rank, label, embedding::DOUBLE[] AS vec
  FROM ranked_words JOIN embeddings ON vec_id = rank - 1)"""

SQL_GAZETTEER = rf"""gaz_tokens AS (SELECT {sql_tokens('text')} AS t FROM documents),
gaz_rows AS (
  SELECT unnest(t) AS surface FROM gaz_tokens
  UNION ALL
  SELECT unnest(list_transform(range(2, len(t) + 1), lambda i: t[i - 1] || ' ' || t[i])) FROM gaz_tokens),
gazetteer AS (
  SELECT surface, 'http://kb.example/' || replace(surface, ' ', '_') AS uri,
         ['LOC', 'MISC', 'PER', 'ORG', 'DATE', 'LANG'][length(surface) % 6 + 1] AS label,
         count(*) AS support, CASE WHEN length(surface) % 5 = 0 THEN 0.3 ELSE 0.8 END::DOUBLE AS score
  FROM gaz_rows WHERE regexp_matches(surface, '^\p{{Lu}}[^ ]*( \p{{Lu}}[^ ]*)?$')
  GROUP BY surface),
strong AS (SELECT * FROM gazetteer WHERE score >= 0.5 AND support >= 10)"""


def sql_links(name: str, source: str, key: str, text: str = "text") -> str:
    """CTEs ending in ``name``: links of the texts of ``source``; surfaces have tok_no most two tokens."""
    pieces = q(fixed.TOKEN_PATTERN + r"|\s+")
    return rf"""{name}_pieces AS (
  SELECT {key}, unnest(l) AS piece, unnest(range(len(l))) AS i
  FROM (SELECT {key}, regexp_extract_all({text}, {pieces}) AS l FROM {source})),
{name}_located AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY {key} ORDER BY i) - length(piece) AS start FROM {name}_pieces),
{name}_toks AS (
  SELECT {key}, piece, start, row_number() OVER (PARTITION BY {key} ORDER BY i) AS tok_no
  FROM {name}_located WHERE NOT regexp_matches(piece, '^\s')),
{name}_next AS (
  SELECT *, lead(piece) OVER w AS piece2, lead(start) OVER w AS start2
  FROM {name}_toks WINDOW w AS (PARTITION BY {key} ORDER BY tok_no)),
{name}_found AS (
  SELECT t.{key}, t.tok_no, t.start::BIGINT AS start,
         CASE WHEN g2.surface IS NOT NULL THEN 2 ELSE 1 END AS n,
         (CASE WHEN g2.surface IS NOT NULL THEN start2 + length(piece2) - start ELSE length(piece) END)::BIGINT AS length,
         coalesce(g2.surface, g1.surface) AS surface_form, coalesce(g2.uri, g1.uri) AS uri,
         coalesce(g2.label, g1.label) AS label, coalesce(g2.score, g1.score) AS probability
  FROM {name}_next t
  LEFT JOIN strong g1 ON g1.surface = t.piece
  LEFT JOIN strong g2 ON g2.surface = t.piece || ' ' || t.piece2
  WHERE g1.surface IS NOT NULL OR g2.surface IS NOT NULL),
{name}_chained AS (
  SELECT *, CASE WHEN lag(tok_no) OVER w = tok_no - 1 AND lag(n) OVER w = 2 THEN 0 ELSE 1 END AS fresh
  FROM {name}_found WINDOW w AS (PARTITION BY {key} ORDER BY tok_no)),
{name}_chains AS (
  SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY tok_no) AS chain FROM {name}_chained),
{name}_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {key}, chain ORDER BY tok_no) AS place FROM {name}_chains),
{name} AS (
  SELECT {key}, '<' || uri || '>' AS uri, label, probability, start, length, surface_form
  FROM {name}_numbered WHERE place % 2 = 1)"""


def sql_search(clauses: str, postings_source: str, keys: list[str], n: int, fields: dict[str, str] | None = None,
               scoring: str = "classic") -> str:
    """CTEs ending in ``hits`` (qid, keys, score, rank). ``clauses`` is a CTE (qid, field, term)."""
    fields = fields or {"text": sql_terms("text")}
    k = ", ".join(keys)
    rows = " UNION ALL ".join(
        f"SELECT {k}, '{f}' AS field, {expr} AS l FROM {postings_source}" for f, expr in fields.items()
    )
    if scoring == "classic":
        idf = "1 + ln((SELECT count(*) FROM {s}) / (coalesce(df, 0) + 1.0))"
        part = "m * sqrt(tf) * idf * idf / sqrt(length)"
        score = "total * matched / n_clauses / sqrt(squares)"
    else:
        idf = "ln(1 + ((SELECT count(*) FROM {s}) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))"
        part = "m * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))"
        score = "total"
    idf = idf.format(s=postings_source)
    return f"""field_terms AS ({rows}),
term_rows AS (SELECT {k}, field, len(l) AS length, unnest(l) AS term FROM field_terms),
postings AS (SELECT {k}, field, length, term, count(*) AS tf FROM term_rows GROUP BY ALL),
mean_lengths AS (SELECT field, avg(len(l)) AS mean_length FROM field_terms WHERE len(l) > 0 GROUP BY field),
freqs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
grouped AS (SELECT qid, field, term, count(*) AS m FROM {clauses} GROUP BY ALL),
weights AS (SELECT g.*, {idf} AS idf FROM grouped g LEFT JOIN freqs USING (field, term)),
norms AS (SELECT qid, sum(m) AS n_clauses, sum(m * idf * idf) AS squares FROM weights GROUP BY qid),
sums AS (
  SELECT w.qid, {', '.join('p.' + x for x in keys)}, sum({part}) AS total, sum(m) AS matched
  FROM postings p JOIN weights w USING (field, term) JOIN mean_lengths USING (field) GROUP BY ALL),
scores AS (SELECT s.*, {score} AS score FROM sums s JOIN norms USING (qid)),
hits AS (
  SELECT qid, {k}, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, {k}) AS rank
  FROM scores QUALIFY rank <= {n})"""


SQL_REPORTS = """reports AS (
  SELECT event_id AS seq, user_id AS id, epoch_us(ts) // 1000 AS time, json_extract_string(props, '$.k') AS k, value, props,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'node' WHEN 'click' THEN 'step' ELSE 'finish' END AS kind,
         event_type = 'purchase' AS success
  FROM events),
ordered AS (
  SELECT *, CASE kind WHEN 'create' THEN 0 WHEN 'node' THEN 1 WHEN 'step' THEN 2 ELSE 3 END AS kind_rank,
         'step' || (k::INT % 5) AS step FROM reports),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY time, kind_rank, seq) AS nth FROM ordered),
merged AS (
  SELECT id,
         max(CASE WHEN kind = 'create' AND nth = 1 THEN 'question ' || k END) AS question,
         max(CASE WHEN kind = 'create' AND nth = 1 THEN 'user ' || id END) AS sender,
         max(CASE WHEN kind = 'node' AND nth = 1 THEN 'node ' || k END) AS node,
         max(CASE WHEN kind = 'create' AND nth = 1 THEN 'c' || k END) AS details_corpus,
         max(CASE WHEN kind = 'create' AND nth = 1 THEN seq END) AS details_id,
         max(CASE WHEN kind = 'create' AND nth = 1 THEN 0 END)::BIGINT AS details_time,
         max(CASE WHEN kind = 'create' AND nth = 1 THEN '' END) AS details_text,
         max(CASE WHEN kind = 'finish' AND nth = 1 THEN 'answer ' || k END) AS answer,
         max(CASE WHEN kind = 'finish' AND nth = 1 THEN value END) AS ranking,
         bool_or(CASE WHEN kind = 'finish' AND nth = 1 THEN success END) AS finished,
         max(CASE WHEN kind = 'finish' AND nth = 1 THEN CASE WHEN value >= value / 2
               THEN 'answer ' || k || '|other' ELSE 'other|answer ' || k END END) AS candidates
  FROM firsts GROUP BY id),
time_entries AS (
  SELECT id, CASE WHEN kind = 'step' THEN step ELSE kind END AS key, max(time) AS time FROM ordered GROUP BY ALL),
times AS (SELECT id, string_agg(key || '=' || time, ',' ORDER BY key) AS times FROM time_entries GROUP BY id),
step_entries AS (
  SELECT id, step, props, row_number() OVER (PARTITION BY id, step ORDER BY length(props) DESC, time, kind_rank, seq) AS nth
  FROM ordered WHERE kind = 'step'),
steps AS (
  SELECT id, string_agg(step || '=' || props, ',' ORDER BY step) AS steps FROM step_entries WHERE nth = 1 GROUP BY id),
records AS (
  SELECT m.*, coalesce(times, '') AS times, coalesce(steps, '') AS steps
  FROM merged m LEFT JOIN times USING (id) LEFT JOIN steps USING (id))"""

SQL_QA = f"""qa_questions AS (
  SELECT conv_id || '-' || turn AS id,
         [{', '.join(q(w) for w in WH)}][((conv_id + turn) % 8 + 1)::INT] || ' ' || text || '?' AS question,
         CASE WHEN conv_id % 2 = 0 THEN 'Science' ELSE 'Arts' END AS area, 'turn ' || turn AS last,
         CASE WHEN conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN true END AS taken, conv_id, turn
  FROM conversations WHERE role = 'user')"""
