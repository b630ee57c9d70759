"""Vector, word vector and neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusqa.functions import text as tx
from corpusqa.functions import vectors as vx
from corpusqa.operators import embeddings as em
from corpusqa.operators import neighbors as nb
from corpusqa.operators import training as tn
from corpusqa.operators import snippets
from corpusqa.plans import data as d
from corpusqa.plans.registry import query
from corpusqa.sources import records
from corpusqa.session import new_folder


def elements(df, keys, vec="vec"):
    """One rounded element per row."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "value")).withColumn(
        "value", F.round("value", 4) + F.lit(0.0)
    )


def _scores(df):
    return df.withColumn("score", F.round("score", 4) + F.lit(0.0))


def _pairs(spark, sf):
    """Each embedding with the next one."""
    emb = d.embeddings(spark, sf)
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    return emb.join(nxt, "vec_id")


_PAIRS = """pairs AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@query(f"""WITH {_PAIRS}, cut AS (SELECT vec_id, unnest(a[1:40]) AS x, unnest(b[1:40]) AS y, unnest(range(40)) AS pos FROM pairs)
SELECT vec_id, pos, round(x + y, 4) + 0 AS value FROM cut""")
def vec_add(spark, sf):
    """The shorter vector decides the length."""
    cut = F.slice("other", 1, 40)
    return elements(_pairs(spark, sf).select("vec_id", vx.add(F.col("vec"), cut).alias("vec")), ["vec_id"])


@query("""SELECT vec_id, pos, round(CASE WHEN label > 0 THEN x / label ELSE x END, 4) + 0 AS value FROM (
  SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)""")
def vec_div(spark, sf):
    emb = d.embeddings(spark, sf)
    out = emb.select("vec_id", vx.scale_down(F.col("vec"), F.col("label").cast("double")).alias("vec"))
    return elements(out, ["vec_id"])


@query("""SELECT label, pos, round(sum(x) / any_value(n), 4) + 0 AS value FROM (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) GROUP BY ALL""")
def vec_avg(spark, sf):
    return elements(em.average(d.embeddings(spark, sf), "label", 64), ["label"])


@query(f"WITH {_PAIRS} SELECT vec_id, round(list_distance(a, b), 6) AS distance FROM pairs")
def euclidean(spark, sf):
    pairs = _pairs(spark, sf)
    return pairs.select("vec_id", F.round(vx.euclidean(F.col("vec"), F.col("other")), 6).alias("distance"))


@query(f"WITH {_PAIRS} SELECT vec_id, round(list_cosine_similarity(a, b), 6) + 0 AS cosine FROM pairs")
def cosine(spark, sf):
    pairs = _pairs(spark, sf)
    score = F.round(vx.cosine(F.col("vec"), F.col("other")), 6) + F.lit(0.0)
    return pairs.select("vec_id", score.alias("cosine"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS magnitude FROM embeddings""")
def magnitude(spark, sf):
    return d.embeddings(spark, sf).select("vec_id", F.round(vx.magnitude(F.col("vec")), 6).alias("magnitude"))


@query("""SELECT vec_id, pos, round(x / norm, 4) + 0 AS value FROM (
  SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos,
         sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)""")
def normalize(spark, sf):
    emb = d.embeddings(spark, sf)
    return elements(emb.select("vec_id", vx.normalize(F.col("vec")).alias("vec")), ["vec_id"])


_MEANS = """label_means AS (
  SELECT label AS qid, list(m ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
    GROUP BY ALL) GROUP BY label)"""


def sql_nearest(queries: str, items: str, n: int, extra: str = "true") -> str:
    """CTE ``nearest`` (qid, item, score, rank)."""
    return f"""nearest AS (
  SELECT q.qid, i.item, list_cosine_similarity(q.vec, i.vec) AS score,
         row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(q.vec, i.vec), 6) DESC, i.item) AS rank
  FROM {queries} q, {items} i WHERE {extra} QUALIFY rank <= {n})"""


_ITEMS = "items AS (SELECT vec_id AS item, embedding::DOUBLE[] AS vec FROM embeddings)"


@query(f"WITH {_MEANS}, {_ITEMS}, {sql_nearest('label_means', 'items', 40)} "
       "SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest")
def nearest_neighbors(spark, sf):
    """The mean vector of every label against all embeddings."""
    emb = d.embeddings(spark, sf)
    means = em.average(emb, "label", 64).select(F.col("label").alias("qid"), "vec")
    return _scores(nb.nearest_neighbors(means, emb.select(F.col("vec_id").alias("item"), "vec")))


@query(f"""WITH {_ITEMS}, every AS (SELECT item AS qid, vec FROM items), {sql_nearest('every', 'items', 10)}
SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest""")
def nearest_neighbors_all(spark, sf):
    """Every embedding against all."""
    emb = d.embeddings(spark, sf)
    queries = emb.select(F.col("vec_id").alias("qid"), "vec")
    return _scores(nb.nearest_neighbors(queries, emb.select(F.col("vec_id").alias("item"), "vec"), 10))


# ---- words ----

_QWORDS = f"""{d.SQL_QUESTIONS},
qwords AS (SELECT DISTINCT unnest({d.sql_tokens('question')}) AS word FROM questions)"""


def _qwords(spark, sf):
    return d.questions(spark, sf).select(F.explode(tx.tokens(F.col("question"))).alias("word")).distinct()


@query(f"WITH {d.SQL_VOCAB}, {_QWORDS} SELECT word FROM qwords WHERE word IN (SELECT word FROM vocab)")
def contains(spark, sf):
    return em.contains(_qwords(spark, sf), d.vocabulary(spark, sf))


@query(f"""WITH {d.SQL_VOCAB}, {_QWORDS} SELECT word, vec IS NOT NULL AS known, round(list_sum(vec), 4) + 0 AS total
FROM qwords LEFT JOIN vocab USING (word)""")
def vector(spark, sf):
    found = em.vector(_qwords(spark, sf), d.vocabulary(spark, sf))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return found.select("word", F.col("vec").isNotNull().alias("known"), (F.round(total, 4) + F.lit(0.0)).alias("total"))


def _groups(vocab):
    """Lists of five words of neighbouring rank; every fifth list has an unknown word as well."""
    lists = vocab.groupBy(F.floor((F.col("rank") - 1) / 5).alias("grp")).agg(
        F.array_sort(F.collect_list("word")).alias("words")
    )
    odd = F.concat("words", F.array(F.lit("no such word")))
    return lists.withColumn("words", F.when(F.col("grp") % 5 == 4, odd).otherwise(F.col("words")))


_GROUPS = """ranked AS (SELECT (rank - 1) // 5 AS grp, * FROM vocab),
group_words AS (
  SELECT grp, word, vec FROM ranked
  UNION ALL SELECT DISTINCT grp, 'no such word', NULL FROM ranked WHERE grp % 5 = 4)"""

_CENTROIDS = """elements AS (SELECT grp, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM group_words WHERE vec IS NOT NULL),
sizes AS (SELECT grp, count(*) AS n, count(vec) AS known FROM group_words GROUP BY grp),
centroids AS (SELECT grp, pos, sum(x) / any_value(n) AS x, any_value(n) = any_value(known) AS complete
  FROM elements JOIN sizes USING (grp) GROUP BY ALL)"""


@query(f"""WITH {d.SQL_VOCAB}, {_GROUPS}, {_CENTROIDS}
SELECT grp, pos, round(x, 4) + 0 AS value FROM centroids WHERE complete""")
def centroid(spark, sf):
    vocab = d.vocabulary(spark, sf)
    return elements(em.centroid(_groups(vocab), "grp", "words", vocab), ["grp"])


@query(f"WITH {d.SQL_VOCAB}, {_GROUPS}, {_CENTROIDS} SELECT grp, pos, round(x, 4) + 0 AS value FROM centroids")
def centroid_tolerant(spark, sf):
    vocab = d.vocabulary(spark, sf)
    return elements(em.centroid_tolerant(_groups(vocab), "grp", "words", vocab), ["grp"])


def _neighbour_words(vocab):
    a = vocab.select(F.col("word").alias("word1"), "rank")
    b = vocab.select(F.col("word").alias("word2"), (F.col("rank") - 1).alias("rank"))
    return a.join(b, "rank", "left").select("word1", F.coalesce("word2", F.lit("no such word")).alias("word2"))


_NEIGHBOUR_WORDS = """word_pairs AS (
  SELECT a.word AS word1, coalesce(b.word, 'no such word') AS word2, a.vec AS v1, b.vec AS v2
  FROM vocab a LEFT JOIN vocab b ON b.rank = a.rank + 1)"""


@query(f"""WITH {d.SQL_VOCAB}, {_NEIGHBOUR_WORDS}
SELECT word1, word2, round(list_cosine_similarity(v1, v2), 4) + 0 AS cosine FROM word_pairs""")
def word_cosine(spark, sf):
    vocab = d.vocabulary(spark, sf)
    out = em.word_cosine(_neighbour_words(vocab), vocab)
    return out.select("word1", "word2", (F.round("cosine", 4) + F.lit(0.0)).alias("cosine"))


@query(f"""WITH {d.SQL_VOCAB}, {_NEIGHBOUR_WORDS}
SELECT word1, word2, round(list_distance(v1, v2), 4) AS distance FROM word_pairs""")
def word_euclidean(spark, sf):
    vocab = d.vocabulary(spark, sf)
    return em.word_euclidean(_neighbour_words(vocab), vocab).withColumn("distance", F.round("distance", 4))


_WORD_ITEMS = "items AS (SELECT word AS item, vec, label, (rank - 1) // 5 AS grp FROM vocab)"


@query(f"""WITH {d.SQL_VOCAB}, {_MEANS}, {_WORD_ITEMS},
{sql_nearest('label_means', 'items', 20, "i.item IN (SELECT unnest(" + d.sql_words('lower(text)') + ") FROM documents) AND (q.qid, i.item) NOT IN (SELECT (label, arg_min(word, rank)) FROM vocab GROUP BY label)")}
SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest""")
def nearest_words(spark, sf):
    """Words that occur in lower-cased texts nearest to the mean vector of a label, but for its most frequent one."""
    vocab = d.vocabulary(spark, sf)
    means = em.average(d.embeddings(spark, sf), "label", 64).select(F.col("label").alias("qid"), "vec")
    low = d.documents(spark, sf).select(F.explode(tx.bag_of_words(F.lower("text"))).alias("word"))
    own = vocab.groupBy(F.col("label").alias("qid")).agg(F.min_by("word", "rank").alias("item"))
    return _scores(em.nearest_words(means, vocab, 20, include=low, exclude=own))


@query(f"""WITH {d.SQL_VOCAB}, {_GROUPS}, {_CENTROIDS}, {_WORD_ITEMS},
targets AS (SELECT grp AS qid, list(x ORDER BY pos) AS vec FROM centroids WHERE complete GROUP BY grp),
{sql_nearest('targets', 'items', 40, 'i.grp <> q.qid')}
SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest""")
def distance(spark, sf):
    vocab = d.vocabulary(spark, sf)
    return _scores(em.distance(_groups(vocab), "grp", "words", vocab))


@query(f"""WITH {d.SQL_VOCAB}, {_WORD_ITEMS},
triples AS (SELECT a.rank AS qid, a.word AS w1, b.word AS w2, c.word AS w3,
    list_transform(list_zip(a.vec, b.vec, c.vec), lambda z: z[1] - z[2] + z[3]) AS vec
  FROM vocab a JOIN vocab b ON b.rank = a.rank + 1 JOIN vocab c ON c.rank = a.rank + 2),
{sql_nearest('triples', 'items', 10, 'i.item NOT IN (q.w1, q.w2, q.w3)')}
SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest""")
def analogy(spark, sf):
    vocab = d.vocabulary(spark, sf)
    triples = vocab.select(F.col("rank").alias("qid"), F.col("word").alias("word1"))
    for i in (2, 3):
        nxt = vocab.select((F.col("rank") - (i - 1)).alias("qid"), F.col("word").alias(f"word{i}"))
        triples = triples.join(nxt, "qid")
    return _scores(em.analogy(triples, "qid", vocab, 10))


@query(f"""WITH {d.SQL_VOCAB}, {_GROUPS},
heads AS (SELECT grp, arg_min(word, rank) AS word, arg_min(vec, rank) AS head FROM ranked GROUP BY grp)
SELECT grp, h.word, v.word AS member, round(list_cosine_similarity(head, vec), 4) + 0 AS cosine
FROM heads h JOIN ranked v USING (grp) WHERE grp % 5 <> 4""")
def rank_words(spark, sf):
    """The most frequent word of a list against all its words; a list with an unknown word gives none."""
    vocab = d.vocabulary(spark, sf)
    grp = F.floor((F.col("rank") - 1) / 5).alias("grp")
    heads = vocab.groupBy(grp).agg(F.min_by("word", "rank").alias("word"))
    sets = heads.join(_groups(vocab), "grp").select("grp", "word", F.explode("words").alias("member"))
    return em.rank_words(sets, "grp", vocab).withColumn("cosine", F.round("cosine", 4) + F.lit(0.0))


_UNITS = """units AS (
  SELECT word, rank, (rank - 1) // 5 AS grp, pos, x / sqrt(sum(x * x) OVER (PARTITION BY word)) AS x FROM (
    SELECT word, rank, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM vocab))"""


@query(f"""WITH {d.SQL_VOCAB}, {_GROUPS}, {_UNITS}, {_WORD_ITEMS},
targets AS (SELECT qid, list(x ORDER BY pos) AS vec FROM (
  SELECT qid, pos, sum(x * sign) AS x FROM (
    SELECT grp AS qid, pos, x, 1 AS sign FROM units
    UNION ALL SELECT grp - 1, pos, x, -1 FROM units) GROUP BY ALL) GROUP BY qid),
{sql_nearest('targets', 'items', 40, 'i.grp <> q.qid AND i.grp <> q.qid + 1')}
SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest
WHERE qid >= 0 AND qid % 5 <> 4 AND (qid + 1) % 5 <> 4 AND qid < (SELECT max(grp) FROM ranked)""")
def near_words(spark, sf):
    """Words of a list as positive, of the next list as negative words; not those with an unknown word."""
    vocab = d.vocabulary(spark, sf)
    groups = _groups(vocab)
    negative = groups.select((F.col("grp") - 1).alias("grp"), F.col("words").alias("negative"))
    both = groups.withColumnRenamed("words", "positive").join(negative, "grp")
    return _scores(em.near_words(both, "grp", vocab))


@query(f"""WITH {d.SQL_VOCAB}, {_UNITS}, {_WORD_ITEMS},
texts AS (SELECT item_id AS qid, unnest({d.sql_words('text')}) AS word FROM benchmark),
targets AS (SELECT qid, list(x ORDER BY pos) AS vec FROM (
  SELECT qid, pos, sum(x) AS x FROM texts JOIN units USING (word) GROUP BY ALL) GROUP BY qid),
{sql_nearest('targets', 'items', 40, '(q.qid, i.item) NOT IN (SELECT (qid, word) FROM texts)')}
SELECT qid, item, round(score, 4) + 0 AS score, rank FROM nearest""")
def near_words_text(spark, sf):
    texts = d.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return _scores(em.near_words_text(texts, "qid", d.vocabulary(spark, sf)))


def _paragraphs(source: str, key: str) -> str:
    return f"""para_words AS (SELECT {key}, unnest({d.sql_words('text')}) AS word FROM {source}),
para_sizes AS (SELECT {key}, count(*) AS n FROM para_words GROUP BY ALL),
para_elements AS (SELECT {key}, pos, sum(x) AS x FROM (
  SELECT {key}, unnest(vec) AS x, unnest(range(64)) AS pos FROM para_words JOIN vocab USING (word)) GROUP BY ALL),
paras AS (SELECT {key}, pos, coalesce(x, 0) / n AS x
  FROM (SELECT {key}, n, unnest(range(64)) AS pos FROM para_sizes) LEFT JOIN para_elements USING ({key}, pos))"""


@query(f"""WITH {d.SQL_VOCAB}, {_paragraphs('documents', 'doc_id')}
SELECT doc_id, pos, round(x, 4) + 0 AS value FROM paras""")
def paragraph_vector(spark, sf):
    vecs = em.paragraph_vector(d.documents(spark, sf), "doc_id", d.vocabulary(spark, sf))
    return elements(vecs, ["doc_id"])


@query(f"""WITH {d.SQL_VOCAB}, {_paragraphs('documents', 'doc_id')}
SELECT doc_id, 'full' AS model, pos, round(x, 4) + 0 AS value FROM paras
UNION ALL SELECT doc_id, 'half', pos, round(x / 2, 4) + 0 FROM paras""")
def vectorize(spark, sf):
    """Two models per document, the second with halved vectors."""
    vocab = d.vocabulary(spark, sf)
    half = vocab.withColumn("vec", F.transform("vec", lambda x: x / 2))
    out = em.vectorize(d.documents(spark, sf), "doc_id", {"full": vocab, "half": half})
    return elements(out.select("doc_id", F.explode("vectors").alias("model", "vec")), ["doc_id", "model"])


@query("SELECT vec_id, label, len(embedding) AS dimension, 0 AS models FROM embeddings")
def unvectorize(spark, sf):
    stored = d.embeddings(spark, sf).withColumn("vectors", F.create_map(F.lit("main"), F.col("vec")))
    return em.unvectorize(stored).select("vec_id", "label", F.size("vec").alias("dimension"), F.size("vectors").alias("models"))


@query(f"""WITH {d.SQL_WORDS}, known AS (SELECT token FROM word_counts WHERE count >= 5),
lists AS (SELECT {d.sql_words('text')} AS l FROM documents),
places AS (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM lists),
pairs AS (SELECT l[i] AS x, unnest(l[i + 1:i + 5]) AS y FROM places)
SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS count FROM pairs
WHERE x IN (SELECT token FROM known) AND y IN (SELECT token FROM known) GROUP BY ALL""")
def context_counts(spark, sf):
    """What word vectors are trained on."""
    return tn.context_counts(d.documents(spark, sf))


@query(f"WITH {d.SQL_WORDS} SELECT token AS word, 16 AS dimension, true AS trained FROM word_counts WHERE count >= 5")
def train_embeddings(spark, sf):
    """Word vectors trained on the documents: the words they are for, their length, and that none is zero."""
    trained = em.train_embeddings(d.documents(spark, sf), size=16, min_count=5)
    return trained.select("word", F.size("vec").alias("dimension"), F.exists("vec", lambda x: x != 0).alias("trained"))


@query(f"""WITH {d.SQL_WORDS}, lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
half_words AS (SELECT unnest({d.sql_words('line')}) AS token FROM lines WHERE line_no * 2 < n),
half AS (SELECT token, count(*) AS count FROM half_words GROUP BY token)
SELECT 'min_count_20-size_8' AS model, token AS word, 8 AS dimension FROM half WHERE count >= 20
UNION ALL SELECT 'min_count_60-size_4', token, 4 FROM half WHERE count >= 60""")
def train_grid(spark, sf):
    """The first epoch's lines trained with two sets of parameters."""
    lines = snippets.sample_lines(d.documents(spark, sf), "doc_id", 0).select(F.col("line").alias("text"))
    grid = [{"size": 8, "min_count": 20}, {"size": 4, "min_count": 60}]
    out = None
    for label, vocab in em.train_grid(lines, new_folder(spark, "models"), grid).items():
        part = vocab.select(F.lit(label).alias("model"), "word", F.size("vec").alias("dimension"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT 'w' || vec_id AS word, pos, round(x / norm, 4) + 0 AS value FROM (
  SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos,
         sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)""")
def read_word_vectors(spark, sf):
    """Embeddings written as a word vector text file and read back."""
    path = new_folder(spark, "vectors")
    emb = d.embeddings(spark, sf)
    row = F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.col("vec").cast("array<string>"), " "))
    emb.select(row.alias("value")).write.text(path)
    return elements(records.read_word_vectors(spark, path), ["word"])
