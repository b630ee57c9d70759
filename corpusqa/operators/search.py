"""Full-text search by joins: postings, term weights, scores, top hits per query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.functions import fixed
from corpusqa.functions import text as tx
from corpusqa.operators import scoring as sc
from corpusqa.operators.joins import fits_broadcast, lookup_join, top_per_key
from corpusqa.session import settle


@dataclass(frozen=True)
class Index:
    """Postings (field, term, keys, tf, length), one row per field, term and document.

    ``total`` is one row, the number of documents; ``lengths`` has the mean length of each field;
    ``documents`` (keys, field, length, terms) has the postings still in the rows of their documents;
    ``rows`` (keys, fields) has one row for each document, with all terms of its fields as they stand.
    """

    postings: DataFrame
    total: DataFrame
    keys: tuple[str, ...]
    lengths: DataFrame
    documents: DataFrame
    rows: DataFrame


def _field_terms(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(F.coalesce(value, F.array().cast("array<string>")), tx.terms))
    return tx.terms(F.coalesce(value, F.lit("")))


def _field_entry(name: str, terms: Column) -> Column:
    return tx.let(
        terms,
        lambda t: F.struct(
            F.lit(name).alias("field"),
            F.size(t).alias("length"),
            tx.term_frequencies(t).alias("terms"),
        ),
    )


def _field_words(name: str, terms: Column) -> Column:
    none = F.lit(None).cast("array<bigint>").alias("tf")
    return tx.let(terms, lambda t: F.struct(F.lit(name).alias("field"), F.size(t).alias("length"), t.alias("terms"), none))


def documents_by_row(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fields) of ``Index.documents``: a row for each field."""
    terms = F.coalesce("terms", F.array().cast("array<struct<term:string,tf:bigint>>"))
    one = F.struct("field", "length", F.transform(terms, lambda t: t["term"]).alias("terms"), F.transform(terms, lambda t: t["tf"]).alias("tf"))
    return documents.select(*keys, F.array(one).alias("fields"))


def build_index(
    docs: DataFrame, keys: Sequence[str], fields: Mapping[str, str] | None = None
) -> Index:
    """Index ``fields`` (name -> string or string array column) of ``docs``, one row per document.

    Terms are counted inside the row of their document, so building postings moves no data.
    """
    fields = dict(fields or {"text": "text"})
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    per_field = [_field_entry(name, _field_terms(F.col(c), kinds[c])) for name, c in fields.items()]
    by_field = docs.select(*keys, F.inline(F.array(*per_field)))
    postings = by_field.select(*keys, "field", "length", F.inline("terms"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    lengths = by_field.filter("length > 0").groupBy("field").agg(F.avg("length").alias("_mean"))
    rows = docs.select(*keys, F.array(*[_field_words(name, _field_terms(F.col(c), kinds[c])) for name, c in fields.items()]).alias("fields"))
    return Index(postings, total, tuple(keys), lengths, by_field, rows)


def document_frequency(index: Index) -> DataFrame:
    return index.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def clauses(queries: DataFrame, qid: str, words: str, field: str = "text") -> DataFrame:
    """One row per query word and field; a repeated word is a clause of its own.

    A word of several terms, or of none, counts as its terms.
    """
    every = F.flatten(F.transform(F.col(words), tx.terms))
    return queries.select(qid, F.lit(field).alias("field"), F.explode(every).alias("term"))


def term_weights(grouped: DataFrame, freq: DataFrame, total: Column, qid: str, scoring: str) -> DataFrame:
    """(qid, field, term, _m, _w) of the clauses ``grouped`` (qid, field, term, _m): what a query's
    documents share goes into the weight of a term."""
    if scoring not in ("classic", "bm25"):
        raise ValueError("scoring is 'classic' or 'bm25'")
    df = F.coalesce(F.col("df"), F.lit(0))
    idf = (
        F.lit(1.0) + F.ln(F.col("_N") / (df + F.lit(1.0)))
        if scoring == "classic"
        else F.ln(F.lit(1.0) + (F.col("_N") - df + F.lit(0.5)) / (df + F.lit(0.5)))
    )
    per_query = Window.partitionBy(qid)
    weights = (
        grouped.join(freq, ["field", "term"], "left")
        .withColumn("_N", total.cast("double"))
        .withColumn("_idf", idf)
        .withColumn("_clauses", F.sum("_m").over(per_query))
        .withColumn("_squares", F.sum(F.col("_m") * F.col("_idf") * F.col("_idf")).over(per_query))
    )
    if scoring == "classic":
        weight = F.col("_m") * F.col("_idf") * F.col("_idf") / F.sqrt("_squares") / F.col("_clauses")
    else:
        weight = F.col("_m") * F.col("_idf")
    return weights.select(qid, "field", "term", "_m", weight.alias("_w"))


def impact(scoring: str, tf: Column, length: Column, mean: Column) -> Column:
    """What a posting is worth: its part of a score, without the weight of the term. Grows with ``tf``
    and falls with ``length``. ``mean`` is the field's mean length, for bm25."""
    if scoring == "classic":
        return F.sqrt(tf / length)
    k1, b = 1.2, 0.75
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))


def total_score(scoring: str, parts: Column, matched: Column) -> Column:
    """The score of a document from the sum of its parts and the number of clauses it has."""
    return parts * matched if scoring == "classic" else parts


def search(
    index: Index,
    wanted: DataFrame,
    qid: str,
    n: int = fixed.TERM_HITS,
    scoring: str = "classic",
) -> DataFrame:
    """Top ``n`` documents per query: (qid, keys, score, rank).

    A stored index (``stored_index``) looks only at the postings that can matter. For another the
    clause side is measured: while its weights fit a task, documents are scored where they are read, for all
    queries at once, and only what can be among the best of a task goes on. Beyond that postings are
    joined with the clauses, frequent terms salted. What is left after postings without a wanted
    term are dropped is written out, as it serves both the term frequencies and the scores.
    """
    if not isinstance(index, Index):
        return index.search(wanted, qid, n, scoring)
    grouped = settle(wanted.groupBy(qid, "field", "term").agg(F.count(F.lit(1)).alias("_m")))
    if fits_broadcast(grouped) and sc.fits(grouped, qid, n):
        return best_hits(_score_rows(index, grouped, qid, n, scoring), qid, index.keys, n)
    terms = grouped.select("field", "term").distinct()
    bound = None if fits_broadcast(grouped) else 0
    needed = settle(_join(index.postings, terms, ["field", "term"], "left_semi", bound))
    freq = needed.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = term_weights(grouped, freq, index.total.scalar(), qid, scoring)
    matches = _join(needed, weights, ["field", "term"], "inner", bound)
    if scoring == "bm25":
        matches = matches.join(F.broadcast(index.lengths), "field")  # a row for each field
    part = F.col("_w") * impact(scoring, F.col("tf"), F.col("length"), F.col("_mean") if scoring == "bm25" else F.lit(None))
    hits = matches.groupBy(qid, *index.keys).agg(total_score(scoring, F.sum(part), F.sum("_m")).alias("score"))
    return best_hits(hits, qid, index.keys, n)


def wanted_terms(grouped: DataFrame) -> list[tuple[str, str]]:
    """The terms of clauses that have been measured, in order."""
    return sorted((r["field"], r["term"]) for r in grouped.select("field", "term").distinct().collect())


def _score_rows(index: Index, grouped: DataFrame, qid: str, n: int, scoring: str) -> DataFrame:
    wanted = wanted_terms(grouped)
    rows = sc.coded(index.rows, index.keys, wanted)
    total = rows.count()
    rows = sc.spread(rows, total)
    spark = grouped.sparkSession
    names = spark.createDataFrame([(k, *w) for k, w in enumerate(wanted)], "id int, field string, term string")
    found = rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
    freq = found.join(F.broadcast(names), "id").select("field", "term", "df")
    weights = term_weights(grouped, freq, F.lit(total), qid, scoring)
    return sc.best_scores(sc.merged(rows, index.keys), index.keys, weights, wanted, qid, n, scoring, index.lengths if scoring == "bm25" else None)


def best_hits(hits: DataFrame, qid: str, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best of (qid, keys, score), ties by key: with their rank."""
    order = [F.round("score", 6).desc(), *[F.col(k) for k in keys]]
    return top_per_key(hits, [qid], order, n)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, bound: int | None) -> DataFrame:
    # the caller has measured a frame at least as large as ``right``
    if bound is None:
        return left.join(F.broadcast(right), on, how)
    return lookup_join(left, right, on, how, max_bytes=bound)


def find_terms(index: Index, queries: DataFrame, qid: str, words: str, n: int = fixed.TERM_HITS,
               scoring: str = "classic") -> DataFrame:
    """OR search of the words in the text field."""
    return search(index, clauses(queries, qid, words), qid, n, scoring)


def find_entities(index: Index, queries: DataFrame, qid: str, entities: str, n: int = fixed.FIELD_HITS) -> DataFrame:
    """OR search of entities in the linked entities of a document (field ``entity``)."""
    return search(index, clauses(queries, qid, entities, "entity"), qid, n)


def find_topics(index: Index, queries: DataFrame, qid: str, topics: str, n: int = fixed.FIELD_HITS) -> DataFrame:
    """OR search of topics in field ``topic``."""
    return search(index, clauses(queries, qid, topics, "topic"), qid, n)


def find(
    index: Index,
    queries: DataFrame,
    qid: str,
    words: str,
    entities: str | None = None,
    topics: str | None = None,
    n: int = fixed.FIELD_HITS,
) -> DataFrame:
    """One OR search over words, entities and topics together."""
    wanted = clauses(queries, qid, words)
    if entities:
        wanted = wanted.unionByName(clauses(queries, qid, entities, "entity"))
    if topics:
        wanted = wanted.unionByName(clauses(queries, qid, topics, "topic"))
    return search(index, wanted, qid, n)


def find_id(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """All rows of the wanted ids: every snippet of a document."""
    return lookup_join(docs, ids.select(key).distinct(), key, "left_semi")


def get_id(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row per wanted key, with nulls where there is no such document."""
    return ids.select(key).distinct().join(docs, key, "left")


def vectors(
    docs: DataFrame, model: str, key: str, id_col: str = "id", column: str = "vectors"
) -> DataFrame:
    """(key, id, vector) of a model; an element that is no number is 0; documents without it drop."""
    vec = F.col(column)[model]
    as_number = F.transform(vec, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return docs.filter(vec.isNotNull()).select(key, id_col, as_number.alias("vector"))


def vector_doc(docs: DataFrame, ids: DataFrame, model: str, key: str, id_col: str = "id") -> DataFrame:
    """Vectors of the wanted documents."""
    return vectors(find_id(docs, ids, id_col), model, key, id_col)


def search_entity(entities: DataFrame, queries: DataFrame, qid: str, text: str, n: int = fixed.FIELD_HITS) -> DataFrame:
    """Entities whose key matches a free text: (qid, entity, key, score, rank)."""
    index = build_index(entities, ["entity", "key"], {"text": "key"})
    asked = queries.select(qid, F.array(F.col(text)).alias("_words"))
    return find_terms(index, asked, qid, "_words", n)


CLUE_TYPE = (
    "struct<id:string,type:string,probability:double,start:bigint,length:bigint,"
    "surface_form:string,types:array<string>>"
)


def parse_clues(docs: DataFrame, raw: str = "clues", key: str = "id") -> DataFrame:
    """Typed entity references out of loosely typed clue maps; only type ``entity`` is known.

    A document with a clue that does not decode loses all of its clues.
    """
    decoded = F.transform(
        F.coalesce(F.col(raw), F.array().cast("array<map<string,string>>")),
        lambda c: F.struct(
            c["id"].alias("id"),
            c["type"].alias("type"),
            c["probability"].try_cast("double").alias("probability"),
            c["start"].try_cast("bigint").alias("start"),
            c["length"].try_cast("bigint").alias("length"),
            c["surfaceForm"].alias("surface_form"),
            F.array().cast("array<string>").alias("types"),
        ),
    )
    whole = F.forall(
        decoded,
        lambda c: (c["type"] == "entity")
        & c["id"].isNotNull()
        & c["probability"].isNotNull()
        & c["start"].isNotNull()
        & c["length"].isNotNull()
        & c["surface_form"].isNotNull(),
    )
    empty = F.array().cast(f"array<{CLUE_TYPE}>")
    return docs.select(key, F.when(whole, decoded).otherwise(empty).alias("clues"))
