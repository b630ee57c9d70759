"""From analysed questions to answers: retrieve, build candidates, rank, decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.functions import text as tx
from corpusqa.functions.vectors import from_best
from corpusqa.operators import embeddings as em
from corpusqa.operators.joins import first_per_key, holds_map, lookup_join, number_rows
from corpusqa.operators.neighbors import nearest_neighbors
from corpusqa.operators.questions import analyze_questions
from corpusqa.operators.search import Index, build_index, find, find_terms
from corpusqa.session import settle

SNIPPET_KEYS = ("id", "offset")
# Folders of stored snippets.
SNIPPET_PARTS = 64


def extract(
    analysed: DataFrame, index: Index | None, mode: str = "passing", qid: str = "qid"
) -> DataFrame:
    """Documents per question: (qid, index keys, score, rank).

    ``fulltext`` searches all words of the question, ``vector-doc`` its focus, entity labels
    and topics over the fields of the index, ``passing`` finds nothing.
    """
    if mode == "fulltext":
        return find_terms(index, analysed, qid, "bow")
    if mode == "vector-doc":
        asked = analysed.withColumn("_labels", F.map_values("entities"))
        return find(index, asked, qid, "focus", "_labels", "topics")
    if mode == "passing":
        none = analysed.limit(0).select(qid, F.lit("").alias("id"))
        return none.select(qid, "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    raise ValueError(f"unknown extraction mode {mode!r}")


def nearest_docs(queries: DataFrame, stored: DataFrame, key: str, n: int = fixed.NEIGHBORS) -> DataFrame:
    """Stored vectors nearest to each (qid, vec), by snippet id or document id in ``key``."""
    return nearest_neighbors(queries, stored.select(F.col(key).alias("item"), F.col("vector").alias("vec")), n)


def question_words(analysed: DataFrame, use_focus: bool = False, stopwords: Sequence[str] = fixed.STOPWORDS) -> DataFrame:
    """Adds ``words``: the bag of words without stopwords, or the focus."""
    words = F.col("focus") if use_focus else tx.without_stopwords(F.col("bow"), stopwords)
    return analysed.withColumn("words", words)


def _candidate_text(topics: bool = False) -> Column:
    extra = ", topics: List()" if topics else ""
    return F.format_string(
        f"[id: %s, corpus: %s, department: %s, module: %s{extra}]\n%s",
        "id", "corpus", "department", "module", "text",
    )


def candidates_baseline(
    analysed: DataFrame,
    snippets: DataFrame,
    index: Index | None = None,
    qid: str = "qid",
    use_focus: bool = False,
    n: int = fixed.TERM_HITS,
    with_text: bool = True,
) -> DataFrame:
    """Candidate snippets by full-text search: (qid, id, offset, ranking, rank[, candidate]).

    A question without words has no candidates.
    """
    index = index or build_index(snippets, SNIPPET_KEYS)
    hits = find_terms(index, question_words(analysed, use_focus), qid, "words", n)
    out = hits.withColumnRenamed("score", "ranking")
    return candidate_text(out, snippets) if with_text else out


def candidate_text(
    candidates: DataFrame, snippets: DataFrame, keys: Sequence[str] = SNIPPET_KEYS, topics: bool = False
) -> DataFrame:
    """Candidates with the header and text of their snippet; ``topics`` as for vector candidates.

    The candidates are stored and measured: while they are few they go to the snippets, whose
    texts are then not moved at all.
    """
    texts = snippets.select(*keys, *[c for c in snippets.columns if c == "part"], _candidate_text(topics).alias("candidate"))
    if "part" not in snippets.columns:
        return lookup_join(texts, settle(candidates), list(keys))
    placed = settle(candidates.withColumn("part", _snippet_part()))
    return lookup_join(texts, placed, [*keys, "part"]).drop("part")


def _snippet_part() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(SNIPPET_PARTS)).cast("int")


def write_snippets(snippets: DataFrame, path: str) -> DataFrame:
    """Store snippets in folders by a hash of their id: fetching candidates reads only their folders."""
    rows = snippets.withColumn("part", _snippet_part())
    rows.repartitionByRange("part", *SNIPPET_KEYS).sortWithinPartitions("part", *SNIPPET_KEYS).write.partitionBy("part").parquet(path)
    return snippets.sparkSession.read.parquet(path)


def candidates_vectors(
    analysed: DataFrame,
    snippets: DataFrame,
    vocab: DataFrame,
    qid: str = "qid",
    use_focus: bool = False,
    n: int = fixed.NEIGHBORS,
    stored: DataFrame | None = None,
    with_text: bool = False,
) -> DataFrame:
    """Candidate snippets by vector similarity: (qid, id, offset, ranking, rank[, candidate]).

    Snippet vectors are taken from ``stored`` (id, offset, vec) if given, else computed.

    The question vector is the mean of its words without stopwords, or the average of the
    paragraph vectors of its focus phrases. A question with an unknown word has none.
    """
    dim = em.vector_size(vocab)
    if use_focus:
        parts = analysed.select(qid, F.posexplode("focus").alias("_at", "text")).select(
            qid, F.struct(qid, "_at").alias("_part"), "text"
        )
        vecs = em.paragraph_vector(parts, "_part", vocab, dim=dim)
        asked = em.average(vecs.select(F.col(f"_part.{qid}").alias(qid), "vec"), qid, dim)
    else:
        asked = em.centroid(question_words(analysed), qid, "words", vocab, dim)
    item = F.concat_ws("@", *SNIPPET_KEYS).alias("item")
    if stored is None:
        items = em.paragraph_vector(snippets.select(item, "text"), "item", vocab, dim=dim)
    else:
        items = stored.select(item, "vec")
    found = nearest_neighbors(asked.select(F.col(qid).alias("qid"), "vec"), items, n)
    out = found.select(
        F.col("qid").alias(qid),
        F.regexp_extract("item", r"(?s)^(.*)@([0-9]+)$", 1).alias("id"),
        F.regexp_extract("item", r"(?s)^(.*)@([0-9]+)$", 2).cast("int").alias("offset"),
        F.col("score").alias("ranking"),
        "rank",
    )
    return candidate_text(out, snippets, topics=True) if with_text else out


def snippet_vectors(snippets: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, offset, vec): paragraph vectors of snippets, to be stored and handed to later batches."""
    item = F.struct(*SNIPPET_KEYS).alias("item")
    vecs = em.paragraph_vector(snippets.select(item, "text"), "item", vocab)
    return vecs.select("item.*", "vec")


def _overlaps(sents: Column, bow: Column) -> Column:
    def of_bag(bag: Column) -> Column:
        return F.transform(
            sents,
            lambda s: F.struct(
                s["piece"].alias("sentence"),
                s["start"].alias("start"),
                (F.size(F.array_intersect(tx.tokens(s["piece"]), bag)) / F.size(bow)).alias("overlap"),
            ),
        )

    return tx.let(F.array_distinct(bow), of_bag)


def _hits(sents: Column, bow: Column, threshold: float) -> Column:
    # sentences above the threshold; those of a run share position minus rank
    hit = F.filter(
        F.transform(_overlaps(sents, bow), lambda x, i: F.struct(i.alias("at"), *[x[c].alias(c) for c in ("sentence", "start", "overlap")])),
        lambda x: x["overlap"] >= threshold,
    )
    return F.transform(
        hit, lambda x, rank: F.struct((x["at"] - rank).alias("_run"), *[x[c].alias(f"_{c}") for c in ("at", "sentence", "start", "overlap")])
    )


def extract_passages(
    docs: DataFrame, bow: str = "bow", text: str = "text", threshold: float = fixed.OVERLAP_THRESHOLD
) -> DataFrame:
    """Runs of consecutive sentences that share enough words with the question.

    Each row of ``docs`` is a document together with a question's words. The overlap of a
    sentence is the share of question words it has, the ranking of a run their product.
    """
    rest = [c for c in docs.columns if c not in (bow, text)]
    found = F.when(F.size(bow) > 0, _hits(tx.located_sentences(F.col(text)), F.col(bow), threshold))
    # rows are told apart by all they hold; equal rows have equal passages
    own = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not holds_map(docs.schema[c].dataType)])
    every = docs.withColumn("_row", own).select(*rest, "_row", F.inline(found))
    # equal rows bring each sentence once more: merged before a run is put together
    columns = F.struct(*[F.col(f"`{c}`") for c in rest])
    once = every.groupBy("_row", "_run", "_at").agg(
        F.first(columns).alias("_rest"), F.first("_sentence").alias("_sentence"), F.first("_overlap").alias("_overlap"),
        F.first("_start").alias("_start"), F.count(F.lit(1)).cast("int").alias("_copies"),
    )
    runs = once.groupBy("_row", "_run").agg(
        F.first("_rest").alias("_rest"), *_passage(F.col("_at"), F.col("_sentence"), F.col("_overlap"), F.col("_start")), F.first("_copies").alias("_copies"))
    return runs.select(
        "_rest.*", *_told_passage(), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")


def _passage(at: Column, sentence: Column, overlap: Column, start: Column) -> list[Column]:
    ordered = F.array_sort(F.collect_list(F.struct(at.alias("at"), sentence.alias("sentence"), overlap.alias("overlap"))))
    return [ordered.alias("_sents"), F.min(start).alias("offset")]


def _told_passage() -> list[Column]:
    return [
        F.array_join(F.transform("_sents", lambda s: s["sentence"]), " ").alias("passage"),
        F.aggregate("_sents", F.lit(1.0), lambda p, s: p * s["overlap"]).alias("ranking"),
        F.col("offset"),
    ]


def sentence_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, at, sentence, start, words): the sentences of each document, tokenised once for all questions."""
    rows = docs.select(key, F.posexplode(tx.located_sentences(F.col(text))).alias("at", "_s"))
    return rows.select(key, "at", F.col("_s.piece").alias("sentence"), F.col("_s.start").alias("start"), F.array_distinct(tx.tokens(F.col("_s.piece"))).alias("words"))


def find_passages(
    sentences: DataFrame, asked: DataFrame, key: str, qid: str = "qid", bow: str = "bow", threshold: float = fixed.OVERLAP_THRESHOLD
) -> DataFrame:
    """(qid, key, passage, ranking, offset) like ``extract_passages``, for pairs ``asked`` (qid, key, bow) of questions and documents.

    ``sentences`` is a ``sentence_table``, best a stored one. The words of a question are looked up among the
    words of the document's sentences; a sentence without any is never met. Runs are sentences whose place less
    their number among the question's sentences of the document is the same. A pair counts once.
    """
    asked = settle(asked.select(qid, key, F.size(bow).alias("_size"), F.array_distinct(bow).alias("_bag")).distinct())
    words = asked.select(qid, key, "_size", F.explode("_bag").alias("_word"))
    postings = lookup_join(sentences, asked.select(key).distinct(), key, "left_semi").select(key, "at", F.explode("words").alias("_word"))
    shared = lookup_join(postings, words, [key, "_word"]).groupBy(qid, key, "at", "_size").agg(F.count(F.lit(1)).alias("_shared"))
    hits = shared.withColumn("_overlap", F.col("_shared") / F.col("_size")).filter(F.col("_overlap") >= threshold)
    placed = number_rows(hits.select(qid, key, "at", "_overlap"), [F.col("at")], [qid, key], "_nth")
    placed = lookup_join(sentences.select(key, "at", "sentence", "start"), placed, [key, "at"])
    runs = placed.groupBy(qid, key, (F.col("at") - F.col("_nth")).alias("_run")).agg(*_passage(F.col("at"), F.col("sentence"), F.col("_overlap"), F.col("start")))
    return runs.select(qid, key, *_told_passage())


def _best_first(tie: Sequence[str]) -> list[Column]:
    return [from_best(F.col("ranking")), *[F.col(t) for t in tie]]


def rank_passing(candidates: DataFrame, qid: str = "qid", tie: Sequence[str] = SNIPPET_KEYS) -> DataFrame:
    """All candidates by ranking, best first, with blank topic and lecture."""
    ranked = number_rows(candidates.drop("rank"), _best_first(tie), [qid], "rank")
    return ranked.withColumn("topic", F.lit("")).withColumn("lecture", F.lit(""))


def rank_metadata(candidates: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with module and type of their source document; unknown documents drop out."""
    candidates = settle(candidates)  # measured and used twice
    meta = docs.select(key, F.col("module").alias("topic"), F.col("type").alias("lecture"))
    # the few candidates go to the documents; a document that is there twice counts once
    wanted = lookup_join(candidates.select(key).distinct(), meta, key).distinct()
    return lookup_join(candidates, wanted, key)


def unmatched_candidates(candidates: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """How many candidates ``rank_metadata`` would drop."""
    lost = candidates.join(docs.select(key).distinct(), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("dropped"))


def select_answer(
    candidates: DataFrame,
    qid: str = "qid",
    threshold: float = fixed.ANSWER_THRESHOLD,
    tie: Sequence[str] = SNIPPET_KEYS,
) -> DataFrame:
    """Best candidate per question, and whether its ranking is above the threshold."""
    best = first_per_key(candidates, [qid], _best_first(tie)).drop("rank")
    # Spark sorts NaN above all numbers; a NaN ranking is no answer
    above = (F.col("ranking") > threshold) & ~F.isnan("ranking")
    return best.withColumn("accepted", above)


def classify_outcome(questions: DataFrame, best: DataFrame, qid: str = "qid", keys: Sequence[str] = SNIPPET_KEYS) -> DataFrame:
    """One row per question: answered, no_answer (ranking 1.0) or failed (0.0, no candidates)."""
    found = questions.select(qid).join(best, qid, "left")
    missing = F.col("accepted").isNull()
    status = F.when(missing, "failed").when(F.col("accepted"), "answered").otherwise("no_answer")
    ranking = F.when(missing, 0.0).when(F.col("accepted"), F.col("ranking")).otherwise(1.0)
    text = F.when(missing, "[FAILED]").when(~F.col("accepted"), "[NO ANSWER]")
    if "candidate" in best.columns:
        text = text.otherwise(F.col("candidate"))
    answered = [F.when(F.col("accepted"), F.col(k)).alias(k) for k in keys]
    return found.select(qid, status.alias("status"), text.alias("answer"), ranking.alias("ranking"), *answered)


def ask_batch(
    questions: DataFrame,
    snippets: DataFrame,
    index: Index | None = None,
    gazetteer: DataFrame | None = None,
    vocab: DataFrame | None = None,
    qid: str = "qid",
    text: str = "question",
    use_focus: bool = False,
    threshold: float = fixed.ANSWER_THRESHOLD,
    extraction: str = "passing",
    ranking: str = "passing",
    docs: DataFrame | None = None,
    docs_index: Index | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Questions in, one answer row per question out: (qid, status, answer, ranking, id, offset, topic, lecture).

    Analysis, extraction, candidates, ranking and answer, as the pipeline has them. Candidates
    come from full-text search, or from vectors when a vocabulary is given (of the snippets, or
    ``stored`` by ``snippet_vectors``). ``extraction`` finds documents (id, module, type) of
    ``docs`` by ``docs_index`` for ``ranking="metadata"``, which takes topic and lecture from
    the documents found and drops other candidates; with ``passing`` extraction it takes
    them from all ``docs``. Only the best candidate's text is fetched.
    """
    analysed = analyze_questions(questions, gazetteer, qid, text)
    if vocab is None:
        found = candidates_baseline(analysed, snippets, index, qid, use_focus, with_text=False)
    else:
        found = candidates_vectors(analysed, snippets, vocab, qid, use_focus, stored=stored)
    if ranking == "metadata":
        if docs is None:
            raise ValueError("metadata ranking needs docs")
        if extraction == "passing":
            found = rank_metadata(found, docs)
        else:
            hits = extract(analysed, docs_index or build_index(docs, ["id"]), extraction, qid)
            asked = lookup_join(docs.select("id", "module", "type"), hits.select(qid, "id").distinct(), "id")
            meta = asked.select(qid, "id", F.col("module").alias("topic"), F.col("type").alias("lecture")).distinct()
            found = lookup_join(found, meta, [qid, "id"])
    elif ranking == "passing":
        found = found.withColumn("topic", F.lit("")).withColumn("lecture", F.lit(""))
    else:
        raise ValueError(f"unknown ranking {ranking!r}")
    best = select_answer(found, qid, threshold)
    return classify_outcome(questions, candidate_text(best, snippets, topics=vocab is not None), qid, (*SNIPPET_KEYS, "topic", "lecture"))


def ask(question: str, snippets: DataFrame, **options: object) -> DataFrame:
    """Answer a single question."""
    spark = snippets.sparkSession
    asked = spark.createDataFrame([(1, question)], "qid bigint, question string")
    return ask_batch(asked, snippets, **options)


def assign_question_ids(requests: DataFrame, order_by: Sequence[str], name: str = "qid", first: int = 1) -> DataFrame:
    """Unique increasing ids in order of the request key."""
    numbered = number_rows(requests, [F.col(c) for c in order_by], name=name)
    return numbered.withColumn(name, F.col(name) + (first - 1))
