"""Corpus profile: word, pair, sentence and tag counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import text as tx
from corpusqa.operators.joins import lookup_join
from corpusqa.operators.pairs import pair_sums
from corpusqa.session import settle, stored

# Words per side of one unit of pair work.
PAIR_BLOCK = 2048


def token_rows(docs: DataFrame, keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """One row per token of ``docs``."""
    return docs.select(*keys, F.explode(tx.words(F.col(text))).alias("token"))


def word_count(docs: DataFrame, keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Tokens and how often they occur, over all documents or per ``keys``."""
    return (
        token_rows(docs, keys, text).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("count"))
    )


def word_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """Share of each token among all tokens of the corpus."""
    counts = word_count(docs, (), text)
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("frequency", F.col("count") / total)


def word_frequency_per_document(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Share of each token among the tokens of its own document."""
    toks = docs.select(key, tx.words(F.col(text)).alias("_t"))
    rows = toks.select(key, F.size("_t").alias("_n"), F.explode("_t").alias("token"))
    counts = rows.groupBy(key, "_n", "token").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(key, "token", "count", (F.col("count") / F.col("_n")).alias("frequency"))


def _distinct_sentences(docs: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    # Word multisets of sentences with the number of sentences that share one: copied and
    # boiler-plate sentences are counted here, by a digest, and their pairs built only once.
    bag = F.array_sort(tx.without_punctuation(F.col("_s")))
    return (
        docs.select(*keys, F.explode(tx.sentence_tokens(F.col(text))).alias("_s"))
        .select(*keys, bag.alias("_bag"))
        .filter(F.size("_bag") > 1)
        .withColumn("_id", F.sha2(F.array_join("_bag", " "), 256))
        .groupBy(*keys, "_id")
        .agg(F.count(F.lit(1)).alias("_copies"), F.first("_bag").alias("_bag"))
    )


def _blocks(words: Column) -> Column:
    last = F.ceil(F.size(words) / F.lit(PAIR_BLOCK)).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda b: F.slice(words, b * PAIR_BLOCK + 1, F.lit(PAIR_BLOCK)),
    )


def cooc_sentence(docs: DataFrame, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of different words of a sentence, summed over all sentences.

    A pair counts tf(x) * tf(y) per sentence. Distinct sentences are stored, their pairs counted by ``pair_sums``. The
    words of a long sentence are cut into blocks; the block numbers are paired first and the words joined to
    them, so that a very long sentence is many tasks' work.
    """
    sentences = stored(_distinct_sentences(docs, text, keys), "sentences")
    group, groups = F.lit(0), None
    if keys:
        groups = settle(sentences.select(*keys).distinct().withColumn("_group", F.monotonically_increasing_id()))
        sentences = _null_safe(sentences, groups, keys)
        group = F.col("_group")
    n = F.size("_bag").cast("double")
    pairs = sentences.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    by = [group.alias("_group"), "_id", "_copies"]
    whole = F.size("_bag") <= PAIR_BLOCK
    short = sentences.filter(whole).select(*by, F.col("_bag").alias("_words"), F.lit(-1).alias("_split"))
    blocks = sentences.filter(~whole).select(*by, _blocks(F.col("_bag")).alias("_blocks"))
    blocks = blocks.select("_group", "_id", "_copies", F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("_i", "_words"))
    inside = blocks.select("_group", "_id", "_copies", "_words", F.lit(-1).alias("_split"))
    numbers = blocks.filter("_i < _n - 1").select("_group", "_id", "_copies", "_i", F.explode(F.sequence(F.col("_i") + 1, F.col("_n") - 1)).alias("_j"))
    left = blocks.select("_group", "_id", "_i", F.col("_words").alias("_left"))
    right = blocks.select("_group", "_id", F.col("_i").alias("_j"), F.col("_words").alias("_right"))
    between = numbers.join(left, ["_group", "_id", "_i"]).join(right, ["_group", "_id", "_j"]).select(
        "_group", "_id", "_copies", F.concat("_left", "_right").alias("_words"), F.size("_left").alias("_split"))
    found = pair_sums(short.unionByName(inside).unionByName(between), pairs)
    if groups is not None:
        found = lookup_join(found, groups, "_group")
    return found.select(*keys, F.col("a").alias("first"), F.col("b").alias("second"), "count")


def _null_safe(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    # a null among the keys is a key like any other
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.alias("a").join(b.alias("b"), same).select("a.*", *[f"b.{c}" for c in b.columns if c not in on])


def sentence_pairs(tokens_: Column, stop_on_repeat: bool = True) -> Column:
    return tx.adjacent_pairs(tx.without_punctuation(tokens_), stop_on_repeat)


def cooc_adjacent(docs: DataFrame, text: str = "text", stop_on_repeat: bool = True) -> DataFrame:
    """Neighbouring words of a sentence as unordered pairs with their counts."""
    pairs = F.flatten(
        F.transform(
            tx.sentence_tokens(F.col(text)), lambda s: sentence_pairs(s, stop_on_repeat)
        )
    )
    return (
        docs.select(F.explode(pairs).alias("_p"))
        .groupBy(F.col("_p.first").alias("first"), F.col("_p.second").alias("second"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def sentence_length_hist(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sentence length in tokens -> number of sentences."""
    lengths = F.transform(tx.sentence_tokens(F.col(text)), F.size)
    return (
        docs.select(F.explode(lengths).alias("length"))
        .groupBy("length")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def avg_sentence_length(docs: DataFrame, text: str = "text") -> DataFrame:
    """Mean number of tokens per sentence."""
    hist = sentence_length_hist(docs, text)
    return hist.agg(
        (F.sum(F.col("length") * F.col("count")) / F.sum("count")).alias("avg_sentence_length")
    )


def dimension_count(docs: DataFrame, dimension: str) -> DataFrame:
    """Documents per value of a column."""
    return docs.groupBy(F.col(dimension).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def doc_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("docs"))


def corpus_stats(docs: DataFrame, department: str, module: str, text: str = "text") -> DataFrame:
    """One row: documents, words, unique words, departments, modules, mean sentence length.

    Every document gives (section, key) entries, counted inside the tasks: one scan, one shuffle.
    """
    rows = docs.select(
        F.col(department).cast("string").alias("_d"), F.col(module).cast("string").alias("_m"), tx.sentence_tokens(F.col(text)).alias("_s"),
        tx.words(F.col(text)).alias("_w"),
    )
    entries = F.concat(
        _entries("docs", F.array(F.lit(""))),
        _entries("department", F.array("_d")),
        _entries("module", F.array("_m")),
        _entries("length", F.transform(F.coalesce("_s", F.array().cast("array<array<string>>")), lambda s: F.size(s).cast("string"))),
        _entries("word", F.coalesce("_w", F.array().cast("array<string>"))),
    )
    counts = rows.select(F.inline(entries)).groupBy("section", "key").agg(F.count(F.lit(1)).alias("count"))

    def of(section: str, value: Column) -> Column:
        return F.when((F.col("section") == section) & F.col("key").isNotNull(), value)

    lengths = F.sum(of("length", F.col("key").cast("long") * F.col("count")))
    return counts.agg(
        F.coalesce(F.sum(of("docs", F.col("count"))), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(of("word", F.col("count"))), F.lit(0)).alias("words"),
        F.count(of("word", F.lit(1))).alias("unique_words"),
        F.count(of("department", F.lit(1))).alias("departments"),
        F.count(of("module", F.lit(1))).alias("modules"),
        (lengths / F.sum(of("length", F.col("count")))).alias("avg_sentence_length"),
    )


def _entries(section: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(section).alias("section"), k.alias("key")))


def corpus_profile(
    docs: DataFrame,
    department: str,
    module: str,
    text: str = "text",
    gazetteer: DataFrame | None = None,
    key: str = "doc_id",
    sentence_cooc: bool = False,
) -> DataFrame:
    """All count sections as (section, key, count), from one scan and one aggregation.

    Every document is turned into (section, key) entries; keys are counted inside the
    tasks before the shuffle. Entity labels (``gazetteer``) and sentence-wise
    co-occurrence need joins of their own and are added on request.
    """
    base = docs.select(
        F.coalesce(F.col(department), F.lit("")).alias("_d"),
        F.coalesce(F.col(module), F.lit("")).alias("_m"),
        tx.sentence_tokens(F.lower(F.col(text))).alias("_s"),
    )
    sents = F.col("_s")
    toks = F.flatten(sents)
    pair_keys = F.flatten(
        F.transform(
            sents,
            lambda s: F.transform(
                sentence_pairs(s), lambda p: F.concat_ws(",", p["first"], p["second"])
            ),
        )
    )
    entries = F.concat(
        _entries("general", F.array(F.lit("docs"))),
        _entries("department", F.array(F.col("_d"))),
        _entries("module", F.array(F.col("_m"))),
        _entries("sentence_length", F.transform(sents, lambda s: F.size(s).cast("string"))),
        _entries("word", toks),
        _entries("word_pair", pair_keys),
    )
    out = (
        base.select(F.explode(entries).alias("_e"))
        .groupBy(F.col("_e.section").alias("section"), F.col("_e.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # a word has one tag: its tag counts as often as the word
    tag = F.struct(F.lit("tag").alias("section"), F.concat_ws(",", tx.token_tag(F.col("key")), "key").alias("key"), "count")
    own = F.struct("section", "key", "count")
    out = out.select(F.explode(F.when(F.col("section") == "word", F.array(own, tag)).otherwise(F.array(own))).alias("_e")).select("_e.*")
    if gazetteer is not None:
        found = tag_counts_entities(docs, gazetteer, key, text)
        out = out.unionByName(
            found.select(
                F.lit("entity").alias("section"),
                F.concat_ws(",", "label", "surface").alias("key"),
                "count",
            )
        )
    if sentence_cooc:
        pairs = cooc_sentence(docs.select(F.lower(F.col(text)).alias("text")))
        out = out.unionByName(
            pairs.select(
                F.lit("sentence_pair").alias("section"),
                F.concat_ws(",", "first", "second").alias("key"),
                "count",
            )
        )
    return out


def merge_counts(*parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-wise sum of count tables."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys).agg(F.sum("count").alias("count"))


def tag_counts(docs: DataFrame, text: str = "text", tags: DataFrame | None = None) -> DataFrame:
    """(tag, word) counts: built-in closed-class tags, or a (token, tag) table of another tagger.

    Words are counted first, so a tag is looked up once per distinct word.
    """
    counts = word_count(docs, (), text)
    if tags is None:
        tagged = counts.withColumn("tag", tx.token_tag(F.col("token")))
    else:
        tagged = lookup_join(counts, tags.select("token", "tag"), "token", "left").withColumn(
            "tag", F.coalesce("tag", tx.token_tag(F.col("token")))
        )
    return tagged.groupBy("tag", F.lower("token").alias("surface")).agg(
        F.sum("count").alias("count")
    )


def tag_counts_entities(
    docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(label, surface) counts of the entities linked in the documents."""
    from corpusqa.operators.entities import link_entities

    links = link_entities(docs.select(key, text), gazetteer, key, text)
    return links.groupBy("label", F.lower("surface_form").alias("surface")).agg(
        F.count(F.lit(1)).alias("count")
    )


def category_counts(questions: DataFrame, top: str) -> DataFrame:
    """Questions under category ``top``: per last category, plus the taken and overall totals."""
    inside = questions.filter(F.array_contains("category", top))
    last = F.element_at("category", -1)
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), last.alias("key")),
        F.struct(F.lit("total").alias("kind"), F.lit("sum").alias("key")),
        F.when(
            F.col("taken"), F.struct(F.lit("total").alias("kind"), F.lit("taken").alias("key"))
        ),
    )
    return (
        inside.select(F.explode(kinds).alias("_k"))
        .filter(F.col("_k").isNotNull())
        .groupBy(F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def vector_dimensions(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Vector length -> number of vectors."""
    return vectors.groupBy(F.size(vec).alias("dimension")).agg(F.count(F.lit(1)).alias("count"))
