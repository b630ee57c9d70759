"""Dictionary-based entity linking and tagging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusqa.functions import fixed
from corpusqa.functions import text as tx
from corpusqa.operators.joins import fits_broadcast, lookup_join
from corpusqa.operators.search import CLUE_TYPE
from corpusqa.session import settle


# Tokens of texts that are looked at, at once.
BLOCK_TOKENS = 1 << 20
# What a pattern's \s stands for.
BLANKS = " \t\n\x0b\f\r"
# fixed.WORD_PATTERN, which never has to go back.
_WORD = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"
_CAPITAL = r"\p{Lu}[\p{L}\p{N}]*+(?:['’-][\p{L}\p{N}]++)*+"
_OTHERS = rf"(?:[^\p{{L}}\p{{N}}]++|(?!\p{{Lu}}){_WORD})"  # of tokens and blanks, to be repeated


def filter_links(
    links: DataFrame, min_score: float = fixed.LINK_SCORE, min_support: int = fixed.LINK_SUPPORT
) -> DataFrame:
    """Links with enough confidence and support."""
    return links.filter((F.col("score") >= min_score) & (F.col("support") >= min_support))


def gazetteer_keys(gazetteer: DataFrame) -> DataFrame:
    """The gazetteer with the blank-joined tokens of each surface as its key.

    Of several entries with the same key the best supported one is kept.
    """
    keyed = gazetteer.withColumn("_key", F.array_join(tx.tokens(F.col("surface")), " "))
    rest = [c for c in gazetteer.columns]
    best = F.struct(F.col("support"), F.col("score"), F.col("uri"))
    return (
        keyed.filter(F.col("_key") != "")
        .groupBy("_key")
        .agg(F.max_by(F.struct(*rest), best).alias("_g"))
        .select("_key", "_g.*")
    )


def prefix_tables(entries: DataFrame) -> list[DataFrame]:
    """Which beginnings of 1, 2, 4, 8, ... tokens some ``_key`` has: (_prefix, lengths, longest) for each.

    ``lengths`` are those of keys that begin so and are shorter than the next table's beginnings,
    ``longest`` tells whether there is a longer key. The tables are as many as the doublings of the longest key.
    """
    keys = entries.select(F.split("_key", " ").alias("_t")).withColumn("_n", F.size("_t"))
    most = keys.agg(F.max("_n")).first()[0] or 1
    tables, width = [], 1
    while width <= most:
        begin = F.array_join(F.slice("_t", 1, width), " ").alias("_prefix")
        short = F.collect_set(F.when(F.col("_n") < 2 * width, F.col("_n")))
        tables.append(keys.filter(F.col("_n") >= width).groupBy(begin).agg(short.alias("_lengths"), F.max("_n").alias("_longest")))
        width *= 2
    return tables


def _run_key(tokens: Column, n: Column | int) -> Column:
    return F.array_join(F.transform(F.slice(tokens, 1, n), lambda t: t["piece"]), " ")


def candidate_runs(docs: DataFrame, entries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, at, n, start, length, _key): the runs of tokens that can be a key of ``entries``.

    A token that begins no key is dropped at once. A run grows by doubling, and only while what it has is the
    beginning of a key; of the lengths between two doublings those are taken that such keys have.
    """
    tables = [settle(t) for t in prefix_tables(entries)]
    # the outer form, so that Spark infers no filter that tokenises once more
    rows = docs.select(key, tx.located_tokens(F.col(text)).alias("_toks")).select(key, "_toks", F.posexplode_outer("_toks").alias("at", "_tok"))
    rows = rows.withColumn("_prefix", F.col("_tok.piece")).drop("_tok")
    rows = lookup_join(rows, tables[0], "_prefix")
    rows = rows.select(key, "at", F.slice("_toks", F.col("at") + 1, F.col("_longest")).alias("_run"), F.col("_lengths").alias("_ns"), F.col("_longest").alias("_most"))
    for level, table in enumerate(tables[1:], 1):
        width = 1 << level
        prefix = F.when((F.col("_most") >= width) & (F.size("_run") >= width), _run_key(F.col("_run"), width))
        joined = lookup_join(rows.withColumn("_prefix", prefix), table, "_prefix", "left")
        more = F.coalesce("_lengths", F.array().cast("array<int>"))
        rows = joined.select(key, "at", "_run", F.concat("_ns", more).alias("_ns"), F.coalesce("_longest", F.lit(0)).alias("_most"))
    lengths = F.filter("_ns", lambda n: n <= F.size("_run"))
    rows = rows.select(key, "at", "_run", F.explode(lengths).alias("n"))
    last = F.element_at("_run", F.col("n"))
    first = F.get("_run", F.lit(0))["start"]
    return rows.select(
        key, "at", "n", first.alias("start"), (last["start"] + F.length(last["piece"]) - first).alias("length"), _run_key(F.col("_run"), F.col("n")).alias("_key"))


def _leftmost_longest(found: Column) -> Column:
    # ordered by position, longer first: keep what starts at or after the end of the last kept.
    # The fold carries a mark for each find, not the finds themselves.
    def marked(ordered: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit("").alias("marks"))

        def step(s: Column, m: Column) -> Column:
            fits = m["at"] >= s["end"]
            return F.struct(
                F.when(fits, m["at"] - m["minus_n"]).otherwise(s["end"]).alias("end"),
                F.concat(s["marks"], F.when(fits, "1").otherwise("0")).alias("marks"),
            )

        marks = F.split(F.aggregate(ordered, start, step, lambda s: s["marks"]), "")
        return tx.let(marks, lambda k: F.filter(ordered, lambda m, i: F.get(k, i) == "1"))

    return tx.let(F.array_sort(found), marked)


class _Trie:
    """The keys of a gazetteer as paths of tokens: numbered nodes, the root is 0."""

    def __init__(self, keys: pa.Array):
        paths = [k.split(" ") for k in keys.to_pylist()]
        self.keys, self.words = keys, pa.array(sorted({w for p in paths for w in p}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        nodes: dict[int, int] = {}  # parent times words plus word -> node
        ends: dict[int, int] = {}
        for k, path in enumerate(paths):
            at = 0
            for w in path:
                at = nodes.setdefault(at * len(number) + number[w], len(nodes) + 1)
            ends[at] = k
        self.steps = np.array(sorted(nodes), np.int64)
        self.to = np.array([nodes[x] for x in self.steps.tolist()], np.int64)
        self.key_of = np.full(len(nodes) + 1, -1, np.int64)
        self.key_of[list(ends)] = list(ends.values())

    def longest(self, code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, tokens, key): the longest key that begins at each place where one does; ``end`` is that of the place's text."""
        most, key = np.zeros(len(code), np.int64), np.full(len(code), -1, np.int64)
        at = np.flatnonzero(code >= 0)
        node, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            word = code[at + depth]
            step = node * len(self.words) + word
            place = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            goes = (word >= 0) & (self.steps[place] == step)
            at, node = at[goes], self.to[place[goes]]
            depth += 1
            done = self.key_of[node] >= 0
            most[at[done]], key[at[done]] = depth, self.key_of[node[done]]
            more = at + depth < end[at]
            at, node = at[more], node[more]
        found = np.flatnonzero(key >= 0)
        return found, most[found], key[found]


def row_blocks(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists hold about ``most`` elements, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _spans(batches: Iterator[pa.RecordBatch], trie: _Trie) -> Iterator[pa.RecordBatch]:
    """Leftmost, then longest, keys of texts that are cut into tokens with the blanks before them."""
    for batch in batches:
        for block in row_blocks(batch, 1, BLOCK_TOKENS):
            lists = block.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = lists.flatten()
            tokens = pc.utf8_ltrim(pieces, characters=BLANKS)
            code = pc.fill_null(pc.index_in(tokens, value_set=trie.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at, n, key = trie.longest(code, np.cumsum(sizes)[row])
            keep, end = [], 0
            for i, (p, k) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
                if p >= end:
                    keep.append(i)
                    end = p + k
            if not keep:
                continue
            at, n, key = at[keep], n[keep], key[keep]
            ends = np.cumsum(pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
            own = pc.utf8_length(tokens).to_numpy(zero_copy_only=False)
            begin = np.append(0, ends)[np.cumsum(sizes) - sizes]  # of each text
            start = ends[at] - own[at]
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(row[at])), pa.array(start - begin[row[at]]), pa.array(ends[at + n - 1] - start), trie.keys.take(pa.array(key))],
                names=["_of", "start", "length", "_key"])


def _link_rows(docs: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """``link_entities`` of texts that have a key each, inside the row of the text."""
    # tx.tokens with the blanks before each; those at the end of a text are a piece of their own
    pattern = rf"\s*+(?:{_WORD}|[^\s\p{{L}}\p{{N}}])|\s++"
    if entries.filter(~F.col("_key").rlike(r"^\p{Lu}[^ ]*(?: \p{Lu}[^ ]*)*$")).isEmpty():
        # no other token is in a key: what lies between two capitalised tokens is one piece
        pattern = rf"\s*+{_CAPITAL}|{_OTHERS}++"
    pieces = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    keys = entries.select("_key").toArrow()["_key"].combine_chunks()
    kind = T.StructType([T.StructField("_of", docs.schema[key].dataType)]).add("start", T.LongType()).add("length", T.LongType()).add("_key", T.StringType())
    spans = docs.select(F.col(key).alias("_of"), pieces.alias("_pieces")).mapInArrow(partial(_spans, trie=_Trie(keys)), kind)
    return spans.join(F.broadcast(entries), "_key").select(
        F.col("_of").alias(key), "start", "length", F.concat(F.lit("<"), F.col("uri"), F.lit(">")).alias("uri"), "label",
        F.col("score").alias("probability"), F.col("surface").alias("surface_form"), "types")


def link_entities(docs: DataFrame, gazetteer: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Entities of a text: (key, uri, label, probability, start, length, surface_form, types).

    Runs of tokens that begin like a surface are looked up in the gazetteer (surface, uri, label, types,
    support, score); of overlapping finds the leftmost, then longest, wins. Offsets are char offsets.

    Where the surfaces fit the broadcast bound, a text is linked in its row. The finds of rows that share
    a key compete: those rows, and all where the surfaces are too many, are linked by joins.
    """
    entries = settle(gazetteer_keys(filter_links(gazetteer)))
    docs = docs.select(key, text)
    if not fits_broadcast(entries):
        return _link_joined(docs, entries, key, text)
    repeated = settle(docs.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again"))
    if repeated.isEmpty():
        return _link_rows(docs, entries, key, text)
    again = F.col(key).eqNullSafe(F.col("_again"))
    single = _link_rows(docs.join(repeated, again, "left_anti"), entries, key, text)
    return single.unionByName(_link_joined(docs.join(repeated, again, "left_semi"), entries, key, text))


def _link_joined(docs: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """``link_entities`` by joins: nothing of the gazetteer is held whole."""
    hits = lookup_join(candidate_runs(docs, entries, key, text), entries, "_key")
    found = F.struct(
        F.col("at"),
        (-F.col("n")).alias("minus_n"),
        F.col("start").cast("bigint").alias("start"),
        F.col("length").cast("bigint").alias("length"),
        F.concat(F.lit("<"), F.col("uri"), F.lit(">")).alias("uri"),
        F.col("label"),
        F.col("score").alias("probability"),
        F.col("surface").alias("surface_form"),
        F.col("types"),
    )
    # runs of finds that overlap: only inside a run do finds compete
    order = Window.partitionBy(key).orderBy("at", F.col("n").desc())
    end = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = hits.withColumn("_opens", (F.col("at") >= F.coalesce(end, F.lit(0))).cast("int"))
    run = F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = placed.withColumn("_run", run).groupBy(key, "_run").agg(F.collect_list(found).alias("_found"))
    return runs.select(key, F.inline(_leftmost_longest(F.col("_found")))).drop("at", "minus_n")


def capital_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(surface, n): how often each capitalised token, and each two in a row, occurs. Tokens hold no blank."""
    # runs of capitalised tokens; what stands before one is passed over, token by token
    found = F.regexp_extract_all(F.col(text), F.lit(rf"{_OTHERS}*+({_CAPITAL}(?:\s++{_CAPITAL})*+|\z)"), F.lit(1))
    runs = docs.select(F.explode(found).alias("_run")).filter("_run <> ''").groupBy("_run").agg(F.count(F.lit(1)).alias("n"))

    def grams(t: Column) -> Column:
        return F.concat(t, F.transform(F.slice(t, 2, F.size(t)), lambda w, i: F.concat(F.get(t, i), F.lit(" "), w)))

    rows = runs.select(F.explode(tx.let(F.split("_run", r"\s+"), grams)).alias("surface"), "n")
    return rows.groupBy("surface").agg(F.sum("n").alias("n"))


def attach_clues(docs: DataFrame, links: DataFrame, key: str, column: str = "clues") -> DataFrame:
    """Documents with their links appended to ``clues``."""
    clue = F.struct(
        F.col("uri").alias("id"),
        F.lit("entity").alias("type"),
        F.col("probability"),
        F.col("start"),
        F.col("length"),
        F.col("surface_form"),
        F.col("types"),
    )
    by_start = F.array_sort(F.collect_list(F.struct(F.col("start").alias("_o"), clue.alias("_c"))))
    per_doc = links.groupBy(key).agg(F.transform(by_start, lambda x: x["_c"]).alias("_new"))
    empty = F.array().cast(f"array<{CLUE_TYPE}>")
    old = F.coalesce(F.col(column), empty) if column in docs.columns else empty
    joined = docs.join(per_doc, key, "left")
    return joined.withColumn(
        column, F.concat(old, F.coalesce(F.col("_new"), empty)).cast(f"array<{CLUE_TYPE}>")
    ).drop("_new")


def clear_clues(docs: DataFrame, column: str = "clues") -> DataFrame:
    return docs.withColumn(column, F.array().cast(f"array<{CLUE_TYPE}>"))


def question_entities(questions: DataFrame, gazetteer: DataFrame, qid: str, text: str = "question") -> DataFrame:
    """Lower-cased entity surface -> label per question; of equal surfaces the later one wins.

    ``last_label`` and ``last_entity`` belong to the last entity of the question.
    """
    links = link_entities(questions.select(qid, text), gazetteer, qid, text)
    low = links.withColumn("surface", F.lower("surface_form"))
    once = low.groupBy(qid, "surface").agg(
        F.max_by("label", "start").alias("label"), F.max("start").alias("at")
    )
    entries = F.array_sort(F.collect_list(F.struct("at", "surface", "label")))
    return once.groupBy(qid).agg(
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["surface"], e["label"]))
        ).alias("entities"),
        F.max_by("label", "at").alias("last_label"),
        F.max_by("surface", "at").alias("last_entity"),
    )


def tag_tokens(docs: DataFrame, key: str, text: str = "text", tags: DataFrame | None = None) -> DataFrame:
    """(key, pos, token, tag) with closed-class tags, or those of a (token, tag) table first."""
    rows = docs.select(key, F.posexplode(tx.tokens(F.col(text))).alias("pos", "token"))
    if tags is None:
        return rows.withColumn("tag", tx.token_tag(F.col("token")))
    found = lookup_join(rows, tags.select("token", "tag"), "token", "left")
    return found.withColumn("tag", F.coalesce("tag", tx.token_tag(F.col("token")))).select(
        key, "pos", "token", "tag"
    )
