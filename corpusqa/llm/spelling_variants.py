"""Spelling variants: words one edit apart, found by FM-index search schemes, and their frequent forms.

Of two words one edit apart, the shorter with m letters, either the first or the last m // 2 letters are
the same. Words meet in a group for each such half; groups are dealt to tasks, and a group that is
too large for one is split by halving what is not yet known to be equal, at either side, as often as it takes.
A task lays its words, each between delimiters, into one text, and searches the intervals of its
suffix ranks: the half exactly, then on across the other with one letter replaced or left out.
An index answers extensions in one direction; one for the text and one for its reverse make both.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb
from corpusqa.operators.joins import lookup_join
from corpusqa.session import settle

# Fixed by the contract.
RUN = "[A-Za-zÀ-ÿ]+"
SLIP = 97  # a run whose checksum this divides loses a letter
MIN_LENGTH, MIN_COUNT = 5, 3

TASK_LETTERS = 1 << 20  # letters and delimiters that one task indexes
GROUP_LETTERS = 1 << 16  # a larger group is split


def slipped(run: Column, doc_id: Column) -> Column:
    """The lower-case run, without a letter where the contract's checksum says so."""
    low = F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low))
    at = (h % F.length(low)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(low, F.lit(1), at), F.substring(low, at + 2, F.length(low)))).otherwise(low)


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): runs of letters after ``slipped``, long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("run"), F.col("doc_id")).alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _group(p: Column, q: Column, word: Column) -> list[Column]:
    return [F.substring(word, F.lit(1), p).alias("head"), F.substring(word, F.length(word) - q + 1, q).alias("tail")]


def _members(words: DataFrame, group_letters: int) -> DataFrame:
    """(word, m, p, q, head, tail): the groups each word is in; p first and q last letters are equal there.

    m is the length of the shorter word of a pair: a word takes part with its length and with one less.
    """
    size = F.length("word")
    lengths = words.select("word", F.explode(F.array(size, size - 1)).alias("m")).filter("m >= 1")
    half = F.floor(F.col("m") / 2).cast("int")
    zero = F.lit(0)
    sides = F.when(half == 0, F.array(F.struct(zero.alias("p"), zero.alias("q")))).otherwise(
        F.array(F.struct(half.alias("p"), zero.alias("q")), F.struct(zero.alias("p"), half.alias("q"))))
    waiting = lengths.select("word", "m", F.inline(sides)).select("*", *_group(F.col("p"), F.col("q"), F.col("word")))
    key = ["p", "q", "head", "tail"]
    done: list[DataFrame] = []
    while True:
        # a row whose free part has one letter cannot be split; such a group has few words for each letter there is
        rest = F.col("m") - F.col("p") - F.col("q")
        sizes = waiting.groupBy(*key).agg(F.sum(F.length("word") + 1).alias("letters"))
        large = settle(sizes.filter(F.col("letters") > group_letters).select(*key))
        if large.isEmpty():
            done.append(waiting)
            break
        done.append(lookup_join(waiting, large, key, "left_anti"))
        many = settle(lookup_join(waiting, large, key).select("word", "m", "p", "q", "head", "tail"))
        done.append(many.filter(rest < 2))
        step = F.floor(rest / 2).cast("int")
        two = F.array(F.struct((F.col("p") + step).alias("p"), F.col("q").alias("q")), F.struct(F.col("p").alias("p"), (F.col("q") + step).alias("q")))
        waiting = many.filter(rest >= 2).select("word", "m", F.inline(two)).select("*", *_group(F.col("p"), F.col("q"), F.col("word")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class FmIndex:
    """Suffix ranks of words, delimited and laid out backwards, so that a step extends a match to the right.

    ``letters`` are codes from 1, ``first`` the bounds of the words in it. Intervals are [low, high) of suffix ranks.
    """

    def __init__(self, letters: np.ndarray, first: np.ndarray):
        lengths = np.diff(first)
        n = len(letters) + len(lengths)
        ends = first[1:] + np.arange(len(lengths))  # place of each word's delimiter
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        at = np.repeat(first[:-1] + first[1:] - 1, lengths) - np.arange(len(letters))
        text[inside] = letters[at]
        self.n, self.word_at = n, np.full(n, -1, np.int64)
        self.word_at[ends - lengths] = np.arange(len(lengths))
        self.order = self._suffixes(text, ends, lengths)
        self.last = text[self.order - 1]  # the letter before each suffix
        self.keys = np.sort(self.last * n + np.arange(n))
        self.starts = np.searchsorted(self.keys, np.arange(int(text.max(initial=0)) + 2) * n)

    @staticmethod
    def _suffixes(text: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        # doubling; a suffix ends with its word, equal ones keep the order of their places
        n = len(text)
        until = np.repeat(ends, lengths + 1) - np.arange(n)
        rank, width = text, 1
        while True:
            behind = np.zeros(n, np.int64)
            more = until >= width
            behind[more] = rank[np.flatnonzero(more) + width] + 1
            both = rank * (int(rank.max(initial=0)) + 2) + behind
            order = np.argsort(both, kind="stable")
            new = np.ones(n, bool)
            new[1:] = both[order][1:] != both[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            width *= 2
            if width > int(lengths.max(initial=0)):
                return order

    def beginnings(self) -> tuple[int, int]:
        """The interval of all word beginnings."""
        return 0, int(np.count_nonzero(self.word_at >= 0))

    def extend(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, letter * self.n + low), np.searchsorted(self.keys, letter * self.n + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) in order: which letters come next. Intervals of one depth do not overlap."""
        rows = tb.ragged(low, high - low)
        pairs = np.unique(np.repeat(np.arange(len(low)), high - low) * (1 << 21) + self.last[rows])
        pairs = pairs[pairs % (1 << 21) > 0]
        return pairs >> 21, pairs % (1 << 21)

    def whole_words(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word that is a match as a whole, -1 if none."""
        at = np.searchsorted(self.keys[: self.starts[1]], low)
        found = at < self.starts[1]
        row = self.keys[np.where(found, at, 0)] if self.starts[1] else np.zeros(len(low), np.int64)
        found &= row < high
        return np.where(found, self.word_at[self.order[np.where(found, row, 0)]], -1)


def one_edit(letters: np.ndarray, first: np.ndarray, query: np.ndarray, exact: np.ndarray, replace: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, other) of different words: ``other`` is the word with a letter replaced by a higher one
    (where ``replace``), or with a letter less (where ``drop``), behind the first ``exact`` letters.

    ``query`` names words by number; all words are searched for in the index of all.
    """
    index = FmIndex(letters, first)
    length = np.diff(first)[query]
    start = first[:-1][query]
    low, high = (np.full(len(query), x, np.int64) for x in index.beginnings())
    live = np.flatnonzero(length > 0)  # queries matched exactly so far
    # branches with one edit made: query, interval; all have the same number of letters behind them
    who, b_low, b_high = (np.zeros(0, np.int64) for _ in range(3))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while len(live) or len(who):
        at_end = length[who] == depth
        hit = index.whole_words(b_low[at_end], b_high[at_end])
        pairs.append((query[who[at_end]][hit >= 0], hit[hit >= 0]))
        who, b_low, b_high = who[~at_end], b_low[~at_end], b_high[~at_end]
        b_low, b_high = index.extend(b_low, b_high, letters[start[who] + depth])
        some = b_low < b_high
        who, b_low, b_high = who[some], b_low[some], b_high[some]
        live = live[length[live] > depth]
        if len(live):
            here = letters[start[live] + depth]
            edits = exact[live] <= depth
            # of a run of equal letters the last is left out
            after = letters[np.minimum(start[live] + depth + 1, len(letters) - 1)]
            gone = edits & drop[live] & ((length[live] == depth + 1) | (after != here))
            subs = np.flatnonzero(edits & replace[live])
            spot, place = np.unique(low[live[subs]], return_inverse=True)
            top = np.zeros(len(spot), np.int64)
            top[place] = high[live[subs]]
            owner, letter = index.children(spot, top)
            c_low, c_high = index.extend(spot[owner], top[owner], letter)
            codes = owner * (1 << 21) + letter
            begin = np.searchsorted(codes, place * (1 << 21) + here[subs], side="right")
            many = np.searchsorted(codes, (place + 1) * (1 << 21)) - begin
            child = tb.ragged(begin, many)
            low[live], high[live], old = *index.extend(low[live], high[live], here), (low[live][gone], high[live][gone])
            who = np.concatenate([who, live[gone], np.repeat(live[subs], many)])
            b_low, b_high = np.concatenate([b_low, old[0], c_low[child]]), np.concatenate([b_high, old[1], c_high[child]])
        depth += 1
    word, other = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    return word, other


def _reverse(letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    at = np.repeat(first[:-1] + first[1:] - 1, np.diff(first)) - np.arange(len(letters))
    return letters[at]


def _search(table: pa.Table) -> pa.Table:
    """(word, near), both ways, of the groups of one task."""
    try:
        coded = table["word"].combine_chunks().dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        number = coded.indices.to_numpy().astype(np.int64)
        points = np.frombuffer("".join(vocabulary).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        letters = np.unique(points, return_inverse=True)[1].astype(np.int64) + 1
        first = np.concatenate([[0], np.cumsum(lengths)])
        m, p, q = (table[c].to_numpy().astype(np.int64) for c in ("m", "p", "q"))
        shorter = lengths[number] == m
        found = []
        for forwards in (True, False):
            mine = np.flatnonzero((p >= q) == forwards)
            if not len(mine):
                continue
            # only the words of this direction are indexed
            used, query = np.unique(number[mine], return_inverse=True)
            own = letters[tb.ragged(first[:-1][used], lengths[used])]
            bounds = np.concatenate([[0], np.cumsum(lengths[used])])
            text = own if forwards else _reverse(own, bounds)
            a, b = one_edit(text, bounds, query, np.maximum(p, q)[mine], shorter[mine], ~shorter[mine])
            found.append(np.stack([used[a], used[b]]))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        names = pa.array(vocabulary, pa.string())
        a, b = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        return pa.Table.from_arrays([names.take(a), names.take(b)], names=["word", "near"])
    finally:
        tb.trim()


def near_words(words: DataFrame, task_letters: int = TASK_LETTERS, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """Pairs (word, near) of distinct ``words`` (word) that differ by one inserted, deleted or replaced letter, both ways."""
    members = settle(_members(words.select("word"), group_letters))
    letters = members.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    tasks = max(1, -(-letters // task_letters))
    task = F.pmod(F.xxhash64("p", "q", "head", "tail"), F.lit(tasks)).alias("task")
    found = members.select("word", "m", "p", "q", task).groupBy("task").applyInArrow(_search, "word string, near string")
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form (word, form): chains are followed by doubling."""
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = settle(lookup_join(state, further, "root", "left"))
        if step.filter("_next is not null").isEmpty():
            return state
        state = step.select("word", F.coalesce("_next", "root").alias("root"))


def variant_groups(words: DataFrame, task_letters: int = TASK_LETTERS, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words`` (word, n), which names each once.

    ``form`` is the near word of largest n, of equal ones the first in code-point order, if it has at least
    twice the word's n; ``root`` is where forms lead, the word itself if it has none. A form is at least
    twice as frequent, so chains end. No words, no rows; null words are left out.
    """
    words = settle(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")))
    pairs = lookup_join(near_words(words, task_letters, group_letters), words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    strong = F.col("best.near_n") >= 2 * F.col("n")
    rows = settle(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("best.near_n")).alias("form_n"),
    ))
    roots = _roots(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``variant_groups`` of the words of ``docs`` (doc_id, text).

    A null text has no words; a null doc_id counts as an empty one in the checksum. Repeated rows count as
    often as they come. Other columns are ignored; an empty table gives no rows.
    """
    return variant_groups(count_words(docs, min_length, min_count))
