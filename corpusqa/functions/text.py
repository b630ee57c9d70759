"""Text expressions: Column in, Column out. All native, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusqa.functions import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Elements summed at once by ``prefix_sums``.
_SUM_BLOCK = 32


def _last_sums(values: Column) -> Column:
    return F.aggregate(
        values,
        F.array().cast("array<bigint>"),
        lambda acc, x: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
        ),
    )


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an integer array, block by block to stay near-linear."""
    def blocks(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / F.lit(_SUM_BLOCK)).cast("int") - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda b: _last_sums(F.slice(v, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK))),
        )

    def shifted(parts: Column) -> Column:
        totals = _last_sums(
            F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)))
        )
        return let(
            totals,
            lambda t: F.flatten(
                F.transform(
                    parts,
                    lambda p, i: F.transform(
                        p, lambda x: x + F.when(i > 0, F.get(t, i - 1)).otherwise(F.lit(0))
                    ),
                )
            ),
        )

    return let(values, lambda v: let(blocks(v), shifted))


# Places gathered at once by ``cut_points``.
_CUT_BLOCK = 256


def cut_points(sizes: Column, rule: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Places (from 0) at which ``rule(size so far, next size)`` says cut; it returns (cut, size from now on).

    The fold carries numbers, and the places in blocks, so that its cost grows with the elements only.
    """
    none = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).cast("long").alias("size"), F.lit(0).alias("at"), none.alias("block"), F.array().cast("array<array<int>>").alias("blocks")
    )

    def step(s: Column, x: Column) -> Column:
        cut, size = rule(s["size"], x)
        full = F.size(s["block"]) >= _CUT_BLOCK
        block = F.concat(F.when(full, none).otherwise(s["block"]), F.array(s["at"]))
        return F.struct(
            size.cast("long").alias("size"),
            (s["at"] + 1).alias("at"),
            F.when(cut, block).otherwise(s["block"]).alias("block"),
            F.when(cut & full, F.concat(s["blocks"], F.array(s["block"]))).otherwise(s["blocks"]).alias("blocks"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.flatten(F.concat(s["blocks"], F.array(s["block"]))))


def with_offsets(pieces: Column) -> Column:
    """(piece, start) for consecutive pieces of a text."""
    return let(
        pieces,
        lambda p: let(
            prefix_sums(F.transform(p, F.length)),
            lambda ends: F.transform(
                p,
                lambda x, i: F.struct(
                    x.alias("piece"), (F.get(ends, i) - F.length(x)).alias("start")
                ),
            ),
        ),
    )


def located_tokens(text: Column) -> Column:
    """Tokens with their char offsets: array of (piece, start)."""
    pieces = F.regexp_extract_all(text, F.lit(fixed.TOKEN_PATTERN + r"|\s+"), F.lit(0))
    return F.filter(with_offsets(pieces), lambda p: ~p["piece"].rlike(r"^\s"))


def located_sentences(text: Column) -> Column:
    """Sentences with their char offsets: array of (piece, start)."""
    pieces = F.regexp_extract_all(text, F.lit(fixed.SENTENCE_PATTERN + r"|[.!?\n]"), F.lit(0))
    return F.filter(with_offsets(pieces), lambda p: ~p["piece"].rlike(r"^[.!?\n]"))


def tokens(text: Column) -> Column:
    """Ordered tokens; punctuation is a token of its own; case is kept."""
    return F.regexp_extract_all(text, F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def sentences(text: Column) -> Column:
    """Ordered sentences with their closing marks."""
    return F.regexp_extract_all(text, F.lit(fixed.SENTENCE_PATTERN), F.lit(0))


def sentence_tokens(text: Column) -> Column:
    """One token array per sentence."""
    return F.transform(sentences(text), tokens)


def words(text: Column) -> Column:
    """The tokens of all sentences of a text."""
    return F.flatten(sentence_tokens(text))


def bag_of_words(text: Column) -> Column:
    """Distinct tokens of a text, in order of first use."""
    return F.array_distinct(words(text))


def without(tokens_: Column, dropped: Iterable[str]) -> Column:
    """Tokens not in ``dropped``, duplicates kept. The match is exact, as is its case."""
    dropped = list(dropped)
    if not dropped:
        return tokens_
    return F.filter(tokens_, lambda t: ~t.isin(dropped))


def without_stopwords(tokens_: Column, stopwords: Iterable[str] = fixed.STOPWORDS) -> Column:
    return without(tokens_, stopwords)


def without_punctuation(tokens_: Column) -> Column:
    """Tokens that do not consist of ``# ? . , & ! *`` alone."""
    return F.filter(tokens_, lambda t: ~t.rlike(fixed.PUNCTUATION_TOKEN))


def terms(text: Column) -> Column:
    """Search terms of a text: lower-cased tokens with at least one letter or digit."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD_PATTERN), F.lit(0))


def term_frequencies(terms_: Column) -> Column:
    """(term, tf) of the distinct terms, in term order."""
    def runs(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(
            F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(s, i - 1) != F.get(s, i))
        )
        return let(
            ends,
            lambda e: F.transform(
                e,
                lambda end, k: F.struct(
                    F.get(s, end - 1).alias("term"),
                    (end - F.when(k > 0, F.get(e, k - 1)).otherwise(0)).cast("bigint").alias("tf"),
                ),
            ),
        )

    return F.when(F.size(terms_) > 0, let(F.array_sort(terms_), runs))


def collapse_breaks(text: Column) -> Column:
    """Each line break, with the blanks around it, becomes one blank."""
    return F.regexp_replace(text, r"[ ]*(\r)?\n[ ]*", " ")


def flatten_breaks(text: Column) -> Column:
    """Line breaks and tabs as blanks, ``\\'`` removed."""
    plain = F.replace(collapse_breaks(text), F.lit("\\'"), F.lit(""))
    return F.replace(plain, F.lit("\t"), F.lit(" "))


def flatten_markup(text: Column, tag_becomes: str = "") -> Column:
    """Plain text of marked-up text: no tags, no breaks, no tabs, single blanks, no ``\\'``."""
    plain = F.regexp_replace(text, r"<.+?>\s*", tag_becomes)
    return F.regexp_replace(flatten_breaks(plain), r"[ ]+", " ")


def strip_token_punctuation(text: Column) -> Column:
    """Blank-separated words without the ASCII punctuation around them; empty ones dropped."""
    parts = F.split(text, r"[ \t\n\r\f]+")
    bare = F.transform(
        parts,
        lambda w: F.regexp_replace(w, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", ""),
    )
    return F.filter(bare, lambda w: w != "")


def adjacent_pairs(tokens_: Column, stop_on_repeat: bool = True) -> Column:
    """Neighbouring words as (first, second) structs, the smaller word first.

    By default the pairs of a sentence end where a word is followed by itself;
    otherwise just that pair is left out.
    """
    return let(tokens_, lambda t: let(_neighbours(t), lambda p: _cut(p, stop_on_repeat)))


def _neighbours(tokens_: Column) -> Column:
    return F.transform(
        F.slice(tokens_, F.lit(2), F.greatest(F.size(tokens_) - 1, F.lit(0))),
        lambda right, i: F.struct(
            F.least(F.get(tokens_, i), right).alias("first"),
            F.greatest(F.get(tokens_, i), right).alias("second"),
        ),
    )


def _cut(pairs: Column, stop_on_repeat: bool) -> Column:
    if not stop_on_repeat:
        return F.filter(pairs, lambda p: p["first"] != p["second"])
    return let(
        F.array_position(F.transform(pairs, lambda p: p["first"] == p["second"]), F.lit(True)),
        lambda repeat: F.when(
            repeat > 0, F.slice(pairs, F.lit(1), repeat.cast("int") - 1)
        ).otherwise(pairs),
    )


def terminate_question(question: Column) -> Column:
    """Append ``?`` unless the question already ends in ``.``, ``?`` or ``!``."""
    closed = question.endswith(".") | question.endswith("?") | question.endswith("!")
    return F.when(closed, question).otherwise(F.concat(question, F.lit("?")))


def wh_types(question: Column) -> Column:
    """Names of the question forms found anywhere in the question, in fixed order."""
    flags = [F.when(question.rlike(pattern), F.lit(name)) for name, pattern in fixed.WH_FORMS]
    return F.filter(F.array(*flags), lambda t: t.isNotNull())


def sample_passage(text: Column, offset: Column | int = 0) -> Column:
    """From a char offset, the text from the first ``#`` through the fifth; else null."""
    start = offset if isinstance(offset, Column) else F.lit(offset)
    rest = F.substr(text, start + F.lit(1))
    found = F.regexp_extract(rest, r"#[^\n]*?(?:#[^\n]*?){3}#", 0)
    return F.when(found != "", found)


def links(html: Column) -> Column:
    """Relative link targets of a page, in order."""
    return F.regexp_extract_all(html, F.lit(fixed.LINK_PATTERN), F.lit(1))


def token_tag(token: Column) -> Column:
    """Closed-class tag of a token: WP, WRB, SW (stopword), PUNCT, or NP for all else."""
    low = F.lower(token)
    return (
        F.when(low.isin(list(fixed.WP_WORDS)), "WP")
        .when(low.isin(list(fixed.WRB_WORDS)), "WRB")
        .when(low.isin(fixed.STOPWORDS), "SW")
        .when(~token.rlike(r"[\p{L}\p{N}]"), "PUNCT")
        .otherwise("NP")
    )


def question_type(tokens_: Column) -> Column:
    """Question type by the first question word, else ``other``."""
    first = F.get(F.filter(tokens_, lambda t: token_tag(t).isin("WP", "WRB")), F.lit(0))
    word = F.lower(first)
    return F.when(word.isin(list(fixed.QUESTION_TYPES)), word).otherwise("other")


def answer_type(label: Column) -> Column:
    """Answer type of an entity label; no or an unmapped label is ``unknown``."""
    out = F.lit("unknown")
    for name, kind in fixed.ANSWER_TYPES.items():
        out = F.when(label == name, kind).otherwise(out)
    return out


def _phrase_breaks(tokens_: Column) -> Column:
    # one entry per token; tokens that are no NP become null
    return F.transform(tokens_, lambda t: F.when(token_tag(t) == "NP", t))


def focus(tokens_: Column) -> Column:
    """Noun phrases of a question: maximal runs of NP-tagged tokens, blank-joined.

    Words that are no NP become a line break, which no token can contain.
    """
    joined = F.array_join(_phrase_breaks(tokens_), " ", "\n")
    runs = F.transform(F.split(joined, "\n"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: r != "")


def digest_below(key: Column, probability: float) -> Column:
    """True for about ``probability`` of all keys; the same keys on every run."""
    if probability >= 1.0:
        return F.lit(True)
    bound = f"{int(probability * 2**32):08x}"
    return F.substring(F.md5(key), 1, 8) < bound


def spell_wiki(text: Column) -> Column:
    """Plain lower-case words of wiki markup: letters a-z and single blanks only."""
    out = text
    for pattern, replacement in fixed.WIKI_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.translate(F.concat(F.lit(" "), out, F.lit(" ")), fixed.UPPER, fixed.LOWER)
    for letter, spelled in fixed.SPELLED:
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return F.regexp_replace(out, r"[^a-z]+", " ")
