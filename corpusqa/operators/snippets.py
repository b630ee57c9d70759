"""Cutting texts: snippets, chunks, word blocks, lines, samples. Narrow work, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.functions import text as tx


def _joined(words: Column, start: Column, count: Column | int) -> Column:
    n = count if isinstance(count, Column) else F.lit(count)
    return F.array_join(F.slice(words, start, n), " ")


def _snippets(words: Column, size: int, step: int) -> Column:
    n = F.size(words)
    # one word more may stay in the last snippet if that word has at most one char
    room = F.when(F.length(F.get(words, n - 1)) <= 1, size + 1).otherwise(size)
    last = F.greatest(F.ceil((n - room) / F.lit(step)).cast("int"), F.lit(0))
    step_chars = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.length(_joined(words, k * step + 1, step)) + 1,
    )
    offsets = F.concat(F.array(F.lit(0).cast("bigint")), tx.prefix_sums(step_chars))
    return tx.let(
        offsets,
        lambda off: F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(
                F.get(off, k).cast("int").alias("offset"),
                F.when(k < last, F.concat(_joined(words, k * step + 1, size), F.lit(" ")))
                .otherwise(_joined(words, k * step + 1, n))
                .alias("text"),
            ),
        ),
    )


def split_snippets(
    docs: DataFrame,
    text: str = "text",
    size: int = fixed.SNIPPET_WORDS,
    step: int = fixed.SNIPPET_STEP,
) -> DataFrame:
    """Overlapping windows of ``size`` blank-separated words, one every ``step`` words.

    ``offset`` is the char offset in the document. The last window takes the rest.
    All other columns are kept; ``text`` becomes the snippet's text.
    """
    cut = tx.let(F.split(F.col(text), " "), lambda w: _snippets(w, size, step))
    rest = [c for c in docs.columns if c not in (text, "offset")]
    return docs.select(*rest, F.inline(cut))


def chunk_by_chars(
    docs: DataFrame, text: str = "text", max_chars: int = fixed.CHUNK_CHARS
) -> DataFrame:
    """Greedy packing of words into chunks of about ``max_chars`` with a running offset.

    Each word is preceded by a blank, the first of a later chunk is not.
    """
    words = F.transform(
        F.split(F.col(text), " "),
        lambda w: F.regexp_replace(w, r"^[\x00-\x20]+|[\x00-\x20]+$", ""),
    )
    def rule(size: Column, word: Column) -> tuple[Column, Column]:
        full = word + size > max_chars
        return full, F.when(full, word).otherwise(size + 1 + word)

    def chunks(words: Column, firsts: Column) -> Column:
        # a chunk runs from its first word to before the next one's; the words before the first cut are one, too
        bounds = F.concat(F.array(F.lit(0)), firsts, F.array(F.size(words)))
        blank = lambda b, k: F.when((k == 0) & (F.get(b, F.lit(1)) > 0), " ").otherwise("")
        parts = tx.let(bounds, lambda b: F.transform(
            F.sequence(F.lit(0), F.size(b) - 2),
            lambda k: F.concat(blank(b, k), _joined(words, F.get(b, k) + 1, F.get(b, k + 1) - F.get(b, k))),
        ))
        # an empty last chunk is none
        whole = tx.let(parts, lambda p: F.slice(p, 1, F.size(p) - F.when(F.element_at(p, -1) == "", 1).otherwise(0)))

        def placed(texts: Column) -> Column:
            ends = tx.prefix_sums(F.transform(texts, lambda t: F.length(t) + 1))
            return tx.let(ends, lambda e: F.transform(
                texts, lambda t, k: F.struct((F.get(e, k) - F.length(t) - 1).cast("int").alias("offset"), t.alias("chunk"))))

        return tx.let(whole, placed)

    rest = [c for c in docs.columns if c not in (text, "offset", "chunk")]
    cut = tx.let(words, lambda w: tx.let(tx.cut_points(F.transform(w, F.length), rule), lambda f: chunks(w, f)))
    return docs.select(*rest, F.inline(cut))


def word_blocks(docs: DataFrame, text: str = "text", size: int = 100) -> DataFrame:
    """Fixed blocks of ``size`` words without the punctuation around them, labelled per document."""
    def blocks(words: Column) -> Column:
        n = F.ceil(F.size(words) / F.lit(size)).cast("int")
        cut = F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda k: F.struct(
                k.alias("block"),
                F.concat(F.lit("SENT_"), k.cast("string")).alias("label"),
                F.slice(words, (k - 1) * size + 1, F.lit(size)).alias("words"),
            ),
        )
        return F.filter(cut, lambda b: F.size(b["words"]) > 0)

    rest = [c for c in docs.columns if c != text]
    cut = tx.let(tx.strip_token_punctuation(F.col(text)), blocks)
    return docs.select(*rest, F.inline(cut))


def word_lines(docs: DataFrame, text: str = "text", size: int = 101) -> DataFrame:
    """Lines of ``size`` blank-separated words of an already cleaned text."""
    def lines(words: Column) -> Column:
        n = F.ceil(F.size(words) / F.lit(size)).cast("int")
        return F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda k: F.struct(k.alias("line_no"), _joined(words, (k - 1) * size + 1, size).alias("line")),
        )

    words = F.filter(F.split(F.col(text), " "), lambda w: w != "")
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.inline(tx.let(words, lines))).filter(F.col("line") != "")


def pack_by_spaces(docs: DataFrame, text: str = "text", max_spaces: int = 100) -> DataFrame:
    """Records (lines) of a document strung together, with a break once they hold more than
    ``max_spaces`` blanks. Counting starts anew after a break and with each document."""
    def rule(spaces: Column, more: Column) -> tuple[Column, Column]:
        full = spaces + more > max_spaces
        return full, F.when(full, 0).otherwise(spaces + more)

    def lines(records: Column, ends: Column) -> Column:
        whole = F.transform(ends, lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1).alias("start"), e.alias("end")))
        past = F.coalesce(F.try_element_at(ends, F.lit(-1)) + 1, F.lit(0))
        spans = F.concat(whole, F.array(F.struct(past.alias("start"), (F.size(records) - 1).alias("end"))))
        cut = F.transform(spans, lambda s: F.array_join(F.slice(records, s["start"] + 1, s["end"] - s["start"] + 1), ""))
        return F.filter(cut, lambda line: line != "")

    rest = [c for c in docs.columns if c != text]
    blanks = lambda r: F.length(F.regexp_replace(r, r"[^ ]+", ""))
    packed = tx.let(F.split(F.col(text), "\n"), lambda r: tx.let(tx.cut_points(F.transform(r, blanks), rule), lambda e: lines(r, e)))
    return docs.select(*rest, F.posexplode(packed).alias("line_no", "line"))


def sample_epochs(docs: DataFrame, key: str, epochs: Mapping[int, float], text: str = "text") -> DataFrame:
    """(key, line_no, line, epoch): the lines of several training epochs, read once.

    Epoch 0 has the first half of each document's lines, epoch 1 the second; later ones sample
    a line with the probability given for them, by a digest of epoch and line alone.
    """
    parts = docs.select(key, F.split(F.col(text), "\n").alias("_lines"))
    rows = parts.select(key, F.size("_lines").alias("_n"), F.posexplode("_lines").alias("line_no", "line"))
    first_half = F.col("line_no") * 2 < F.col("_n")
    chosen = []
    for epoch, probability in epochs.items():
        line_key = F.concat_ws("-", F.lit(str(epoch)), F.col(key).cast("string"), "line_no")
        keep = first_half if epoch == 0 else ~first_half if epoch == 1 else tx.digest_below(line_key, probability)
        chosen.append(F.when(keep, F.lit(epoch)))
    return rows.withColumn("epoch", F.explode(F.array_compact(F.array(*chosen)))).select(key, "line_no", "line", "epoch")


def sample_lines(
    docs: DataFrame, key: str, epoch: int, probability: float = 0.5, text: str = "text"
) -> DataFrame:
    """``sample_epochs`` of one epoch."""
    return sample_epochs(docs, key, {epoch: probability}, text).drop("epoch")


def random_document(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """One document, chosen by a seeded score of its key."""
    score = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return docs.orderBy(score, key).limit(1)
