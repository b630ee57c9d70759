"""Wiki dumps and token lines for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import text as tx
from corpusqa.operators.joins import running_total


def article_text(markup: Column) -> Column:
    """What stands between ``<text ...>`` and ``</text>``; null for a redirect or no text."""
    body = F.regexp_extract(markup, r"(?s)<text [^>]*>(.*?)</text>", 1)
    return F.when(~markup.rlike(r"(?i)#redirect") & (body != ""), body)


def clean_wiki_markup(articles: DataFrame, markup: str = "markup") -> DataFrame:
    """Articles with ``text``: plain lower-case words; redirects are dropped."""
    body = articles.withColumn("_body", article_text(F.col(markup))).filter(F.col("_body").isNotNull())
    return body.withColumn("text", tx.spell_wiki(F.col("_body"))).drop(markup, "_body")


def articles_to_lines(articles: DataFrame, keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """One line of blank-joined tokens per article."""
    return articles.select(*keys, F.array_join(tx.tokens(F.col(text)), " ").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def group_concat_tokens(
    reviews: DataFrame, key: str, order_by: Sequence[str], text: str = "text"
) -> DataFrame:
    """Tokens of all texts of a key, strung together in order.

    The texts of one key may be any share of the data, so its token string stays in pieces:
    rows (key, start, tokens), ``start`` being the number of tokens of the key before.
    """
    rows = reviews.select(key, *order_by, tx.tokens(F.col(text)).alias("tokens"))
    sized = rows.withColumn("_n", F.size("tokens").cast("bigint"))
    placed = running_total(sized, "_n", [F.col(c) for c in order_by], [key], "start")
    return placed.select(key, "start", "tokens")
