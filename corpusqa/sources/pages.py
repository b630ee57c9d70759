"""Question-and-answer web pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import text as tx


@dataclass(frozen=True)
class PagePatterns:
    """Where a page holds its parts: one capture group each, of inner markup."""

    # Places on the crawled pages.
    question: str = r'(?s)id="ya-question-detail".*?<h1[^>]*>(.*?)</h1>'
    id: str = r'data-ya-question-id="([^"]*)"'
    categories: str = r'(?s)id="brdCrb".*?</(?:ul|ol|div|nav)>'
    category: str = r"(?s)<a[^>]*>(.*?)</a>"
    detail: str = r'(?s)id="ya-question-detail".*?class="[^"]*ya-q-text[^"]*"[^>]*>(.*?)</span>'
    best: str = r'(?s)id="ya-best-answer".*?class="[^"]*ya-q-full-text[^"]*"[^>]*>(.*?)</span>'
    others: str = r'(?s)id="ya-qn-answers".*?</ul>'
    other: str = r'(?s)class="[^"]*ya-q-full-text[^"]*"[^>]*>(.*?)</span>'


def plain(markup: Column) -> Column:
    """Visible text of a piece of markup: no tags, common entities decoded, single blanks."""
    text = F.regexp_replace(markup, r"<[^>]*>", " ")
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def _first(html: Column, pattern: str) -> Column:
    found = F.regexp_extract(html, pattern, 1)
    return F.when(html.rlike(pattern), plain(found))


def _inside(html: Column, area: str, pattern: str) -> Column:
    part = F.regexp_extract(html, area, 0)
    found = F.transform(F.regexp_extract_all(part, F.lit(pattern), F.lit(1)), plain)
    return F.when(html.rlike(area), found)


def parse_question_page(
    pages: DataFrame, patterns: PagePatterns = PagePatterns(), url: str = "url", html: str = "html"
) -> DataFrame:
    """Pages as question records; a page without a question is dropped, missing parts are null."""
    page = F.col(html)
    return pages.select(
        _first(page, patterns.id).alias("id"),
        url,
        _first(page, patterns.question).alias("question"),
        _first(page, patterns.detail).alias("questiondetail"),
        _inside(page, patterns.categories, patterns.category).alias("category"),
        _first(page, patterns.best).alias("bestanswer"),
        _inside(page, patterns.others, patterns.other).alias("otheranswers"),
    ).filter(F.col("question").isNotNull())


def extract_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, link) of the relative links of a page."""
    return pages.select(key, F.posexplode(tx.links(F.col(html))).alias("pos", "link"))


def new_urls(found: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs that were not seen before."""
    return found.select(url).distinct().join(seen.select(url).distinct(), url, "left_anti")


def decode_question(docs: DataFrame) -> DataFrame:
    """Question records with defaults: empty strings and lists; ``taken`` may be null."""
    text = ("id", "url", "question", "questiondetail", "bestanswer")
    lists = ("category", "otheranswers")
    empty = F.array().cast("array<string>")

    def field(name: str) -> Column:
        kind = "string" if name in text else "boolean" if name == "taken" else "array<string>"
        return F.col(name) if name in docs.columns else F.lit(None).cast(kind)

    return docs.select(
        *[F.coalesce(field(c).cast("string"), F.lit("")).alias(c) for c in text],
        *[F.coalesce(field(c), empty).alias(c) for c in lists],
        field("taken").alias("taken"),
        empty.alias("types"),
    )


def annotate_wh(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions with the names of their question forms appended to ``types``."""
    return questions.withColumn("types", F.concat("types", tx.wh_types(F.col(question))))
