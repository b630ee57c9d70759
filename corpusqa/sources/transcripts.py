"""Lecture transcripts and corpus documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.functions import text as tx

# Metadata items of a transcript file.
META_ITEMS = ("speechevent", "module", "partlevel", "acaddept", "acaddiv")


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def parse_transcript_xml(files: DataFrame, name: str = "name", xml: str = "xml") -> DataFrame:
    """(name, speechevent, module, partlevel, acaddept, acaddiv, text) of whole XML files.

    The text is that of all ``u`` elements inside ``text``, without tags and breaks.
    A file without all metadata items is dropped.
    """
    meta = [
        F.get(F.xpath(F.col(xml), F.lit(f"//keywords//list//item[@n='{item}']//text()")), F.lit(0)).alias(item)
        for item in META_ITEMS
    ]
    body = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<u(?:\s[^>]*)?>.*?</u>"), F.lit(0))
    flat = F.array_join(F.transform(body, lambda u: F.regexp_replace(u, r"<.+?>\s*", "")), "")
    parsed = files.select(name, *meta, tx.collapse_breaks(flat).alias("text"))
    return parsed.dropna(subset=list(META_ITEMS))


def read_transcript_xml(spark: SparkSession, path: str) -> DataFrame:
    """One XML file per lecture."""
    files = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("xml")
    )
    return parse_transcript_xml(files)


def parse_transcript_rows(rows: DataFrame) -> DataFrame:
    """(id, title, department, text) of rows (id, title, transkription); incomplete rows drop."""
    whole = rows.filter(
        F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("transkription").isNotNull()
    )
    xml = F.trim(tx.flatten_breaks(F.col("transkription")))
    bodies = F.regexp_extract_all(xml, F.lit(r"(?s)<text(?:\s[^>]*)?>.*?</text>"), F.lit(0))
    flat = F.array_join(F.transform(bodies, lambda t: F.regexp_replace(t, r"<.+?>\s*", " ")), "")
    department = F.regexp_extract(xml, r"(?s)<projectname(?:\s[^>]*)?>(.*?)</projectname>", 1)
    return whole.select(
        F.col("id").cast("bigint").alias("id"),
        "title",
        _unescape(department).alias("department"),
        tx.collapse_breaks(flat).alias("text"),
    )


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of (id, title, transkription) objects whose last field holds XML."""
    rows = spark.read.schema("id bigint, title string, transkription string").json(path, multiLine=True)
    return parse_transcript_rows(rows)


def project_corpus_doc(docs: DataFrame, json: str = "json", keys: tuple[str, ...] = ()) -> DataFrame:
    """(text, lecture, topic) of JSON documents; a missing field is an empty string."""
    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(""))

    return docs.select(
        *keys,
        field("text").alias("text"),
        field("acaddept").alias("lecture"),
        field("module").alias("topic"),
    )
