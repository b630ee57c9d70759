"""Progress reports: at-least-once messages merged into one record per question.

A message becomes long rows (id, section, key, value, order). Merging is first, max and
longest per (id, section, key): it may be applied to messages, to partial merges, or to both,
in any order and with repeats, and gives the same record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.operators.joins import lookup_join

CANDIDATES = "array<struct<answer:string,ranking:double>>"

# Message kinds by their place in a question's life.
KINDS = ("create", "node", "step", "finish")

_VALUE = "struct<s:string,l:bigint,d:double,b:boolean,c:array<struct<answer:string,ranking:double>>>"


def clean_candidates(candidates: Column, n: int = fixed.REPORT_CANDIDATES) -> Column:
    """NaN and infinite rankings become 0; best first; at most ``n``."""
    finite = F.transform(
        candidates,
        lambda c: F.struct(
            F.when(
                F.isnan(c["ranking"]) | (F.abs(c["ranking"]) >= float(1.7976931348623157e308)), 0.0
            )
            .otherwise(F.coalesce(c["ranking"], F.lit(0.0)))
            .alias("ranking"),
            F.coalesce(c["answer"], F.lit("")).alias("answer"),
        ),
    )
    ordered = F.transform(
        finite, lambda c, i: F.struct((-c["ranking"]).alias("k"), i.alias("i"), c.alias("c"))
    )
    best = F.slice(F.array_sort(ordered), 1, n)
    return F.transform(
        best, lambda x: F.struct(x["c"]["answer"].alias("answer"), x["c"]["ranking"].alias("ranking"))
    )


def _value(**parts: Column) -> Column:
    kinds = {"s": "string", "l": "bigint", "d": "double", "b": "boolean", "c": CANDIDATES}
    return F.struct(
        *[parts.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]
    )


def _entry(section: str, key: Column | str, value: Column, present: Column | None = None) -> Column:
    name = F.lit(key) if isinstance(key, str) else key
    row = F.struct(F.lit(section).alias("section"), name.alias("key"), value.alias("value"))
    return row if present is None else F.when(present, row)


def _scalar(name: str, **value: Column) -> Column:
    (column,) = value.values()
    return _entry("scalar", name, _value(**value), column.isNotNull())


def _detail(parsed: Column, name: str, kinds: tuple[str, ...]) -> Column:
    field = F.try_variant_get(parsed, f"$.{name}", "variant")
    kind = F.schema_of_variant(field)
    matches = F.lit(False)
    for k in kinds:
        matches = matches | kind.startswith(k)
    return F.when(matches, F.try_variant_get(parsed, f"$.{name}", "string"))


def report_create(parsed: Column) -> list[Column]:
    """Entries of a create message: question, sender, creation time and details.

    ``parsed`` is the message's JSON as variant; null, for invalid JSON, gives no details.
    """
    valid = parsed.isNotNull()
    text = {n: F.coalesce(_detail(parsed, n, ("STRING",)), F.lit("")) for n in ("corpus", "details")}
    number = {
        n: F.coalesce(
            _detail(parsed, n, ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")).try_cast("double").cast("bigint"),
            F.lit(0),
        )
        for n in ("id", "time")
    }
    return [
        _scalar("question", s=F.col("question")),
        _scalar("sender", s=F.col("sender")),
        _entry("time", "create", _value(l=F.col("time"))),
        *[_entry("scalar", f"details.{n}", _value(s=c), valid) for n, c in text.items()],
        *[_entry("scalar", f"details.{n}", _value(l=c), valid) for n, c in number.items()],
    ]


def report_node() -> list[Column]:
    """Entries of a node message: worker node and when it took the question."""
    return [_scalar("node", s=F.col("node")), _entry("time", "node", _value(l=F.col("time")))]


def report_step() -> list[Column]:
    """Entries of a step message: the step's JSON and time."""
    return [
        _entry("step", F.col("step"), _value(s=F.col("json")), F.col("step").isNotNull()),
        _entry("time", F.col("step"), _value(l=F.col("time")), F.col("step").isNotNull()),
    ]


def report_finish() -> list[Column]:
    """Entries of a finish message: answer, ranking, success, candidates and time."""
    return [
        _scalar("answer", s=F.col("answer")),
        _scalar("ranking", d=F.col("ranking")),
        _scalar("finished", b=F.col("success")),
        _scalar("candidates", c=F.col("candidates")),
        _entry("time", "finish", _value(l=F.col("time"))),
    ]


def report_entries(reports: DataFrame) -> DataFrame:
    """Messages as long rows, ready to merge. Messages of other kinds are passed over."""
    kind = F.col("kind")
    by_kind = {
        "create": report_create(F.col("_parsed")),
        "node": report_node(),
        "step": report_step(),
        "finish": report_finish(),
    }
    empty = F.array().cast(f"array<struct<section:string,key:string,value:{_VALUE}>>")
    entries = empty
    rank = F.lit(len(KINDS))
    for place, name in enumerate(KINDS):
        entries = F.when(kind == name, F.array(*by_kind[name])).otherwise(entries)
        rank = F.when(kind == name, place).otherwise(rank)
    order = F.struct(F.col("time").alias("time"), rank.alias("rank"), F.col("seq").alias("seq"))
    reports = reports.withColumn("_parsed", F.when(kind == "create", F.try_parse_json("json")))
    rows = reports.select("id", order.alias("ord"), F.explode(entries).alias("_e"))
    longest = F.struct(
        F.length("_e.value.s").alias("length"),
        (-F.col("ord.time")).alias("time"),
        (-F.col("ord.rank")).alias("rank"),
        (-F.col("ord.seq")).alias("seq"),
    )
    return rows.filter(F.col("_e").isNotNull()).select(
        "id",
        "_e.section",
        "_e.key",
        F.col("_e.value").alias("first"),
        F.col("ord").alias("first_ord"),
        F.col("_e.value.l").alias("latest"),
        F.col("_e.value.s").alias("longest"),
        longest.alias("longest_ord"),
    )


def merge_entries(entries: DataFrame) -> DataFrame:
    """One row per (id, section, key): first value, latest time, longest text.

    Rows merge inside the tasks before the shuffle, so a question that reports without end
    still sends one row per key and task.
    """
    return entries.groupBy("id", "section", "key").agg(
        F.min_by("first", "first_ord").alias("first"),
        F.min("first_ord").alias("first_ord"),
        F.max("latest").alias("latest"),
        F.max_by("longest", "longest_ord").alias("longest"),
        F.max("longest_ord").alias("longest_ord"),
    )


def process_records(merged: DataFrame) -> DataFrame:
    """Merged rows as one record per question."""
    def scalar(name: str, part: str) -> Column:
        here = (F.col("section") == "scalar") & (F.col("key") == name)
        return F.max(F.when(here, F.col(f"first.{part}")))

    def entries(section: str, value: str) -> Column:
        here = F.col("section") == section
        return F.map_from_entries(
            F.array_sort(F.collect_list(F.when(here, F.struct("key", F.col(value)))))
        )

    here = (F.col("section") == "scalar") & (F.col("key") == "candidates")
    candidates = F.max(F.when(here, F.col("first.c")))
    details = F.struct(
        scalar("details.corpus", "s").alias("corpus"),
        scalar("details.id", "l").alias("id"),
        scalar("details.time", "l").alias("time"),
        scalar("details.details", "s").alias("details"),
    )
    return merged.groupBy("id").agg(
        scalar("question", "s").alias("question"),
        scalar("sender", "s").alias("sender"),
        scalar("node", "s").alias("node"),
        details.alias("details"),
        entries("time", "latest").alias("times"),
        entries("step", "longest").alias("steps"),
        scalar("answer", "s").alias("answer"),
        scalar("ranking", "d").alias("ranking"),
        scalar("finished", "b").alias("finished"),
        clean_candidates(candidates).alias("candidates"),
    )


def merge_process(reports: DataFrame) -> DataFrame:
    """Report messages -> one merged record per question."""
    return process_records(merge_entries(report_entries(reports)))


def exists(ids: DataFrame, reports: DataFrame) -> DataFrame:
    """Each given id and whether any report has it."""
    known = reports.select("id").distinct().withColumn("_known", F.lit(True))
    found = ids.select("id").distinct().join(known, "id", "left")
    return found.select("id", F.col("_known").isNotNull().alias("exists"))


def create_if_absent(ids: DataFrame, reports: DataFrame) -> DataFrame:
    """The ids that need a new record."""
    return ids.select("id").distinct().join(reports.select("id").distinct(), "id", "left_anti")


def get(reports: DataFrame, ids: DataFrame) -> DataFrame:
    """Merged records of the given ids; others are not merged."""
    return merge_process(lookup_join(reports, ids.select("id").distinct(), "id", "left_semi"))


def newest(reports: DataFrame, n: int) -> DataFrame:
    """Merged records of the ``n`` highest ids."""
    ids = reports.select("id").distinct().orderBy(F.col("id").desc()).limit(n)
    return get(reports, ids)


def latest(reports: DataFrame) -> DataFrame:
    """Merged record of the highest id."""
    return newest(reports, 1)


def count_docs(reports: DataFrame) -> DataFrame:
    """Raw messages, repeats included."""
    return reports.agg(F.count(F.lit(1)).alias("docs"))
