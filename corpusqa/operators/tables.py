"""Table upkeep: counts, flags, deletes, increments, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.functions import fixed
from corpusqa.functions import text as tx
from corpusqa.operators.joins import first_per_key, lookup_join, number_rows, running_total
from corpusqa.session import new_folder, stored


def upsert_counts(counts: DataFrame, new: DataFrame, key_chars: int | None = None) -> DataFrame:
    """(section, key, count) after adding ``new``. With ``key_chars`` keys are cut, and equal cut
    keys add up."""
    key = F.col("key") if key_chars is None else F.substring("key", 1, key_chars)
    cut = [part.select("section", key.alias("key"), "count") for part in (counts, new)]
    return cut[0].unionByName(cut[1]).groupBy("section", "key").agg(F.sum("count").alias("count"))


def overwrite_counts(counts: DataFrame, path: str) -> None:
    """Store a count table, one folder per section; only the sections given are replaced."""
    (
        counts.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("section")
        .parquet(path)
    )


def write_kv_csv(counts: DataFrame, path: str) -> None:
    """``key;count`` files, one folder per section."""
    line = F.concat_ws(";", "key", F.col("count").cast("string"))
    counts.select("section", line.alias("value")).write.mode("overwrite").partitionBy("section").text(
        path
    )


# Sections of a profile report in order, with their headings.
REPORT_SECTIONS = (
    ("general", ""),
    ("department", "Department;count"),
    ("module", "module;count"),
    ("sentence_length", "Sentence length;count"),
    ("entity", "NER;count"),
    ("tag", "POS;count"),
    ("word_pair", "Word Pair;count"),
    ("sentence_pair", "Sentence Pair;count"),
    ("word", "word;frequency;count"),
)


def profile_report(profile: DataFrame) -> DataFrame:
    """Report rows (section_no, section, row) of a corpus profile; words carry their frequency.

    Section 0 holds the totals: documents, words and unique words. The profile is stored, as it is read several times.
    """
    profile = stored(profile.select("section", "key", "count"), "profile")
    words = profile.filter(F.col("section") == "word")
    total = words.agg(F.sum("count")).scalar()
    order = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(REPORT_SECTIONS) for x in (s, i)])
    frequency = F.format_number(F.col("count") / total, 6)
    row = F.when(
        F.col("section") == "word", F.concat_ws(";", "key", frequency, F.col("count").cast("string"))
    ).otherwise(F.concat_ws(";", "key", F.col("count").cast("string")))
    body = profile.filter(F.col("section") != "general").select(
        order[F.col("section")].alias("section_no"), "section", row.alias("row")
    )
    docs = profile.filter(F.col("section") == "general").select(F.concat_ws(";", F.lit("# Documents"), "count"))
    sums = words.agg(
        F.concat_ws(";", F.lit("# Words"), F.sum("count")).alias("a"),
        F.concat_ws(";", F.lit("# Unique Words"), F.count(F.lit(1))).alias("b"),
    ).select(F.explode(F.array("a", "b")))
    head = docs.union(sums).toDF("row")
    totals = head.select(F.lit(0).alias("section_no"), F.lit("general").alias("section"), "row")
    return totals.unionByName(body)


def write_profile_report(profile: DataFrame, path: str) -> None:
    """The report as text files in section order."""
    headings = F.create_map(*[F.lit(x) for s, h in REPORT_SECTIONS for x in (s, h)])
    rows = profile_report(profile)
    titles = rows.select("section_no", "section").distinct().select(
        "section_no", F.lit(0).alias("_k"), headings[F.col("section")].alias("row")
    )
    lines = rows.select("section_no", F.lit(1).alias("_k"), "row").unionByName(titles)
    lines.filter(F.col("row") != "").orderBy("section_no", "_k", "row").select("row").write.mode(
        "overwrite"
    ).text(path)


def export_selected_questions(questions: DataFrame, top: str) -> DataFrame:
    """``question#id#category#types#taken`` rows of taken, typed questions under ``top``."""
    chosen = questions.filter(
        F.array_contains("category", top) & F.col("taken") & (F.size("types") > 0)
    )
    types = F.array_join(F.transform("types", lambda t: F.concat(F.lit(", "), t)), "")
    row = F.concat_ws("#", "question", "id", F.element_at("category", -1), types, F.lit("1"))
    return chosen.select(row.alias("row"))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition; rows where it is unknown stay."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def insert_if_absent(table: DataFrame, new: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """``table`` plus the new rows whose key it lacks; of equal new keys the first is taken.

    Rows without a key are always inserted.
    """
    keyed = first_per_key(new.filter(F.col(key).isNotNull()), [key], [F.col(c) for c in order_by])
    fresh = keyed.join(table.select(key).distinct(), key, "left_anti")
    unkeyed = new.filter(F.col(key).isNull())
    names = table.columns
    return table.unionByName(fresh.select(*names)).unionByName(unkeyed.select(*names))


def incremental_docs(docs: DataFrame, present: DataFrame, keys: Sequence[str] = ("corpus", "id", "offset")) -> DataFrame:
    """Documents whose keys are not yet present."""
    return docs.join(present.select(*keys).distinct(), list(keys), "left_anti")


def update_field(
    table: DataFrame,
    changes: DataFrame,
    key: str,
    field: str,
    append: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """Set ``field`` from ``changes`` (key, value), or append to it.

    Changes of a key are applied one after another in the order of the column ``order_by`` of
    ``changes`` (without it, of their values): the last one set stays, appended arrays follow one
    another, and map entries replace earlier ones of the same name. A null value changes nothing.
    """
    kind = table.schema[field].dataType
    value = F.col("value")
    at = F.col(order_by) if order_by else F.lit(0)
    known = changes.filter(F.col(key).isNotNull() & value.isNotNull())
    order = F.struct(at.alias("at"), F.to_json(F.struct(value)).alias("text"))
    if not append:
        new = known.groupBy(key).agg(F.max_by(value, order).alias("_new"))
    else:
        listed = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.to_json(F.struct(value)).alias("text"), F.struct(value).alias("v"))))
        if kind.typeName() == "map":
            # the last entry of each name
            entries = known.select(key, at.alias("at"), F.to_json(F.struct(value)).alias("text"), F.explode(value).alias("_k", "_v"))
            last = entries.groupBy(key, "_k").agg(F.max_by("_v", F.struct("at", "text")).alias("_v"))
            new = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_new"))
        else:
            new = known.groupBy(key).agg(F.flatten(F.transform(listed, lambda c: c["v"]["value"])).alias("_new"))
    joined = table.join(new, key, "left")
    old, change = F.col(field), F.col("_new")
    if not append:
        result = F.coalesce(change, old)
    elif kind.typeName() == "map":
        kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(change), k))
        result = F.when(change.isNull(), old).when(old.isNull(), change).otherwise(F.map_concat(kept, change))
    else:
        result = F.when(change.isNull(), old).when(old.isNull(), change).otherwise(F.concat(old, change))
    return joined.withColumn(field, result).select(*table.columns)


def set_flag(table: DataFrame, which: DataFrame, keys: Sequence[str], flag: str, value: bool) -> DataFrame:
    """Set a boolean column for the given keys."""
    marks = which.select(*keys).distinct().withColumn("_set", F.lit(value))
    joined = lookup_join(table, marks, list(keys), "left")
    return joined.withColumn(flag, F.coalesce("_set", flag)).drop("_set").select(*table.columns)


def to_transcript(
    docs: DataFrame, corpus: str, code: str | None = None, text: str = "text"
) -> DataFrame:
    """Corpus documents (id, module, department, title) as uniform transcript rows.

    A type code column maps to lecture, seminar or other; without one all are lectures.
    """
    kind = F.lit("lecture")
    if code is not None:
        kind = F.lit("other")
        for short, name in fixed.LECTURE_TYPES.items():
            kind = F.when(F.col(code) == short, name).otherwise(kind)
    return docs.select(
        F.col("id").cast("string").alias("id"),
        F.lit(corpus).alias("corpus"),
        F.coalesce("module", F.lit("")).alias("module"),
        F.col("department"),
        F.coalesce("title", F.lit("")).alias("title"),
        kind.alias("type"),
        tx.collapse_breaks(F.col(text)).alias("text"),
        F.lit(0).alias("offset"),
        F.array().cast("array<struct<id:string,type:string,probability:double,start:bigint,"
                        "length:bigint,surface_form:string,types:array<string>>>").alias("clues"),
        F.create_map().cast("map<string,array<double>>").alias("vectors"),
    )


def get_page(table: DataFrame, order_by: Sequence[str], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` in order, by distributed row numbers."""
    order = [F.col(c) for c in order_by]
    numbered = number_rows(table, order, name="_no")
    return numbered.filter((F.col("_no") > start) & (F.col("_no") <= start + size)).drop("_no")


# Rows of a file of a table stored for paging.
PAGE_FILE_ROWS = 100_000


def store_pages(table: DataFrame, order_by: Sequence[str], path: str | None = None, file_rows: int = PAGE_FILE_ROWS) -> str:
    """Store ``table`` in order, with a directory of how many rows come before each file; returns the folder.

    Files hold at most ``file_rows`` rows. Their names are in the order of the rows, so the directory
    needs no look at the rows' keys; a key may be on any number of rows, if the columns of ``order_by`` together
    tell rows apart.
    """
    spark = table.sparkSession
    path = path or new_folder(spark, "pages")
    ordered = table.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered.write.option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(f"{path}/rows")
    files = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    directory = running_total(files, "rows", [F.col("file")], name="start")
    directory.withColumn("order_by", F.array(*[F.lit(c) for c in order_by])).write.mode("overwrite").parquet(f"{path}/directory")
    return path


def page_files(spark: SparkSession, path: str, start: int, size: int) -> DataFrame:
    """(file, start, rows, order_by) of the files that hold rows ``start`` to ``start + size``."""
    directory = spark.read.parquet(f"{path}/directory")
    return directory.filter((F.col("start") < start + size) & (F.col("start") + F.col("rows") > start))


def stored_page(spark: SparkSession, path: str, start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` of a table stored by ``store_pages``.

    Reads the directory and the files of the page, no more than it has rows, and sorts only those.
    """
    files = page_files(spark, path, start, size).orderBy("start").collect()
    if not files or size <= 0:
        return spark.read.parquet(f"{path}/rows").limit(0)
    rows = spark.read.parquet(*[f"{path}/rows/{f['file']}" for f in files])
    return rows.orderBy(*files[0]["order_by"]).offset(start - files[0]["start"]).limit(size)
