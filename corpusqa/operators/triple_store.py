"""Triples on disk in two orders, read by what a lookup knows.

``by_predicate`` lies in folders by the local name of the predicate, ``by_object`` in folders by (predicate, object).
A lookup takes the order whose folders its values name, so a scan lists those folders only; rows are sorted inside,
and Parquet's statistics skip the rest. Files are cut by ranges of (folder, p, o, s): a predicate that holds a third of all
triples is as many files as its size asks for. Triples that are there several times are stored with their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.operators import triples as tr

ROWS_PER_FILE = 1 << 22
MOST_FOLDERS = 4096  # of one order; more values share folders
COPIES = 1 << 16  # of one triple in one stored row

_SCHEMA = "s string, p string, o string, lang string, n long, part int"
_SIZES = "rows long, predicate_parts int, object_parts int"


def _part(parts: int, *of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(parts)).cast("int")


def _predicate_part(parts: int, p: Column) -> Column:
    # a lookup gives a whole URI or a local name: both name the same folder
    return _part(parts, tr.local_name(p))


@dataclass(frozen=True)
class TripleStore:
    """Triples in the folder ``path``."""

    spark: SparkSession
    path: str
    predicate_parts: int
    object_parts: int

    def _rows(self, order: str, part: Column, wanted: Column) -> DataFrame:
        stored = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{order}")
        found = stored.filter(part & wanted)
        return found.select("s", "p", "o", "lang", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy")).drop("_copy")

    def of_predicates(self, predicates: Sequence[str]) -> DataFrame:
        """(s, p, o, lang) of predicates, given by URI or local name; none if none is given."""
        parts = [F.col("part") == _predicate_part(self.predicate_parts, F.lit(p)) for p in predicates]
        return self._rows("by_predicate", reduce(or_, parts, F.lit(False)), tr.has_predicate(predicates))

    def of_object(self, predicate: str, value: str) -> DataFrame:
        """(s, p, o, lang) of one object of one predicate, given by URI."""
        part = F.col("part") == _part(self.object_parts, F.lit(predicate), F.lit(value))
        return self._rows("by_object", part, (F.col("p") == predicate) & (F.col("o") == value))


def _write(rows: DataFrame, part: Column, files: int, path: str) -> None:
    order = ["part", "p", "o", "s"]
    placed = rows.withColumn("part", part).repartitionByRange(files, *order)
    placed.sortWithinPartitions(*order).write.partitionBy("part").parquet(path)


def write_triples(triples: DataFrame, path: str) -> TripleStore:
    """Store triples (s, p, o, lang) below ``path``, which must not hold a store yet.

    Rows with nulls and repeated rows are kept; other columns are not. An empty table gives an empty store. A store is there once its
    sizes are written, which is last.
    """
    spark = triples.sparkSession
    size = triples.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(tr.local_name(F.col("p"))).alias("names")).first()
    files = max(1, -(-size["rows"] // ROWS_PER_FILE))
    predicate_parts = min(max(1, size["names"]), MOST_FOLDERS)
    object_parts = min(max(predicate_parts, files), MOST_FOLDERS)
    counted = triples.groupBy("s", "p", "o", "lang").agg(F.count(F.lit(1)).alias("_n"))
    pieces = F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / COPIES).cast("int"))).alias("_i")
    rows = counted.select("s", "p", "o", "lang", "_n", pieces).select(
        "s", "p", "o", "lang", F.least(F.lit(COPIES), F.col("_n") - F.col("_i") * COPIES).cast("long").alias("n")
    )
    _write(rows, _predicate_part(predicate_parts, F.col("p")), files, f"{path}/by_predicate")
    stored = spark.read.schema(_SCHEMA).parquet(f"{path}/by_predicate").drop("part")
    _write(stored, _part(object_parts, F.col("p"), F.col("o")), files, f"{path}/by_object")
    spark.createDataFrame([(size["rows"], predicate_parts, object_parts)], _SIZES).coalesce(1).write.parquet(f"{path}/sizes")
    return TripleStore(spark, path, predicate_parts, object_parts)


def open_triples(spark: SparkSession, path: str) -> TripleStore:
    """The store that ``write_triples`` left in ``path``."""
    sizes = spark.read.schema(_SIZES).parquet(f"{path}/sizes").first()
    return TripleStore(spark, path, sizes["predicate_parts"], sizes["object_parts"])


def entities_of_predicate(store: TripleStore, predicate: str) -> DataFrame:
    """All (object, subject) of a predicate, given by URI or local name."""
    return tr.entities_of_predicate(store.of_predicates([predicate]), predicate)


def build_entity_index(store: TripleStore, predicates: list[str]) -> DataFrame:
    """(key, entity) rows: objects of the predicates and their subjects."""
    return tr.build_entity_index(store.of_predicates(predicates), predicates)


def predicate_list(
    store: TripleStore, label: str = tr.RDFS_LABEL, type_: str = tr.RDF_TYPE, property_: str = tr.RDF_PROPERTY, lang: str = "en"
) -> DataFrame:
    """Properties with their label in one language."""
    labels = store.of_predicates([label]).filter((F.col("p") == label) & (F.col("lang") == lang)).select("s", "o")
    return labels.join(store.of_object(type_, property_).select("s").distinct(), "s", "left_semi")


def of_type(store: TripleStore, type_: str, clause: DataFrame | None = None, type_predicate: str = tr.RDF_TYPE) -> DataFrame:
    """Distinct subjects of a type, of those in ``clause`` (s) if given."""
    return tr.of_type(store.of_object(type_predicate, type_), type_, clause, type_predicate)
