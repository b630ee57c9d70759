"""Lookups over a triple table (s, p, o, lang)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_PROPERTY = "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


def local_name(uri: Column) -> Column:
    """A URI without everything up to its last slash."""
    return F.regexp_replace(uri, r"^.*http://.*/", "")


def has_predicate(predicates: Sequence[str]) -> Column:
    """Whether a triple's predicate is one of those given, by URI or local name."""
    # whole URIs are compared as they are, and the end of a local name is: a scan can use both
    out = F.lit(False)
    for p in predicates:
        if "http://" in p:
            out = out | (F.col("p") == p)
        else:
            out = out | (F.col("p").endswith(p) & (local_name(F.col("p")) == p))
    return out


def entities_of_predicate(triples: DataFrame, predicate: str) -> DataFrame:
    """All (object, subject) of a predicate, given by URI or local name."""
    return triples.filter(has_predicate([predicate])).select(
        F.col("o").alias("object"), F.col("s").alias("subject")
    )


def predicate_list(
    triples: DataFrame,
    label: str = RDFS_LABEL,
    type_: str = RDF_TYPE,
    property_: str = RDF_PROPERTY,
    lang: str = "en",
) -> DataFrame:
    """Properties with their label in one language."""
    labels = triples.filter((F.col("p") == label) & (F.col("lang") == lang)).select("s", "o")
    properties = triples.filter((F.col("p") == type_) & (F.col("o") == property_)).select("s")
    return labels.join(properties.distinct(), "s", "left_semi")


def build_entity_index(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(key, entity) rows: objects of the predicates and their subjects."""
    return triples.filter(has_predicate(predicates)).select(
        F.col("o").alias("key"), F.col("s").alias("entity")
    )


def of_type(triples: DataFrame, type_: str, clause: DataFrame | None = None, type_predicate: str = RDF_TYPE) -> DataFrame:
    """Distinct subjects of a type, of those in ``clause`` (s) if given."""
    subjects = triples.filter((F.col("p") == type_predicate) & (F.col("o") == type_)).select("s")
    if clause is not None:
        subjects = subjects.join(clause.select("s").distinct(), "s", "left_semi")
    return subjects.distinct().select(F.col("s").alias("name"))
