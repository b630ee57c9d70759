from __future__ import annotations

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusqa.operators import triple_store as ts
from corpusqa.operators import triples as tr

SCHEMA = "s string, p string, o string, lang string"
NAME = "http://x/ontology/name"


@pytest.fixture(scope="module")
def triples(spark):
    some = [
        ("Iron_Man", tr.RDF_TYPE, "Cartoon", ""),
        ("Iron_Man", tr.RDF_TYPE, "Cartoon", ""),
        ("Bat_Man", tr.RDF_TYPE, "Cartoon", ""),
        ("Iron_Man", NAME, "Iron Man", ""),
        ("Iron_Man", "http://y/other/name", "Tony", "en"),
        ("Iron_Man", "name", "bare", ""),
        ("Iron_Man", "http://x/ontology/surname", "Stark", ""),
        ("colour", tr.RDF_TYPE, tr.RDF_PROPERTY, ""),
        ("colour", tr.RDFS_LABEL, "colour", "en"),
        ("colour", tr.RDFS_LABEL, "Farbe", "de"),
        ("nothing", tr.RDFS_LABEL, "nothing", "en"),
        (None, NAME, "no subject", ""),
        ("x", None, "no predicate", ""),
        ("x", NAME, None, None),
    ]
    many = [(f"e{i % 50}", f"http://x/p{i % 20}", f"o{i % 7}", "") for i in range(2000)]
    return spark.createDataFrame(some + many, SCHEMA).withColumn("part", F.lit("other"))


@pytest.fixture(scope="module")
def store(spark, triples, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("triples") / "store")
    ts.write_triples(triples, path)
    return ts.open_triples(spark, path)


def _same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("name", ["name", NAME, "p3", "http://x/p3", "type", tr.RDF_TYPE, "not there"])
def test_predicates_as_in_the_table(store, triples, name):
    assert _same(ts.entities_of_predicate(store, name), tr.entities_of_predicate(triples, name))


def test_lists_as_in_the_table(store, triples):
    names = ["name", "http://x/p3", "p4"]
    assert _same(ts.build_entity_index(store, names), tr.build_entity_index(triples, names))
    assert store.of_predicates([]).count() == 0
    assert rows(ts.predicate_list(store)) == rows(tr.predicate_list(triples)) == [("colour", "colour")]
    # one predicate in both roles
    assert _same(
        ts.predicate_list(store, tr.RDF_TYPE, tr.RDF_TYPE, "Cartoon", ""), tr.predicate_list(triples, tr.RDF_TYPE, tr.RDF_TYPE, "Cartoon", "")
    )
    clause = triples.filter(F.col("o").contains("Iron")).select("s")
    assert rows(ts.of_type(store, "Cartoon", clause)) == [("Iron_Man",)]
    assert rows(ts.of_type(store, "Cartoon")) == [("Bat_Man",), ("Iron_Man",)]


def _folders(df):
    return {re.search(r"part=(\d+)", f).group(1) for f in df.inputFiles()}


def test_a_lookup_lists_its_folders_only(store):
    for found in (store.of_predicates(["http://x/p3"]), store.of_object("http://x/p3", "o3")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        told = re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
        assert re.search(r"part#\d+ = \d+", told), told
    files = store.of_predicates(["http://x/p3"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({re.search(r"part=(\d+)", r.f).group(1) for r in files}) == 1
    everything = store.spark.read.parquet(f"{store.path}/by_predicate")
    assert len(_folders(everything)) > 10


def test_copies_and_hot_predicates_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ts, "COPIES", 100)
    monkeypatch.setattr(ts, "ROWS_PER_FILE", 500)
    hot = spark.range(3000).select(F.format_string("e%d", "id").alias("s"), F.lit(tr.RDF_TYPE).alias("p"), F.lit("T").alias("o"), F.lit("").alias("lang"))
    same = spark.range(950).select(F.lit("a").alias("s"), F.lit("p").alias("p"), F.lit("b").alias("o"), F.lit("").alias("lang"))
    store = ts.write_triples(hot.unionByName(same), str(tmp_path / "store"))
    assert store.of_predicates(["p"]).count() == 950
    assert store.of_object("p", "b").count() == 950
    assert ts.of_type(store, "T").count() == 3000
    typed = store.of_object(tr.RDF_TYPE, "T").select(F.input_file_name().alias("f")).distinct()
    assert typed.count() > 3


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    ts.write_triples(spark.createDataFrame([], SCHEMA), path)
    store = ts.open_triples(spark, path)
    assert store.of_predicates(["name"]).count() == 0
    assert ts.of_type(store, "T").count() == 0
    assert ts.predicate_list(store).count() == 0
