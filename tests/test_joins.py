from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpusqa.operators import joins


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_join(spark, skewed, how):
    right = spark.range(0, 1500, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    plain = rows(skewed.join(right, "k", how).fillna(-1))
    assert rows(joins.lookup_join(skewed, right, "k", how).fillna(-1)) == plain
    assert rows(joins.lookup_join(skewed, right, "k", how, max_bytes=0).fillna(-1)) == plain


def test_salted_join_accepts_map_columns(spark):
    left = spark.createDataFrame([(1, {"a": 1}), (2, {"b": 2})], "k int, m map<string,int>")
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    assert joins.lookup_join(left, right, "k", max_bytes=0).select("k", "w").collect()[0]["w"] == "x"


def test_number_rows_per_group_and_overall(spark, skewed):
    got = joins.number_rows(skewed, [F.col("v").desc()])
    assert sorted(r["row_number"] + r["v"] for r in got.collect()) == [3000] * 3000
    grouped = joins.number_rows(skewed, [F.col("v")], ["k"], "n").filter("k = 0")
    assert all(r["n"] == r["v"] // 3 + 1 for r in grouped.collect())
    assert grouped.count() == 1000


def test_running_total(spark, skewed):
    got = joins.running_total(skewed, "v", [F.col("v")], ["k"], "before").filter("k = 0")
    for r in got.collect():
        n = r["v"] // 3
        assert r["before"] == 3 * n * (n - 1) // 2


def test_attach_children_keeps_childless_parents(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    children = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "k int, child string")
    got = sorted((r["k"], r["name"], r["child"]) for r in joins.attach_children(parents, children, "k").fillna("-").collect())
    assert got == [(1, "a", "x"), (1, "a", "y"), (2, "b", "-")]


def test_first_per_key(spark, skewed):
    got = joins.first_per_key(skewed, ["k"], [-F.col("v")])
    assert got.filter("k = 0").first()["v"] == 2997
    assert got.count() == skewed.select("k").distinct().count()


def test_top_per_key_beyond_the_group_limit(spark, skewed, monkeypatch):
    plain = rows(joins.top_per_key(skewed, ["k"], [F.col("v").desc()], 5))
    monkeypatch.setattr(joins, "GROUP_LIMIT", 2)
    assert rows(joins.top_per_key(skewed, ["k"], [F.col("v").desc()], 5)) == plain


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_salts_hot_keys_only(spark, skewed, how, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_bytes: False)
    right = spark.range(0, 1500, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    plain = rows(skewed.join(right, "k", how).fillna(-1))
    assert rows(joins.lookup_join(skewed, right, "k", how).fillna(-1)) == plain


def test_lookup_join_moves_the_small_left_side(spark, skewed, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_bytes: "v" in df.columns)
    right = spark.range(0, 1500, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = joins.lookup_join(skewed, right, "k")
    assert got.columns == ["k", "v", "w"] and rows(got) == rows(skewed.join(right, "k"))


def test_running_totals(spark, skewed):
    with_one = skewed.withColumn("one", F.lit(1))
    got = joins.running_totals(with_one, {"sum": "v", "n": "one"}, [F.col("v")], ["k"]).filter("k = 0")
    for r in got.collect():
        n = r["v"] // 3
        assert (r["sum"], r["n"]) == (3 * n * (n - 1) // 2, n)
