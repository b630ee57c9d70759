from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from corpusqa.functions import vectors as vx
from corpusqa.operators import answers as an
from corpusqa.operators import embeddings as em
from corpusqa.operators import neighbors as nb
from corpusqa.operators import pairs
from corpusqa.operators import training as tn


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(
        [("son", [3.0, 1.0]), ("boy", [1.0, 1.0]), ("girl", [1.0, 3.0]), ("daughter", [3.0, 3.0])],
        "word string, vec array<double>",
    )


def value(spark, a, b, fn):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(fn(F.col("a"), F.col("b"))).first()[0]


def test_vector_functions(spark):
    assert value(spark, [1.0, 2.0], [3.0], vx.add) == [4.0]
    assert value(spark, [1.0], [1.0, 2.0], vx.cosine) is None
    assert value(spark, [1.0], [1.0, 2.0], vx.euclidean) is None
    assert math.isnan(value(spark, [0.0, 0.0], [1.0, 2.0], vx.cosine))
    assert value(spark, [0.0, 3.0], [4.0, 0.0], vx.euclidean) == 5.0
    assert value(spark, [2.0, 4.0], [0.0], lambda a, b: vx.scale_down(a, b[0])) == [2.0, 4.0]
    assert value(spark, [3.0, 4.0], [0.0], lambda a, b: vx.normalize(a)) == [0.6, 0.8]


def test_average_pads_short_vectors(spark):
    df = spark.createDataFrame([(1, [2.0, 4.0]), (1, [2.0])], "k int, vec array<double>")
    assert em.average(df, "k", 2).first()["vec"] == [2.0, 2.0]


def test_analogy(spark, vocab):
    t = spark.createDataFrame([(1, "son", "boy", "girl"), (2, "son", "boy", "nobody")], "q int, word1 string, word2 string, word3 string")
    assert rows(em.analogy(t, "q", vocab, 1), "qid", "item") == [(1, "daughter")]


def test_centroids(spark, vocab):
    groups = spark.createDataFrame(
        [(1, ["son", "girl"]), (2, ["son", "nobody"]), (3, [])], "k int, words array<string>"
    )
    assert {r["k"]: r["vec"] for r in em.centroid(groups, "k", "words", vocab).collect()} == {1: [2.0, 2.0], 2: None, 3: None}
    tolerant = {r["k"]: r["vec"] for r in em.centroid_tolerant(groups, "k", "words", vocab).collect()}
    assert tolerant == {1: [2.0, 2.0], 2: [1.5, 0.5], 3: [0.0, 0.0]}


def test_rank_words(spark, vocab):
    sets = spark.createDataFrame(
        [(1, "son", "boy"), (1, "son", "girl"), (2, "son", "boy"), (2, "son", "nobody")], "k int, word string, member string"
    )
    assert [(r["member"], round(r["cosine"], 4)) for r in em.rank_words(sets, "k", vocab).orderBy("member").collect()] == [
        ("boy", 0.8944), ("girl", 0.6)]


def test_neighbours_edge_cases(spark):
    items = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, None)], "item int, vec array<double>"
    )
    q = spark.createDataFrame([("q", [2.0, 0.0])], "qid string, vec array<double>")
    got = [(r["item"], r["score"]) for r in nb.nearest_neighbors(q, items, 10).orderBy("rank").collect()]
    assert got[:3] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert got[3][0] == 4 and math.isnan(got[3][1])
    assert nb.nearest_neighbors(q, items, 10, strict_n=True).count() == 0
    assert nb.nearest_neighbors(q, items, 4, strict_n=True).count() == 4


@pytest.mark.parametrize("blocks", [False, True])
def test_neighbours_against_brute_force(spark, monkeypatch, blocks):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(500, 8)), rng.normal(size=(30, 8))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, vec array<double>")
    if blocks:
        monkeypatch.setattr(nb, "QUERY_BYTES", 1000)
        monkeypatch.setattr(nb, "ITEM_BYTES", 10_000)
    got = {}
    for r in nb.nearest_neighbors(queries, items, 7).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["item"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-np.round(unit(q) @ unit(v).T, 6), axis=1, kind="stable")[:, :7]
    assert got == {i: list(row) for i, row in enumerate(want)}


def test_excluded_words(spark, vocab):
    q = spark.createDataFrame([(1, [3.0, 3.0])], "qid int, vec array<double>")
    own = spark.createDataFrame([(1, "daughter"), (1, "boy")], "qid int, item string")
    assert sorted(r["item"] for r in em.nearest_words(q, vocab, 2, exclude=own).collect()) == ["girl", "son"]


def test_training_stores_and_reloads(spark, tmp_path):
    docs = spark.createDataFrame([("a b c a b c",)] * 20, "text string")
    first = em.train_embeddings(docs, size=4, min_count=1, path=str(tmp_path))
    again = em.train_embeddings(docs.limit(0), size=4, min_count=1, path=str(tmp_path))
    assert rows(first, "word") == rows(again, "word") == [("a",), ("b",), ("c",)]
    with pytest.raises(ValueError):
        em.train_embeddings(docs, dm=1)


def test_vectorize_and_reset(spark, vocab):
    docs = spark.createDataFrame([(1, "son girl"), (2, "son stranger")], "id int, text string")
    done = em.vectorize(docs, "id", {"m": vocab})
    assert {r["id"]: r["vectors"]["m"] for r in done.collect()} == {1: [2.0, 2.0], 2: [1.5, 0.5]}
    assert em.unvectorize(done).filter(F.size("vectors") > 0).count() == 0


def test_mixed_lengths_are_refused(spark):
    mixed = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 2.0, 3.0])], "word string, vec array<double>")
    groups = spark.createDataFrame([(1, ["b"])], "k int, words array<string>")
    with pytest.raises(ValueError):
        em.centroid(groups, "k", "words", mixed)
    assert em.vector_size(mixed.limit(0)) == 0


def test_exclusions_count_inside_the_kernel(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "item long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "qid long, vec array<double>")
    out = spark.createDataFrame([(1, i) for i in range(45)], "qid long, item long")
    got = {}
    for r in nb.nearest_neighbors(q, items, 3, exclude=out).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["item"])
    assert got == {1: [45, 46, 47], 2: [0, 1, 2]}


@pytest.mark.parametrize("n", [1, 5, 700])
def test_bounds_lose_no_neighbour(spark, monkeypatch, n):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 4
    v = np.concatenate([centres[i % 12] + rng.normal(size=6) * 0.3 for i in range(600)]).reshape(600, 6)
    v[::97] = 0.0
    v[5] = v[17] = v[29]  # ties
    rows_ = [(f"i{i:04d}", x.tolist()) for i, x in enumerate(v)] + [("short", [1.0, 2.0]), ("empty", []), ("odd", [float("inf")] * 6), ("none", None)]
    items = spark.createDataFrame(rows_, "item string, vec array<double>").repartition(5)
    asked = [(i, x.tolist()) for i, x in enumerate(v[:40] + 0.01)] + [(90, [0.0] * 6), (91, [1.0, 0.5]), (92, [3.0]), (93, []), (94, v[29].tolist())]
    queries = spark.createDataFrame(asked, "qid long, vec array<double>")
    out = spark.createDataFrame([(q, f"i{q:04d}") for q in range(20)] + [(3, "i0017"), (94, "i0005"), (3, "unknown")], "qid long, item string")
    want, key = {}, ["qid", "rank", "item"]
    for cut in (False, True):
        if cut:
            monkeypatch.setattr(nb, "ITEM_BYTES", 6_000)
            monkeypatch.setattr(nb, "QUERY_BYTES", 2_000)
        for which, left in (("all", None), ("out", out)):
            got = rows(nb.nearest_neighbors(queries, items, n, exclude=left), *key)
            assert want.setdefault(which, got) == got
    assert len(want["all"]) == len(asked) * min(n, len(rows_) - 1)
    if n < 10:
        scored, every = nb.pairs_scored(queries.filter("qid < 90"), items, n)
        assert scored * 2 < every


def test_items_are_worked_out_once(spark, monkeypatch):
    # sizes, pivots and both looks read the same stored vectors
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    v = np.random.default_rng(8).normal(size=(200, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, vec array<double>").mapInArrow(count, "item long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "qid long, vec array<double>")
    monkeypatch.setattr(nb, "ITEM_BYTES", 4_000)
    assert nb.nearest_neighbors(queries, items, 3).count() == 3
    assert seen.value == 200


def test_the_second_look_hands_on_what_can_be_best(spark):
    # of items below the floor none is handed on, of close ones all are told apart in double precision
    items = pa.table({"item": list(range(1000)), "vec": [[1.0, i * 1e-3] for i in range(1000)], "slice": pa.array([i // 500 for i in range(1000)], pa.int32())})
    queries = pa.table({
        "qid": [7, 8], "vec": [[1.0, 0.0], [0.0, 1.0]], "floor": pa.array([0.9999, None], pa.float64()),
        "slices": pa.array([[0, 1], [1]], pa.list_(pa.int32())), "banned": pa.array([[0], None], pa.list_(pa.int64()))})
    kinds = pa.schema([("qid", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])
    got = nb._best(queries, items, 40, kinds).to_pydict()
    mine = [i for q, i in zip(got["qid"], got["item"]) if q == 7]
    assert mine[:13] == list(range(1, 14)) and len(mine) <= 16
    assert [i for q, i in zip(got["qid"], got["item"]) if q == 8] == list(range(999, 959, -1))


def test_no_items_no_neighbours(spark):
    items = spark.createDataFrame([], "item long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    assert nb.nearest_neighbors(q, items, 3).count() == 0


def test_normalize_works_out_its_norm_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "vec array<double>")
    unit = df.select(vx.normalize(F.col("vec")).alias("u"))
    out = [r["u"] for r in unit.collect()]
    assert out[0] == [0.6, 0.8] and all(math.isnan(x) for x in out[1]) and out[2] is None
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_planted_synonyms_are_neighbours(spark, monkeypatch):
    # two words in the same company, though never together, are nearest to each other
    rng = np.random.default_rng(2)
    topics = {t: [f"{t}{i}" for i in range(12)] for t in ("sea", "hill", "town")}
    twins = {"sea": ("ship", "boat"), "hill": ("path", "trail"), "town": ("street", "road")}
    texts = []
    for i in range(900):
        t = list(topics)[i % 3]
        w = list(rng.choice(topics[t], 12))
        w[int(rng.integers(3, 9))] = twins[t][int(rng.integers(2))]
        texts.append((" ".join(w),))
    docs = spark.createDataFrame(texts, "text string").repartition(4)
    vectors = {}
    for cell in (1 << 20, 50):
        monkeypatch.setattr(tn, "CELL_ENTRIES", cell)
        trained = em.train_embeddings(docs, size=8, min_count=3)
        vectors[cell] = {r["word"]: np.array(r["vec"]) for r in trained.collect()}
        unit = {w: v / np.linalg.norm(v) for w, v in vectors[cell].items()}
        assert len(unit) == 42
        for a, b in twins.values():
            assert max((w for w in unit if w != a), key=lambda w: unit[a] @ unit[w]) == b
    # the grid of the matrix does not change the similarities
    a, b = vectors.values()
    words = sorted(a)
    gram = [np.array([x[w] for w in words]) @ np.array([x[w] for w in words]).T for x in (a, b)]
    assert np.allclose(gram[0], gram[1], atol=1e-6 * np.abs(gram[0]).max())


def test_factors_of_a_known_matrix(spark):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    m = (q * np.array([9.0, 6.0, 4.0, *[0.01] * 27])) @ q.T
    matrix = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(30)], "row long, col long, value double")
    start = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(30)], "id long, vec array<double>")
    x = np.array([r["vec"] for r in tn.factorise(matrix, start, 3, 6, 30).orderBy("id").collect()])
    assert np.allclose(x @ x.T, (q[:, :3] * np.array([9.0, 6.0, 4.0])) @ q[:, :3].T, atol=0.02)
    assert np.allclose(np.linalg.norm(x, axis=0) ** 2, [9, 6, 4], atol=0.01)


def test_context_counts(spark):
    docs = spark.createDataFrame([("a b a c",), ("b rare b",), (None,), ("",)], "text string")
    assert rows(tn.context_counts(docs, window=2, min_count=2)) == [("a", "a", 1), ("a", "b", 2), ("b", "b", 1)]
    assert tn.context_counts(docs.limit(0)).count() == 0
    assert em.train_embeddings(docs, size=3, min_count=50).count() == 0


def test_large_vocabularies_send_a_vector_once_a_chunk(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("b", [1.0, 1.0]), ("c", None)], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "a b b x"), (1, "a"), (2, "c a"), (3, ""), (4, None), (None, "b")], "id int, text string")
    got = lambda: rows(em.paragraph_vector(docs, "id", vocab).select(F.coalesce("id", F.lit(-1)), "vec"))
    small = got()
    used = []
    chunked = em._chunked
    monkeypatch.setattr(em, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(em, "_chunked", lambda *a: used.append(1) or chunked(*a))
    monkeypatch.setattr(em, "CHUNK_WORDS", 1)
    monkeypatch.setattr(em, "GATHERED", 2)
    assert got() == small and used
    both = em.vectorize(docs, "id", {"one": vocab, "two": vocab.filter("word = 'a'")})
    one, two = (rows(both.select(F.coalesce("id", F.lit(-1)), F.col("vectors")[m])) for m in ("one", "two"))
    assert one == small
    assert dict(two)[1] == [2 / 5, 4 / 5] and dict(two)[2] == [1 / 2, 1.0]


def test_matrix_cells_are_packed(spark, monkeypatch):
    # entries of a cell travel as lists, not a row each
    monkeypatch.setattr(tn, "PACKED", 3)
    cell = pa.table({"_r": [1] * 4, "_c": [0] * 4, "row": [2, 1, 2, 1], "col": [1, 1, 2, 2], "value": [1.0, 2.0, 3.0, 4.0]})
    packed = tn._packed(cell)
    assert packed["row"].to_pylist() == [[1, 1, 2], [2]] and packed["_r"].to_pylist() == [1, 1]
    columns = pa.table({"id": [2, 1], "vec": [[1.0, 0.0], [0.0, 1.0]]})
    got = tn._product(packed, columns, 2)
    assert got["id"].to_pylist() == [1, 2] and got["vec"].to_pylist() == [[4.0, 2.0], [3.0, 1.0]]


def test_context_counts_of_large_vocabularies(spark, monkeypatch):
    docs = spark.createDataFrame([("a b a c",), ("b rare b",), (None,)], "text string")
    monkeypatch.setattr(tn, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(pairs, "BLOCK_WORDS", 2)
    monkeypatch.setattr(pairs, "CELL_PAIRS", 1)
    assert rows(tn.context_counts(docs, window=2, min_count=2)) == [("a", "a", 1), ("a", "b", 2), ("b", "b", 1)]


def test_large_vocabularies_take_keys_of_fields(spark, monkeypatch):
    # a field that is never null, as the number of a phrase in its question, stays so
    vocab = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    asked = spark.createDataFrame([(1, ["a b", "b"]), (2, ["x"]), (3, [])], "qid int, focus array<string>")
    parts = spark.createDataFrame([("d", "a a"), ("e", "b")], "id string, text string").withColumn("offset", F.lit(0))
    got = lambda: rows(an.candidates_vectors(asked, parts, vocab, use_focus=True, stored=an.snippet_vectors(parts, vocab)).filter("qid = 1"))
    small = got()
    monkeypatch.setattr(em, "fits_broadcast", lambda df: False)
    assert len(small) == 2 and got() == small


def test_training_reads_pairs_where_they_lie(spark, monkeypatch):
    # the same directions by stored counts, by parts of the vectors, and by the matrix; no pair is moved in a turn
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(" ".join(words[k] for k in (rng.integers(0, 10, 30) + 10 * (n % 4))),) for n in range(40)], "text string")
    gram, moved = [], []
    product = tn._count_product

    def watched(*a):
        out = product(*a)
        moved.append(out._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange "))
        return out

    monkeypatch.setattr(tn, "_count_product", watched)
    for most in (1 << 26, 8 * 40 * 3, 8 * 40):
        monkeypatch.setattr(tn, "TOLD_BYTES", most)
        got = {r["word"]: r["vec"] for r in tn.train_vectors(docs, "text", 3, 2, 5, 3, 7).collect()}
        x = np.array([got[w] for w in words])
        gram.append(x @ x.T)
    assert np.allclose(gram[0], gram[1], atol=1e-6) and np.allclose(gram[0], gram[2], atol=1e-6) and np.abs(gram[0]).max() > 0.1
    assert moved == [1] * 6  # the sums of the vectors


def test_blocks_of_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(pairs, "MOST_PAIRS", 100)
    texts = [["a", "b", "c", "d", "e"] * 2] * 30
    batch = pa.RecordBatch.from_pydict({"_words": texts, "_copies": [1] * 30, "_group": [0] * 30, "_split": [-1] * 30})
    batch = batch.cast(pa.schema([("_words", pa.list_(pa.string())), ("_copies", pa.int64()), ("_group", pa.int64()), ("_split", pa.int32())]))
    known = pa.array(["a", "b", "d"])
    cells = list(pairs._count(iter([batch]), 5, known, 1))
    assert len(cells) == 15 and all(not len(c["words"][0]) for c in cells)  # two texts of 50 pairs each; words go by number
    schema = ["words", "groups", "a", "b", "n"]
    got = pairs._merge(pa.Table.from_batches([c.select(schema) for c in cells]), known).to_pylist()
    monkeypatch.setattr(pairs, "MOST_PAIRS", 1 << 23)
    (whole,) = pairs._count(iter([batch]), 5, known, 1)
    assert got == pairs._merge(pa.Table.from_batches([whole.select(schema)]), known).to_pylist() and len(got) == 6
