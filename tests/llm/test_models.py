"""Language ID, block labelling, near-dedup of vectors, neighbours and chat against brute force or held-out truth."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest

from corpusqa.llm import block_labeller as bl
from corpusqa.llm import grid_order_join as go
from corpusqa.llm import learned_partitions as lp
from corpusqa.llm import ppm_language as pl
from corpusqa.llm.perspectives import rotate_perspectives
from corpusqa.llm.queries import SQL

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    got = pl.identify(docs).collect()
    assert len(got) == len(truth)
    tested = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in tested)
    assert right / len(tested) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rng = random.Random(1)
    words = {"aa": ["the", "and", "with"], "bb": ["der", "und", "mit", "für"]}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    odd = [(200, None, "aa"), (201, "", "bb"), (202, "12 !! \n", None), (None, "the and the with", "zz"), (203, "der und", None), (3, "und der mit", "bb"), (203, "der und", None), (204, "mit für " * 200_000, None)]
    docs = spark.createDataFrame([(d, t, k, 1.0) for d, t, k in rows + odd], "doc_id long, text string, lang string, score double")
    got = pl.identify(docs.withColumnRenamed("score", "s"), keep=("s", "lang")).collect()
    assert len(got) == len(rows + odd)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 100)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[200] == by[201] == by[202] == "und" and by[203] == by[204] == "bb" and by[None] == "aa"
    empty = pl.identify(docs.limit(0))
    assert empty.collect() == []
    unlabelled = docs.select("doc_id", "text", docs["lang"].isNull().cast("string").alias("lang")).filter("lang = 'x'")
    assert unlabelled.count() == 0


def test_language_code_lengths_are_exact():
    texts = {"x": [b"abab abc " * 9, b"zz"], "y": [b"bcbc acb " * 7]}
    model = pl.train(texts)

    def brute(text, lang):
        # one byte at a time with dictionaries
        total = 0.0
        for i in range(len(text)):
            def chance(order):
                if order < 0:
                    return 1 / 256
                context = key(text, i, order)
                row = {}
                for t in texts[lang]:
                    for j in range(len(t)):
                        if key(t, j, order) == context:
                            row[symbol(t[j])] = row.get(symbol(t[j]), 0) + 1
                n, q = sum(row.values()), len(row)
                if not n:
                    return chance(order - 1)
                c = row.get(symbol(text[i]), 0)
                return c / (n + q) if c else q / (n + q) * chance(order - 1)
            total -= np.log2(chance(seen_order(text, i)))
        return total

    symbol = lambda b: b + 1
    key = lambda t, i, order: tuple(symbol(t[j]) if j >= 0 else 0 for j in range(i - order, i))
    every = {o: {key(t, j, o) for ts in texts.values() for t in ts for j in range(len(t))} for o in range(4)}
    seen_order = lambda t, i: max(o for o in range(4) if key(t, i, o) in every[o])
    probes = [b"abc", b"", b"q", b"zz bcb acb ababab", b"\xff\x00abab"]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in probes])]).astype(np.int64)
    got = pl.code_lengths(model, np.frombuffer(b"".join(probes), np.uint8), offsets)
    want = np.array([[brute(p, k) for k in model.languages] for p in probes])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


def test_language_of_many_scripts(spark):
    # more byte values and contexts than any table of fixed size would have
    rng = random.Random(6)
    scripts = {name: [chr(first + i) for i in range(60)] for name, first in (("el", 0x391), ("ru", 0x410), ("he", 0x5D0), ("hi", 0x905), ("ja", 0x3041), ("zh", 0x4E00), ("ko", 0xAC00), ("th", 0xE01), ("am", 0x1200), ("en", 0x41))}
    rows = [(i * 10 + k, "".join(rng.choices(letters, k=80)), name) for i in range(60) for k, (name, letters) in enumerate(scripts.items())]
    rows += [(5000, "".join(rng.choices(scripts["ru"], k=5000)), "ru")] * 300  # one id on many rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = pl.fit(docs)
    assert len(set(np.concatenate([g % pl.BASE for g in model.grams[:1]]).tolist())) > 126
    truth = {r[0]: r[2] for r in rows}
    got = pl.identify(docs, model).filter("held_out").collect()
    assert got and all(r["lang_pred"] == truth[r["doc_id"]] for r in got)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_blocks():
    got = bl.blocks(page("<nav class='top menu'><ul><li><a href='/a>b'>One</a><li>Two</ul></nav><!-- <p>no</p> --><article><h1>A&nbsp;&lt; B</h1><p>x <b>y<br>z\n w<p>v</b> &#233;</article>tail 1 < 2"))
    assert [b.text for b in got] == ["One", "Two", "A < B", "x y z w", "v é", "tail 1 < 2"]
    assert got[0].path == (("nav", ("top", "menu")), ("ul", ()), ("li", ())) and got[0].linked == 3
    assert got[4].path == (("article", ()), ("p", ()))
    assert bl.blocks("") == [] and bl.blocks("<script>x") == [] and bl.blocks("<p") == [bl.Block((), "<p", 0)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<nav><svg class='i'/>Menu</nav><article><p>One.</p><p>Two.</p></article>", ["Menu", "One.", "Two."]),
        ("<nav><svg><title/><style/><path d='M0'/>Menu</nav><article><p>One.</p></article>", ["Menu", "One."]),
        ("<article><p>Area is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> m.</p><p>Is <math/>it?</p></article>", ["Area is x+1 m.", "Is it?"]),
        ("<article><object data='a'><p>One.</p><canvas><p>Two.</p></article><p>Three.</p>", ["One.", "Two.", "Three."]),
        ("<article><p>See <object>the film</object>, <noscript>or its script</noscript>.</p></article>", ["See the film, or its script."]),
        ("<div><template><p>One.</p></div><iframe src='b'/><p>Two.</p>", ["One.", "Two."]),
        ("<p>A <svg><text>chart</text><text>of</text></svg> it</p><script>if (a</script >b<style x>y</style><p>c", ["A chart of it", "b", "c"]),
        ("<style-guide>One.</style-guide><SCRIPT src='x'></p><p>no", ["One."]),
    ],
)
def test_only_scripts_styles_and_titles_are_skipped(body, want):
    got = bl.blocks(f"<html><head><title>T</title></head><body>{body}")
    assert [b.text for b in got] == want
    assert all(b.path[-1][0] in ("nav", "p", "style-guide") for b in got if b.text != "b")
    assert all(t not in ("article", "template") for b in got if b.text == "Three." or "template" in body and b.text == "Two." for t, _ in b.path)
    assert bl.blocks("<title>no end<p>One.</p>")[-1].text == "One."


def test_deep_paths_tell_what_is_around():
    for depth in (70, 700):
        got = bl.blocks("<nav class=menu>" + "<div class=a><div class=b>" * depth + "<p>x</p>" + "</div></div>" * depth + "<p>y</p></nav><article><div><div><p>z</p>")
        assert [b.path for b in got] == [
            (("nav", ("menu",)), ("div", ("a",)), ("div", ("b",)), ("p", ())), (("nav", ("menu",)), ("p", ())), (("article", ()), ("div", ()), ("p", ()))
        ]
        assert [bl._said(b.path) for b in got] == [False, False, True]
    many = bl.blocks("<aside>" + "".join(f"<div class={'abcdefgh'[i % 8] * (i + 1)}>t" for i in range(3000)))
    assert len(many) == 3000 and max(len(b.path) for b in many) <= bl.PATH_BUCKETS + 2 and not any(bl._said(b.path) for b in many)


def test_labeller_learns_from_distinct_ids(spark, monkeypatch):
    rows = [(None if i % 3 else 1, f"<p>r{i}</p>") for i in range(600)] + [(2 + i, f"<p>p{i}</p>") for i in range(30)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    monkeypatch.setattr(bl, "train", lambda texts: texts)
    assert len(bl.fit(pages, 20)) == 20 and len(bl.fit(pages)) == 31


def test_main_text_of_the_sample_layout(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        want[r["page_id"]] = "\n".join(b.text for b in bl.blocks(article))
    labeller = bl.fit(pages)
    got = bl.extract_main_text(pages, labeller).collect()
    assert sum(r["text"] == want[r["page_id"]] for r in got) >= 0.99 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    # layouts that the sample does not hold; the paragraphs are from other pages
    texts = [t for t in want.values() if t.count("\n") >= 2][:40]
    right = total = 0
    for i, t in enumerate(texts):
        paragraphs = "".join(f"<p>{x}</p>" for x in t.split("\n"))
        other = texts[(i + 7) % len(texts)].split("\n")[1]
        html = page(
            ["<div class='cookie-notice'><p>We use cookies</p></div>", "<header><div>Site name</div></header>", "<div id=menu><a href=1>Home</a> <a href=2>News</a></div>"][i % 3]
            + [f"<main>{paragraphs}</main>", f"<div class='post-content'>{paragraphs}</div>", f"<div class='wrap'><div id='article-body'>{paragraphs}</div></div>"][i // 3 % 3]
            + [f"<aside class=sidebar><p>{other}</p></aside>", f"<section id='comments'><div class=comment><p>{other}</p></div></section>", "<form><label>Mail</label><button>Go</button></form>"][i // 2 % 3]
            + "<footer>&copy; Site</footer>"
        )
        found = bl.blocks(html)
        score = labeller.scores([found])[0]
        truth = [b.text in t.split("\n") for b in found]
        right += sum((s >= 0.5) == y for s, y in zip(score.tolist(), truth, strict=True))
        total += len(found)
    assert right / total > 0.95


def test_main_text_edge_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", page("<article><p>A text of an article, long enough to be one.</p></article>")), (3, "u", "plain words only"), (4, "u", "<div>" * 3000 + "deep"), (4, "u", page("<nav>x</nav>"))]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    got = bl.extract_main_text(pages).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert bl.extract_main_text(pages.limit(0)).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int, v int")


def odd_vectors(seed=1, n=400, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i, (centres[rng.integers(12)] * rng.uniform(0.5, 3) + rng.normal(size=dims) * rng.choice([0.05, 0.3, 1.0])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (900, None), (901, [0.0] * dims), (902, [float("nan")] * dims), (903, [float("inf")] + [1.0] * (dims - 1)), (904, [None] + [1.0] * (dims - 1)), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[5][1])]
    return rows


def is_valid(i, v):
    return i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("interval,run", [(4096, 128), (32, 8)])
def test_near_duplicates(spark, monkeypatch, interval, run):
    rows = odd_vectors()
    monkeypatch.setattr(go, "INTERVAL", interval)
    got = go.near_duplicates(vectors(spark, rows).repartition(3)).collect()
    good = [(k, np.array(v, np.float64)) for k, (i, v) in enumerate(rows) if is_valid(i, v)]
    links = {k: 0 for k in range(len(rows))}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (k, x) in enumerate(good):
        for l, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[k] += 1
                links[l] += 1
                root[find(k)] = find(l)
    want = []
    for k, (i, _) in enumerate(rows):
        comp = min(rows[j][0] for j in range(len(rows)) if find(j) == find(k)) if i is not None else None
        want.append((i, links[k], comp, i == comp))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert go.near_duplicates(vectors(spark, [])).collect() == []


def test_near_duplicates_of_many_intervals(spark, monkeypatch):
    # more intervals than one level of boxes holds: pairs are found level by level
    frame = vectors(spark, odd_vectors(2, 340))
    whole = sorted(map(tuple, go.near_duplicates(frame).collect()), key=repr)
    monkeypatch.setattr(go, "INTERVAL", 20)
    assert sorted(map(tuple, go.near_duplicates(frame).collect()), key=repr) == whole
    assert sum(r[1] for r in whole)


def test_join_intervals_with_short_runs(monkeypatch):
    monkeypatch.setattr(go, "RUN", 8)
    rng = np.random.default_rng(3)
    x = go.unit(np.repeat(rng.normal(size=(20, 10)), 9, axis=0) + rng.normal(size=(180, 10)) * 0.2)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    x = x[np.argsort(x @ axes[:, 0])]
    one = np.ones(90, np.int64)
    found = x @ x.T >= 0.9
    np.fill_diagonal(found, False)
    a, b, root = go.join_intervals(x[:90], x[90:], one, one, axes, 0.9)
    assert (a == found[:90, 90:].sum(1)).all() and (b == found[:90, 90:].sum(0)).all()
    own, _, _ = go.join_intervals(x[:90], None, one, one, axes, 0.9)
    assert (own == found[:90, :90].sum(1)).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[40].tolist()) for i in range(30)] + odd_vectors(n=0 + 10, dims=16)[-9:-3]
    frame = vectors(spark, rows).repartition(4)
    got = {}
    for r in lp.nearest_neighbours(frame, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.array(v, np.float64)) for i, v in rows if is_valid(i, v)]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = total = 0
    queries = ids[ids % 20 == 0]
    assert sorted(got) == sorted(queries.tolist())
    for q in queries:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        where = {int(i): float(v) for i, v in zip(ids, s, strict=True)}
        assert all(abs(where[i] - v) < 1e-9 for _, i, v in found)
        hit += len(set(ids[order].tolist()) & {i for _, i, _ in found})
        total += 20
    assert hit / total >= 0.9


def test_few_candidates_and_none(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [2.0, 0.0]), (21, [0.5])])
    got = sorted(map(tuple, lp.nearest_neighbours(few, "vec_id % 20 = 0").collect()))
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0)]
    assert lp.nearest_neighbours(few.limit(0), "vec_id % 20 = 0").collect() == []


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in frame.collect()}
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    got = {}
    for r in lp.nearest_neighbours(frame, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in got.items():
        s = m @ x[q]
        s[ids == q] = -np.inf
        hit += len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9


def test_recall_beyond_the_sample(spark):
    # a table of twelve samples: most rows and queries are none the router has seen
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    got = {}
    for r in lp.nearest_neighbours(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), "vec_id % 20 = 0", sample=512).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    m = x.astype(np.float64)
    hit = 0
    for q, found in got.items():
        s = m @ m[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 300 and all(len(f) == 20 for f in got.values())
    assert hit / 6000 >= 0.9


def test_small_parts_do_not_shorten_the_answer(spark, monkeypatch):
    # rows of a large first component are in part 0, all others in part 3
    router = lp.Router(4, 4)
    router.w = [np.zeros((4, lp.HIDDEN)), np.zeros(lp.HIDDEN), np.zeros((lp.HIDDEN, 4)), np.array([0, -1, -1, 0.001])]
    router.w[0][0, 0], router.w[1][0], router.w[2][0, 0] = 1, -0.995, 10
    monkeypatch.setattr(lp, "build_index", lambda *a: lp.Index(router, 4, 1, 1.0))
    x = np.random.default_rng(4).random((1000, 4))
    x[:60, 0] = 0.999 * (np.arange(60) % 20 == 0)
    assert 3 <= (x[:, 0] > 0.996).sum() < 20
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 40
    got = lp.nearest_neighbours(vectors(spark, rows), "vec_id % 20 = 0").groupBy("query_id").count().collect()
    assert len(got) == 50 and {r["count"] for r in got} == {20}


def test_partitions_are_balanced():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 8))
    graph = lp._nearest_rows(x, 8)
    part = lp.balanced_parts(x, graph, 10)
    assert np.bincount(part, minlength=10).max() <= 1.1 * 200 + 1
    same = (part[graph] == part[:, None]).mean()
    assert same > 0.2  # 0.1 by chance


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye é"), (1, 3, "ann", "Bye é"), (1, None, "bob", "first"), (1, 4, None, "who"),
        (2, 0, "system", "alone"), (None, 1, "ann", "x"), (None, 2, "bob", "y"), (3, 0, "ann", "z" * 100_000),
    ]
    frame = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, start int")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = con.execute(SQL["op9_perspective_rotation"])
    columns = [c[0] for c in result.description]
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    out = rotate_perspectives(frame)
    got = out.select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == want
    text = "".join(r["segment"] for r in sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: r["position"]))
    masked = [text[r["mask_start"] : r["mask_end"]] for r in got if r["conv_id"] == 1 and r["perspective"] == "ann" and r["trained"]]
    assert sorted(masked) == ["Bye é<|end|>\n", "Bye é<|end|>\n", "Hi<|end|>\n"]
    assert "<|user name=bob|>\nfirst" in text and "<|system|>\nBe kind." in text and "<|user name=unknown|>\nwho" in text
    assert not [r for r in got if r["conv_id"] == 2]
    assert rotate_perspectives(frame.limit(0)).collect() == []
