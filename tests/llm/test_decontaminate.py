"""Benchmark decontamination against brute force on odd texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from corpusqa.llm.decontaminate import contamination, remove_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute(docs, items, size):
    grams = {}
    for item, text in items:
        w = WORD.findall(lowered(text or ""))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text or ""))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                owners = grams.get(tuple(w[i : i + n]))
                if owners is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        listed = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocabulary = ["a", "Be", "été", "9", "the", "ÉTÉ", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 4, 9))))) for i in (3, 20, 100, 7)]
    items += [(7, "the a the a"), (None, "9 9 9 9"), (8, None), (9, ""), (10, " .,! "), (11, items[0][1])]
    docs = [(i, " - ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 5, 40))))) for i in range(60)]
    docs += [(1, docs[4][1]), (None, docs[4][1]), (None, None), (5, ""), (6, "..."), (70, "9!" * 3000), (71, "THE, A\nthe (A)!")]
    docs += [(80 + i % 2, "9 9 9 9 9") for i in range(30)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(a, b, 1.5, {"k": 1}) for a, b in docs], "doc_id long, text string, n_hit double, digest map<string,int>")
    return d.repartition(5), spark.createDataFrame([(a, b, "z") for a, b in items], "item_id long, text string, gram string")


@pytest.mark.parametrize("size", [4, 10])
def test_contamination(spark, tables, size):
    docs, items = tables
    d, b = frames(spark, docs, items)
    got = [tuple(r) for r in contamination(d, b, size).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=repr) == brute(docs, items, size)


def test_beyond_the_broadcast_bound(spark, tables, monkeypatch):
    import corpusqa.llm.decontaminate as module

    docs, items = tables
    d, b = frames(spark, docs, items)
    monkeypatch.setattr(module, "fits_broadcast", lambda df: False)
    got = [tuple(r) for r in contamination(d, b, 4).collect()]
    assert sorted(got, key=repr) == brute(docs, items, 4)


def test_empty_tables(spark, tables):
    d, b = frames(spark, *tables)
    assert contamination(d.limit(0), b).collect() == []
    got = contamination(d, b.limit(0)).collect()
    assert len(got) == len(tables[0]) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in got)


def test_remove_documents_and_spans(spark, tables):
    docs, items = tables
    d, b = frames(spark, docs, items)
    clean = [(r[0], t) for r, (_, t) in zip([x for x in docs], docs, strict=True) if not brute([(0, t)], items, 4)[0][5]]
    out = remove_contaminated(d, b, "documents", 4)
    assert out.columns == d.columns
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == sorted(clean, key=repr)

    def stripped(text):
        w = [m.span() for m in WORD.finditer(text)]
        words = [lowered(text[a:z]) for a, z in w]
        hit = set()
        grams = [WORD.findall(lowered(t or "")) for _, t in items]
        grams = [g[i : i + 4] for g in grams for i in range(max(1, len(g) - 3) if g else 0)]
        for g in grams:
            for i in range(len(words) - len(g) + 1):
                if words[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
        if not hit:
            return text
        ends = [a for a, _ in w[1:]] + [len(text)]
        return text[: w[0][0]] + "".join(text[a:e] for k, ((a, _), e) in enumerate(zip(w, ends, strict=True)) if k not in hit)

    out = remove_contaminated(d, b, "spans", 4)
    assert out.columns == d.columns and out.schema["digest"].dataType == d.schema["digest"].dataType
    want = sorted([(i, None if t is None else stripped(t)) for i, t in docs], key=repr)
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == want


def test_no_python_in_the_plan(spark, tables):
    plan = contamination(*frames(spark, *tables))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
