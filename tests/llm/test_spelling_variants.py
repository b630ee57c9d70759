"""Near words and their forms against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusqa.llm.spelling_variants import near_words, one_edit, spelling_variants, variant_groups


def one_off(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_off(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= 2 * n else None, n, len(near))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return sorted((w, f, root(w), n, k, counts[f] if f else None) for w, (f, n, k) in out.items())


def words_of(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=7), min_size=1, max_size=30))
def test_schemes_find_every_edit(words):
    words = sorted(words)
    points = np.array([ord(c) - 96 for w in words for c in w], np.int64)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    everyone, yes = np.arange(len(words)), np.ones(len(words), bool)
    a, b = one_edit(points, first, everyone, np.zeros(len(words), np.int64), yes, yes)
    got = {(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(x, y) for x in words for y in words if one_off(x, y) and (len(y) < len(x) or (len(x) == len(y) and x < y))}
    assert got == want


@pytest.mark.parametrize("group_letters,task_letters", [(1 << 16, 1 << 20), (60, 300), (1, 1)])
def test_near_words(spark, group_letters, task_letters):
    rng = random.Random(group_letters)
    words = {"".join(rng.choices("abé", k=rng.choice((1, 2, 3, 5, 6, 7, 8)))) for _ in range(160)}
    words |= {"shared" + "".join(rng.choices("xyzw", k=4)) for _ in range(60)}  # one half for all
    df = spark.createDataFrame([(w, "q") for w in words], "word string, m string").repartition(3)
    got = sorted((r["word"], r["near"]) for r in near_words(df, task_letters, group_letters).collect())
    assert got == sorted((a, b) for a in words for b in words if one_off(a, b))


def test_forms_and_roots(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 9, "abbbb": 20, "bbbbb": 39, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10, "lonely": 3}
    df = spark.createDataFrame(list(counts.items()) + [(None, 4)], "word string, n int")
    got = sorted(tuple(r) for r in variant_groups(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(counts)


def test_documents(spark):
    rng = random.Random(8)
    stems = ["Wörter", "colour", "color", "house", "houses", "Straße", "étéété", "spell", "spelt", "x", "ab", "multiplication"]
    docs = [(rng.choice((i, i % 5, None)), " ".join(rng.choices(stems, k=rng.choice((0, 3, 200))))) for i in range(80)]
    docs += [(1, None), (2, ""), (3, "12 ... 5"), docs[0], docs[0], (9, "houze " * 4000), (10, "a" * 3000 + " " + "a" * 2999 + "b"), (11, ("a" * 3000 + " ") * 3)]
    df = spark.createDataFrame([(*d, 1, [2]) for d in docs], "doc_id long, text string, n int, word array<int>").repartition(4)
    got = sorted(tuple(r) for r in spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(words_of(docs))
    assert spelling_variants(df.limit(0)).collect() == []
