"""N-gram Jaccard join and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from corpusqa.llm import shingle_join as sj
from corpusqa.llm import substring_dedup as sd
from corpusqa.llm import textbytes as tb
from corpusqa.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d if not sets[i] else None))
    return sorted(out, key=repr)


def corpus(seed, groups=12, members=6, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    passage = " ".join(rng.choices(vocab, k=40))
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice((6, 30, words)))
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            body = " ".join(text)
            rows.append((n, body if g % 3 else body + "\n" + passage))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "oNE  two"), (n + 5, "three"), (n + 6, "be " * 3000), (n + 7, "BE " * 2000)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (n + 8, "ÉtÉ " * 9)]
    return rows


def frame(spark, rows, extra=True):
    if extra:
        return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, set_id string, n_shingles int")
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    rows = corpus(seed)
    got = sj.jaccard_components(frame(spark, rows).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_large_bucket_by_blocks(spark, monkeypatch):
    # every bucket goes through block comparison, cut into small blocks
    monkeypatch.setattr(sj, "NAMED_PAIRS", 1)
    monkeypatch.setattr(sj, "BLOCK", 4)
    rows = corpus(3, groups=4, members=15)
    got = sj.jaccard_components(frame(spark, rows, False)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_jaccard_empty_table(spark):
    assert sj.jaccard_components(frame(spark, [], False)).collect() == []


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_linked_sets_share_a_signature(monkeypatch, percent):
    monkeypatch.setattr(sj, "CLASS_FROM", (4, 12))
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(6):
        base = rng.integers(1, 1 << 40, int(rng.integers(50, 400)))
        for _ in range(20):
            keep = base[rng.random(len(base)) > rng.random() * 0.15]
            sets.append(np.unique(np.concatenate([keep, rng.integers(1, 1 << 40, int(rng.integers(0, len(base) // 8)))])).astype(np.uint64))
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    signed = []
    for s in sets:
        df = counts[np.searchsorted(values, s)]
        order = np.lexsort((s, df))
        shared = df[order] > 1
        signed.append(set(sj.signatures(s[order][shared], df[order][shared], len(s), percent)))
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                linked += 1
                assert signed[i] & signed[j]
    assert linked > 20


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for ab in links if ab[0] != ab[1] for x in ab}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_removed(rows, size):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_remove_repeats(spark):
    rows = corpus(5)
    rows.append((900, "a b c d e f g " * 40))
    sent = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, chunk string, kind int").repartition(3)
    got = sd.remove_repeats(sent, size=35).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got), key=repr)
    assert found == brute_removed(rows, 35)


def test_remove_repeats_keeps_columns_and_clean_texts(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, "a  clean\ttext", "x", None), (2, "one " + shared + " end", "y", 5), (3, shared, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = {r["doc_id"]: r for r in sd.remove_repeats(docs.withColumnRenamed("n_words", "m"), keep=("lang", "m"), leave_clean=True).collect()}
    assert got[1]["kept_text"] == "a  clean\ttext" and got[1]["lang"] == "x" and got[1]["m"] is None
    assert got[2]["kept_text"] == "one end" and got[2]["n_removed"] == 50 and got[2]["m"] == 5
    assert got[3]["kept_text"] == "" and got[3]["lang"] is None
    assert sd.remove_repeats(docs.limit(0)).collect() == []


def test_word_hashes():
    texts = ["a b  c", "", "ab\nc été", "x" * 2_000_000 + " y", "a b c"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = tb.word_bounds(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in WORD.findall(t)]
    assert np.diff(first).tolist() == [len(WORD.findall(t)) for t in texts]
    h = tb.hash_runs(data, starts, ends).tolist()
    assert len({*zip(words, h, strict=True)}) == len(set(words)) == len(set(h))
    hashes, counts = tb.windows(tb.hash_runs(data, starts, ends), first, 3)
    assert counts.tolist() == [1, 0, 1, 0, 1] and hashes[0] == hashes[2] != hashes[1]
    assert (tb.unpack48(tb.pack48(np.array([0, 1, (1 << 48) - 1], np.uint64))) == [0, 1, (1 << 48) - 1]).all()


def test_words_with_equal_polynomials_do_not_repeat(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join(x[k] for k in bits) for x in ("ab", "ba"))
    texts = [" ".join([f"w{i}" for i in range(20)] + [w] + [f"v{i}" for i in range(20)]) for w in (a, b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r["n_removed"] for r in sd.remove_repeats(df).collect()] == [0, 0]
    near = spark.createDataFrame([(1, f"{a} q r s t"), (2, f"{b} q r s t")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in sj.jaccard_components(near).collect()) == [(1, 1), (2, 2)]


def test_windows_with_one_first_hash():
    hashes, checks = np.array([5, 5, 5, 1, 5], np.uint64), np.array([1, 2, 1, 9, 2], np.uint64)
    order, same = sd._ranked(hashes, checks)
    assert sorted(zip(hashes[order].tolist(), checks[order].tolist(), same.tolist(), strict=True)) == [
        (1, 9, False), (5, 1, False), (5, 1, True), (5, 2, False), (5, 2, True)]
