"""The conversation trie against brute force, split by joins and in tasks."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpusqa.llm.prefix_trie import conversation_trie


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, node string, size int").repartition(4)


def result(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def sample(seed, convs=60, long_one=90):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), *range(100, 130), 300, 305, -7, -100]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice((t, t, t, None)), rng.choice(("u", "a", None)), rng.choice(("hi", "é" * 3, "", None, "long " * 40))))
    rows += [(7, 1000 + t, "u", "same") for t in range(long_one)]  # a deep chain
    rows += [(c, 1, "u", "copy") for c in range(400, 460)]  # a group of copies
    rows += [rows[3], rows[3], (None, 1, "u", "lost"), (500, None, None, None)]
    return rows


@pytest.mark.parametrize("small,task", [(1 << 16, 1 << 18), (8, 40)])
def test_trie(spark, small, task):
    rows = sample(1) if small > 8 else sample(2, 20, 30)
    got = conversation_trie(table(spark, rows), small, task)
    assert result(got) == brute(rows)


def test_empty(spark):
    df = table(spark, sample(1, 2)).limit(0)
    assert conversation_trie(df).collect() == []
    assert conversation_trie(table(spark, [(None, 1, "u", "x")])).collect() == []


def test_only_turnless(spark):
    # conversations whose own turns are all replaced by none
    rows = [(c, 0, "u", "x") for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6]
    assert result(conversation_trie(table(spark, rows))) == brute(rows)
