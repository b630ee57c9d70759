"""Token files, merge replay and packing against the libraries and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusqa.llm import bitpack, slack_packing
from corpusqa.llm.encoding import cuts, library_encoder, read_vocabulary
from corpusqa.llm.merge_replay import MergeReplay, decode_ids, encode_texts, replay_encoder

ODD = ["", " ", "  a", "a \n b", "a 　b  \n\n c", "don't 'll 12 3½ 你好 \U0001f600!!  ", "\x1c a\x1f b \x85 c", "<|endoftext|> x", "café é Été\t\tz", "aaaaaaaaaaaa" * 50, "x" * 5000, "ab " * 3000, "\r\n \r\n", "  a b"]


def docs(spark, extra=False):
    rng = random.Random(3)
    words = ["the", "of", "Anblewh", "sttible,", "énée", "12.5", "!!", "\n", "  ", "don't"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.choice((1, 40, 900)))) for _ in range(60)]
    rows = [(i * 3 % 61, t) for i, t in enumerate(texts)] + [(500, None), (7, texts[1]), (7, texts[1])]
    return rows, spark.createDataFrame([(d, t, "c", 0) for d, t in rows], "doc_id long, text string, ids string, start int").repartition(4)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, counts = encoder.rows(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


LIBRARY, REPLAY = [], []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 　ab'é́s1你"), st.characters(exclude_categories=("Cs",))), max_size=40), max_size=5))
def test_stretches_give_the_same_ids(texts):
    if not LIBRARY:
        t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        LIBRARY.append((library_encoder(read_vocabulary(P.path("byte_bpe_50k.json"))), t))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
        REPLAY.append((replay_encoder(P.PATTERN.encode() + b"\n" + read_vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})))
    texts = texts + ["end"]
    assert encoded(LIBRARY[0][0], texts) == [LIBRARY[0][1].encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(REPLAY[0][0], texts) == [REPLAY[0][1].encode_ordinary(t) for t in texts]


def test_replay_is_exact_where_a_merge_makes_a_lower_rank():
    # "abc" is lower than "ab", which it can be made of; "xx" overlaps itself
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 256, b"ab": 257, b"xx": 258, b"xxx": 259, b"cab": 260}
    replay = MergeReplay(ranks)

    def one(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(1)
    words = [bytes(rng.choices(b"abcx", k=rng.randrange(1, 14))) for _ in range(800)]
    assert replay.words(words) == [one(w) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 1 << 31), st.integers(0, 9000), st.integers(0, 1000))
def test_bits_round_trip(vocabulary, n, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, vocabulary, n).astype(np.uint32)
    raw = bitpack.pack_file(ids, vocabulary)
    assert (bitpack.read_ids(raw) == ids).all()
    a = int(rng.integers(0, n + 1))
    k = int(rng.integers(0, n - a + 1))
    assert (bitpack.read_ids(raw, a, k) == ids[a : a + k]).all()
    assert len(raw) <= 28 + 8 * (n // bitpack.BLOCK_IDS + 2) + (n + 64) * bitpack.bits_for(vocabulary) / 8
    with pytest.raises(IndexError):
        bitpack.read_ids(raw, a, n - a + 1)
    with pytest.raises(ValueError):
        bitpack.pack_file(np.array([vocabulary]), vocabulary)


def test_token_files(spark, library, monkeypatch):
    monkeypatch.setattr(bitpack, "SHARD_BYTES", 1 << 14)
    rows, frame = docs(spark)
    got = bitpack.token_files(frame, read_vocabulary(P.path("byte_bpe_50k.json"))).orderBy("start").collect()
    start = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())), strict=True):
        ids = np.array([*library(t), 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert bitpack.token_files(frame.limit(0), read_vocabulary(P.path("byte_bpe_50k.json"))).collect() == []


def test_merge_replay(spark, multi):
    rows, frame = docs(spark)
    ranks = read_vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    got = decode_ids(encode_texts(frame, ranks, P.PATTERN), ranks).collect()
    want = []
    for d, t in rows:
        ids = np.array(multi.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), (t or "").encode()))
    assert sorted((r["doc_id"], r["n_tokens"], hashlib.sha256(bytes(r["ids"])).hexdigest(), bytes(r["decoded"])) for r in got) == sorted(want)
    assert encode_texts(frame.limit(0), ranks, P.PATTERN).collect() == []


def brute_fill(lengths, capacity):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(1, 90))
def test_best_fill(lengths, capacity):
    counts = Counter(lengths)
    got = slack_packing.best_fill(sorted(counts, reverse=True), counts, capacity)
    assert sum(n * k for n, k in got.items()) == brute_fill(lengths, capacity)
    assert all(k <= counts[n] for n, k in got.items())


def test_plan_uses_everything():
    rng = random.Random(2)
    histogram = Counter(rng.randrange(1, 2048) for _ in range(5000)) + Counter({77: 4000})
    left, sequences = Counter(histogram), 0
    for pattern, times in slack_packing.plan(histogram):
        assert sum(n * k for n, k in pattern.items()) <= 2048
        left.subtract({n: k * times for n, k in pattern.items()})
        sequences += times
    assert not any(left.values())
    total = sum(n * c for n, c in histogram.items())
    assert sequences <= 1.005 * total / 2048 + 3


@pytest.mark.parametrize("size", [64, 2048])
def test_pack_sequences(spark, library, size):
    rows, frame = docs(spark)
    got = slack_packing.pack_sequences(frame, read_vocabulary(P.path("byte_bpe_50k.json")), size=size).collect()
    whole = Counter()
    for d, t in rows:
        ids = np.array([*library(t), 1], "<u4")
        for a in range(0, len(ids), size):
            part = ids[a : a + size]
            whole[d, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == whole
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= sum(r["length"] for r in got) // size + 3
    assert slack_packing.pack_sequences(frame.limit(0), read_vocabulary(P.path("byte_bpe_50k.json"))).collect() == []


def test_cuts_are_after_characters_that_are_no_space():
    raw = "a b  c é d　 e".encode()
    at = cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[i : i + 2] for i in at] == [b"a ", b" b", b" \xc3", b" d"]


def parity_words():
    """Two different words of 1,024 letters whose polynomial sums modulo 2**64 are equal."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_equal_polynomials_stay_apart(spark, library, multi):
    a, b = parity_words()
    rows = [(1, f"x {a} y"), (2, f"x {b} y"), (3, " ".join(["w"] * 20 + [a] + ["w"] * 20)), (4, " ".join(["w"] * 20 + [b] + ["w"] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ranks = read_vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    got = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in decode_ids(encode_texts(df, ranks, P.PATTERN), ranks).collect()}
    for d, t in rows:
        assert got[d] == (np.array(multi.encode_ordinary(t), "<u4").tobytes(), t.encode())
    assert encoded(library_encoder(read_vocabulary(P.path("byte_bpe_50k.json"))), [t for _, t in rows]) == [library(t) for _, t in rows]


def test_equal_hashes_are_told_apart_by_bytes(library, monkeypatch):
    from corpusqa.llm import textbytes as tb

    real, calls = tb.word_hashes, []

    def poor(data, starts, ends, constants=tb.FIRST):
        # few first hashes, of texts of different lengths only; those of one length by the second
        calls.append(1)
        return real(data, starts, ends, constants) if constants is tb.SECOND else (ends - starts).astype(np.uint64) % np.uint64(3)

    monkeypatch.setattr(tb, "word_hashes", poor)
    encoder = library_encoder(read_vocabulary(P.path("byte_bpe_50k.json")))
    texts = ["a few different words and <|endoftext|> here", "more of them, and more"]
    assert encoded(encoder, texts) == [library(t) for t in texts] and calls
