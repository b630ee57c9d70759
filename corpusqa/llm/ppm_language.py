"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3 with escape probabilities (a context
that saw q different symbols in n bytes escapes with q / (n + q)). The statistics are frozen
after training, so the exact code length of a byte in a context is a number of a table: a text
is scored by adding up, for every language, the table entries of all its bytes. Tables hold
what was seen, for all 256 bytes and every context; the rest is reached by escapes.

Training takes a bounded sample of labelled rows: of each language the TRAIN_DOCS ids whose hashes
come first, of each an equal share of TRAIN_BYTES of text. Prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm import textbytes as tb
from corpusqa.operators.joins import top_per_key

TRAIN_DOCS = 256  # documents of a language
TRAIN_BYTES = 1 << 20  # of text of a language
ORDERS = 4  # contexts of 0 to 3 bytes
BASE = 257  # 0: before the start, then the bytes
UNKNOWN = "und"
_PIECE_BYTES = 1 << 18

HELD_OUT = 2  # remainder of crc32(doc_id) modulo 4 that is never learned from


@dataclass
class Model:
    """For each order the contexts that were seen and what an escape from them costs in each language, and the
    contexts with a byte behind them and what that byte costs there, all in bits and sorted by key."""

    languages: list[str]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    grams: list[np.ndarray]
    costs: list[np.ndarray]


def _keys(symbols: np.ndarray) -> np.ndarray:
    """Four symbols as one number; ``symbols`` has three before the first byte."""
    return ((symbols[:-3] * BASE + symbols[1:-2]) * BASE + symbols[2:-1]) * BASE + symbols[3:]


def train(texts: dict[str, list[bytes]]) -> Model:
    """Context trees of each language from its sample."""
    languages = sorted(texts)
    seen = []
    for name in languages:
        parts = [np.concatenate([np.zeros(3, np.int64), np.frombuffer(t, np.uint8).astype(np.int64) + 1]) for t in texts[name]]
        seen.append(np.unique(np.concatenate([np.zeros(0, np.int64), *map(_keys, parts)]), return_counts=True))
    model = Model(languages, [], [], [], [])
    for order in range(ORDERS):
        size = BASE ** (order + 1)
        grams = np.unique(np.concatenate([np.zeros(0, np.int64), *[g % size for g, _ in seen]]))
        contexts, row = np.unique(grams // BASE, return_inverse=True)
        counts = np.zeros((len(grams), len(languages)))
        for k, (g, c) in enumerate(seen):
            np.add.at(counts[:, k], np.searchsorted(grams, g % size), c)
        n, q = np.zeros((2, len(contexts), len(languages)))
        np.add.at(n, row, counts)
        np.add.at(q, row, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            # a context this language never saw costs no escape
            escapes = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
            known = -np.log2(counts / (n + q)[row])
        below = model.costs[-1][np.searchsorted(model.grams[-1], grams % BASE**order)] if order else 8.0
        model.costs.append(np.where(counts > 0, known, escapes[row] + below))
        model.contexts.append(contexts)
        model.escapes.append(escapes)
        model.grams.append(grams)
    model.costs = [c.astype(np.float32) for c in model.costs]
    model.escapes = [e.astype(np.float32) for e in model.escapes]
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each wanted key among the sorted ``keys``."""
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return place, keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _costs(model: Model, keys: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each key under each language."""
    out = np.zeros((len(keys), len(model.languages)), np.float32)
    left = np.arange(len(keys))
    for order in reversed(range(ORDERS)):
        gram = keys[left] % BASE ** (order + 1)
        place, found = _find(model.grams[order], gram)
        out[left[found]] += model.costs[order][place[found]]
        left, gram = left[~found], gram[~found]
        place, found = _find(model.contexts[order], gram // BASE)
        out[left[found]] += model.escapes[order][place[found]]
    out[left] += 8.0  # a byte that no sample has
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row under each language."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not model.languages:
        return out
    for lo, hi in tb.spans(offsets, _PIECE_BYTES):
        base, end = int(offsets[lo]), int(offsets[hi])
        for a in range(base, end, _PIECE_BYTES):  # a very long text goes through in parts
            b = min(end, a + _PIECE_BYTES)
            back = min(3, a - base)
            s = np.concatenate([np.zeros(3 - back, np.int64), data[a - back : b].astype(np.int64) + 1])
            one, two, three = s[2:-1].copy(), s[1:-2].copy(), s[:-3].copy()
            edges = offsets[lo:hi]
            for at, behind in ((0, (one, two, three)), (1, (two, three)), (2, (three,))):
                spots = edges + at - a
                spots = spots[(spots >= 0) & (spots < b - a)]
                for x in behind:
                    x[spots] = 0  # a text does not see the one before it
            costs = _costs(model, ((three * BASE + two) * BASE + one) * BASE + s[3:])
            starts = np.maximum(offsets[lo:hi] - a, 0)
            ends = np.minimum(offsets[lo + 1 : hi + 1] - a, b - a)
            rows = np.flatnonzero(ends > starts)
            if len(rows):
                out[lo + rows] += np.add.reduceat(costs, starts[rows], axis=0, dtype=np.float64)
    return out


@tb.tidy
def _predict(batches: Iterator[pa.RecordBatch], model, with_text: bool) -> Iterator[pa.RecordBatch]:
    tb.make_room()
    m: Model = model.value
    names = np.array([*m.languages, UNKNOWN], dtype=object)
    for batch in batches:
        data, offsets = tb.flat(batch.column(1))
        letters = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        bits = code_lengths(m, data, offsets)
        if m.languages:
            best = bits.argmin(1)
            gap = bits - bits[np.arange(len(bits)), best][:, None]
            score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
            size = np.maximum(np.diff(offsets), 1)
            per_byte = bits[np.arange(len(bits)), best] / size
        else:
            best, score, per_byte = np.zeros(len(bits), np.int64), np.zeros(len(bits)), np.zeros(len(bits))
            letters = np.zeros(len(bits), bool)
        best = np.where(letters, best, len(m.languages))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, per_byte, 0.0)), *([batch.column(1)] if with_text else []), *batch.columns[3:]],
            names=["doc_id", "lang_pred", "score", "bits_per_byte", *(["text"] if with_text else []), *batch.schema.names[3:]],
        )


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def fit(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, bytes_per_language: int = TRAIN_BYTES) -> Model:
    """Train on the sample of ``docs`` (doc_id, text, lang). Rows without a lang, an id or a text and
    held-out rows are never learned from; a language of which only those exist is unknown."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        "lang is not null and doc_id is not null and text is not null and text <> ''"
    ).filter(~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a row for each language; a few times the wanted number of ids pass, however many there are
    counts = F.broadcast(labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")))
    near = labelled.join(counts, "lang").filter(place * F.col("n") <= 4.0 * docs_per_language * (1 << 30)).select("lang", "doc_id").distinct()
    chosen = top_per_key(near, ["lang"], [place, F.col("doc_id")], docs_per_language).select("lang", "doc_id")
    # at most docs_per_language ids of each language, and of each id one text, cut to its share
    share = max(1, bytes_per_language // docs_per_language)
    rows = labelled.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(F.expr(f"left(text, {share})")).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["doc_id"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass")[:share])
    return train(texts)


def identify(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte, and the columns ``keep``) for every row.

    ``docs`` has doc_id and text, and lang where no model is given. ``score`` is the chance of the
    predicted language among all, were they equally likely. A text that is null or has no letter
    is ``und`` with score 0, as is every text where nothing could be learned. Null and repeated
    ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs) if model is None else model
    tb.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    # a text that is kept goes to the workers once
    with_text = "text" in keep and docs.schema["text"].dataType.simpleString() == "string"
    others = {c: f"_keep_{i}" for i, c in enumerate(keep) if not (with_text and c == "text")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("_letters"), *[F.col(c).alias(n) for c, n in others.items()])
    kinds = (", text string" if with_text else "") + "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in others.items())
    out = rows.mapInArrow(partial(_predict, model=sent, with_text=with_text), "doc_id long, lang_pred string, score double, bits_per_byte double" + kinds)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte", *[F.col(others[c]).alias(c) if c in others else F.col("text") for c in keep])
