"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, the stems of its words (their first four,
five and six bytes, as endings vary), adjacent pairs and pairs with one word between
them, hashed to 2**20 places. FTRL keeps a rate for every coordinate and
an L1 term that leaves most weights at exactly zero, so the model is a short list of
(place, weight) that is broadcast with a proven bound of 2**20 places.

Fitting is sequential, so it uses a bounded sample: the MAX_ROWS labelled documents that
come first by a hash of their id, and of those, in that order, as many as hold MAX_FEATURES features.
Features are extracted on all executors; one task fits. Every text is scored whole.

Defined results: null and empty texts have no features and get the bias alone as
score; rows with null labels, or labels other than 0 and 1, are not learned from;
repeated labels of an id each count; without labelled rows every score is the prior
0 < p < 0.5. Scores read nothing but the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import free_name, give_back, small_batches, with_text_result

PLACES = 1 << 20
MAX_ROWS = 20_000
MAX_FEATURES = 40_000_000
EMPTY_BIAS = -2.0
#: (words apart, lane): adjacent pairs, and pairs around one word.
PAIRS = ((1, 7), (2, 11))
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Ftrl:
    """Hyperparameters of FTRL-proximal."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 6


def features(piece: tk.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a piece, with repeats, and the row of each."""
    w = tk.words(piece, tk.ALNUM)
    n = len(w.hash)
    row = np.repeat(np.arange(len(piece)), w.counts)
    hashes, rows = [tk.mix(w.hash)], [row]
    if n:
        for size in STEMS:
            long = np.flatnonzero(w.end - w.start >= size)
            hashes.append(tk.mix(tk.chunk_hash(piece.raw, w.start[long], w.start[long] + size) * tk.LANE[20 + size]))
            rows.append(row[long])
    for gap, lane in PAIRS:
        if n > gap:
            same = row[gap:] == row[:-gap]
            hashes.append(tk.mix(w.hash[:-gap] * tk.LANE[lane] + w.hash[gap:] * tk.LANE[lane + 1])[same])
            rows.append(row[gap:][same])
    return (np.concatenate(hashes) >> np.uint64(44)).astype(np.int64), np.concatenate(rows)


def distinct(place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * PLACES + place)
    return key % PLACES, key // PLACES


def fit(rows: list[np.ndarray], labels: np.ndarray, how: Ftrl) -> tuple[np.ndarray, float]:
    """Weights of all places and the bias, by passes over the rows in their order."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    bias = PLACES

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)
        w[np.abs(zi) <= how.l1] = 0
        w[-1] = -zi[-1] / ((how.beta + np.sqrt(n[bias])) / how.alpha)  # the bias is not shrunk
        return w

    for _ in range(how.epochs):
        for x, y in zip(rows, labels.tolist(), strict=True):
            at = np.append(x, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            was = n[at]
            z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / how.alpha * w
            n[at] += g * g
    w = weights(np.arange(PLACES + 1))
    return w[:PLACES], float(w[bias])


def train(docs: DataFrame, labels: DataFrame, *, how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) learned from labelled rows; ``learn`` filters labels by their id."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.filter(learn) if learn is not None else known
    order = F.xxhash64(F.lit(4), F.col(id_col).cast("string"))
    known = known.join(docs.select(F.col(id_col).alias("_doc")).filter("_doc is not null"), F.col(id_col) == F.col("_doc"), "left_semi")
    sample = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), order.alias("_order")).orderBy("_order", "_id", "_y").limit(MAX_ROWS)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_order", "_y", "_text")

    def extract(batches):
        for batch in batches:
            first = 0
            for piece in tk.pieces(batch.column(2)):
                place, row = distinct(*features(piece))
                at = pa.array(np.searchsorted(row, np.arange(len(piece) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(piece)) for k in (0, 1)), pa.ListArray.from_arrays(at, pa.array(place, pa.int32()))], ["_order", "_y", "places"])
                first += len(piece)

    def learn_from(batches):
        rows, total = [], 0
        for batch in batches:
            lists = batch.column(2)
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            flat = lists.flatten().to_numpy()
            for o, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                total += b - a
                if total <= MAX_FEATURES:  # in order of the hash, so what is left out does not hang on length
                    rows.append((o, y, flat[a:b].copy()))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        if rows:
            w, bias = fit([r[2] for r in rows], np.array([r[1] for r in rows], float), how)
            rows = []
            give_back()
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(w[used], bias))], ["place", "weight"])

    found = texts.mapInArrow(extract, "_order long, _y int, places array<int>").repartition(1).sortWithinPartitions("_order", "_y").mapInArrow(learn_from, "place long, weight double").toPandas()
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0), EMPTY_BIAS
    bias = float(found.weight[found.place == -1].iloc[0])
    found = found[found.place >= 0]
    return found.place.to_numpy(), found.weight.to_numpy(), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text", result: str = "toxic_score") -> DataFrame:
    """``docs`` with the probability of label 1 as column ``result``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def judge(texts: pa.Array) -> pa.Array:
        places, weights, bias = shared.value
        dense = np.zeros(PLACES)
        dense[places] = weights
        used, out = dense != 0, []
        for piece in tk.pieces(texts):
            place, row = features(piece)
            hit = used[place]
            place, row = distinct(place[hit], row[hit])
            total = np.bincount(row, dense[place], len(piece)) + bias
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return with_text_result(docs, text_col, result, "double", judge)


def held_out(id_col: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether a document is kept from learning; a null id is never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    model = train(docs, labels, learn=~held_out(F.col("doc_id")))
    scored = score(docs.select("doc_id", "text"), model, result="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, *, limit: float = 0.5) -> DataFrame:
    """``docs`` in its own columns without those scored at ``limit`` or above."""
    name = free_name(docs, "_toxic_score")
    scored = score(docs, train(docs, labels), result=name)
    return scored.filter(F.col(name) < limit).drop(name)
