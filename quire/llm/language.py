"""Language ID by multilingual mixture inference.

Each language is a smoothed distribution over hashed byte trigrams of letter words,
counted over all training texts. A document is a mixture: every word comes
from one language, with its trigrams' likelihood. Expectation-maximisation estimates
the proportions; languages are then removed, least first, while the likelihood
penalised by half a log word count per language does not fall.

Defined results: null texts and texts without letters are ``und`` with score 0; null
languages are not learned from; without training rows every text is ``und``. Repeated
rows count and are predicted one by one. Predictions read nothing but the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import small_batches, with_text_result
from quire.llm.toxicity import held_out

PLACES = 1 << 16
#: The model holds this many languages at most (256 KB each, broadcast); more is an error, not a cut.
MAX_LANGUAGES = 1000
SMOOTHING = 0.5
STEPS, RESTEPS = 12, 5


def trigrams(piece: tk.Piece) -> tuple[np.ndarray, tk.Words, np.ndarray]:
    """Trigram places of a piece, its words, and the word of each trigram.

    The word is read with one boundary on either side, so a word of n bytes has n
    trigrams: two bytes before the last included, boundaries for what is missing.
    """
    w = tk.words(piece, tk.LETTERS)
    length = w.end - w.start
    word = np.repeat(np.arange(len(length)), length)
    low = tk.LOWER[piece.raw].astype(np.int64)
    at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(w.start, length)
    begins = at == w.start[word]
    ends = at == w.end[word] - 1
    before = np.where(begins, 0, low[np.maximum(at - 1, 0)])
    after = np.where(ends, 0, low[np.minimum(at + 1, len(low) - 1)]) if len(low) else low
    code = (before << 16) | (low[at] << 8) | after
    return (tk.mix(code.astype(np.uint64)) >> np.uint64(48)).astype(np.int64), w, word


def counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang, packed``: trigram counts over all texts, a row of PLACES 64-bit numbers for each language."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, first = batch.column(0).to_pylist(), 0
            for piece in tk.pieces(batch.column(1)):
                place, w, word = trigrams(piece)
                row = tk.row_of(w.at, word)
                own = langs[first : first + len(piece)]
                names = sorted(set(own))
                code = np.searchsorted(names, own)
                for k, name in enumerate(names):
                    mine = place[code[row] == k]
                    totals[name] = totals.get(name, 0) + np.bincount(mine, minlength=PLACES)
                first += len(piece)
            if len(totals) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for name, n in totals.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["lang", "place", "n"])

    def pack(table: pa.Table) -> pa.Table:
        n = np.zeros(PLACES, np.int64)
        n[table.column("place").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "packed": pa.array([n.tobytes()], pa.binary())})

    found = docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang string, place int, n long")
    return found.groupBy("lang", "place").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(pack, "lang string, packed binary")


def train(docs: DataFrame, *, learn: Column | None = None, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each trigram place in each."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = counts(known.filter(learn) if learn is not None else known, lang_col, text_col)
    table, langs = np.zeros((PLACES, 0), np.float32), []
    columns = []
    for name, packed in found.orderBy("lang").toLocalIterator():
        n = np.frombuffer(packed, np.int64) + SMOOTHING
        columns.append(np.log(n / n.sum()).astype(np.float32))
        langs.append(name)
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return langs, np.stack(columns, axis=1) if columns else table


def _em(likely: np.ndarray, at: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of rows after ``steps`` from ``share``, and the log likelihood of each row. Rows are not empty."""
    n = np.diff(at)
    total = None
    for _ in range(steps):
        r = np.repeat(share, n, axis=0) * likely
        total = r.sum(axis=1)
        r /= total[:, None]
        share = np.add.reduceat(r, at[:-1], axis=0) / n[:, None]
    total = (np.repeat(share, n, axis=0) * likely).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), at[:-1])


def infer(likelihood: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Language proportions of rows; ``likelihood`` has a row for each word, ``at`` cuts them into documents."""
    langs = likelihood.shape[1]
    likely = np.exp(likelihood - likelihood.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    share, value = _em(likely, at, np.full((len(at) - 1, langs), 1 / langs), STEPS)
    penalty = 0.5 * np.log(np.maximum(np.diff(at), 2))
    live = np.ones(len(at) - 1, bool)
    for _ in range(langs - 1):
        rows = np.flatnonzero(live)
        if not len(rows):
            break
        masked = np.where(share[rows] > 0, share[rows], np.inf)
        least = masked.argmin(axis=1)
        fewer = share[rows].copy()
        fewer[np.arange(len(rows)), least] = 0
        fewer /= fewer.sum(axis=1, keepdims=True)
        size = np.diff(at)[rows]
        cut = np.concatenate(([0], np.cumsum(size)))
        words = np.repeat(at[rows] - cut[:-1], size) + np.arange(cut[-1])
        new, worth = _em(likely[words], cut, fewer, RESTEPS)
        better = worth + penalty[rows] >= value[rows]
        share[rows[better]], value[rows[better]] = new[better], worth[better]
        live[rows[~better]] = False
        live &= (share > 0).sum(axis=1) > 1
    return share


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``language``: lang, score, and the proportions of the selected languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])

    def judge(texts: pa.Array) -> pa.Array:
        langs, table = shared.value
        out = []
        for piece in tk.pieces(texts, 1 << 17):
            place, w, word = trigrams(piece)
            own = [{"lang": "und", "score": 0.0, "shares": []} for _ in range(len(piece))]
            rows = np.flatnonzero(w.counts > 0)
            if langs and len(rows):
                firsts = np.searchsorted(word, np.arange(len(w.hash)))
                value = np.add.reduceat(table[place], firsts, axis=0)
                at = np.append(w.at[:-1][rows], len(w.hash))
                for r, p in zip(rows.tolist(), infer(value, at), strict=True):
                    if _has_letter(piece.raw[piece.at[r] : piece.at[r + 1]]):
                        best = int(p.argmax())
                        own[r] = {"lang": langs[best], "score": float(min(1.0, p[best])), "shares": [(langs[k], float(p[k])) for k in np.flatnonzero(p > 0)]}
            out += own
        return pa.array(out, kind)

    return with_text_result(docs, text_col, "language", "struct<lang:string,score:double,shares:map<string,double>>", judge)


def _has_letter(raw: np.ndarray) -> bool:
    """ASCII letters decide at once; other characters are looked up."""
    low = raw | 0x20
    if ((low >= 0x61) & (low <= 0x7A) & (raw < 0x80)).any():
        return True
    return any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs, learn=~out & F.col("doc_id").isNotNull())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
