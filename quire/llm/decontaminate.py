"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of ASCII digits, letters (A-Z taken as a-z) and non-ASCII
characters. A window is ``size`` consecutive item words, or the whole item if it
has fewer words but not none. Training texts are scanned window by window;
every hash hit is verified on the words themselves.

What is broadcast is bounded whatever the benchmark's size: items go by slices of at most
MAX_SLICE_ITEMS and about MAX_SLICE_BYTES, items of more than PART_WORDS words in parts that
share ``size - 1`` words with the next. A benchmark of one slice takes one pass over the
texts. Of a larger one, each slice is broadcast alone, its hits are written by the text's
hash, and it is freed before the next; the hits of all slices are then joined to the texts.

Defined results: a null or empty text has no words and no hits; a null item text
has no windows; items without an id mark words as hit but are not listed;
repeated rows are scored one by one; a repeated item_id is one item; extra columns
of either input do not matter, and one named as the result is replaced. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Scratch, free_name, own_columns, small_batches, with_text_result, without

RESULT = "struct<n_words:long,n_hit:long,n_full:long,item_ids:array<string>,spans:array<struct<start:int,end:int>>>"
#: A word, before A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bounds of what is broadcast; larger benchmarks are scanned in slices of this size.
MAX_SLICE_ITEMS = 50_000
MAX_SLICE_BYTES = 8 << 20
PART_WORDS = 100_000
#: Items of fewer words are found, but nothing is cut out for them: ordinary text holds them by chance.
SPECIFIC = 5


class WindowIndex:
    """Windows of benchmark items by length: sorted hashes, where the words of each stand, and its items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.size = size
        self.ids = [i for i, _ in items]
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        raws, starts, ends, hashes, words, length = [], [], [], [], 0, 0
        for piece in tk.pieces(pa.array([t for _, t in items], pa.large_string()), 1 << 20):
            w = tk.words(piece, tk.ALNUM)
            for n in np.unique(np.minimum(w.counts, size)).tolist():
                if n:
                    h, begin = tk.windows(w, n)
                    row = tk.row_of(w.at, begin)
                    whole = np.minimum(w.counts, size)[row] == n
                    parts[n].append((h[whole], begin[whole] + words, row[whole] + piece.first))
            raws.append(tk.LOWER[piece.raw].tobytes())
            starts.append(w.start + length)
            ends.append(w.end + length)
            hashes.append(w.hash)
            words, length = words + len(w.hash), length + len(piece.raw)
        self.raw = b"".join(raws)
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        each = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, found in parts.items():
            h, begin, item = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, begin, item = h[order], begin[order], item[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[1:] != h[:-1]
            for k in range(n):  # unlike windows that share a hash stay apart
                fresh[1:] |= each[begin[1:] + k] != each[begin[:-1] + k]
            first = np.flatnonzero(fresh)
            self.lengths[n] = h[first], begin[first], np.append(first, len(h)), item

    def spelled(self, begin: int, n: int) -> bytes:
        return b" ".join(self.raw[a:b] for a, b in zip(self.start[begin : begin + n].tolist(), self.end[begin : begin + n].tolist(), strict=True))


def _scan(piece: tk.Piece, index: WindowIndex) -> Iterator[tuple[int, int, int, list[str], list[dict]]]:
    w = tk.words(piece, tk.ALNUM)
    cover = np.zeros(len(w.hash) + 1, np.int32)
    full = np.zeros(len(piece), np.int64)
    ids: dict[int, set[str]] = defaultdict(set)
    low = None
    for n, (hashes, first, cut, owners) in index.lengths.items():
        h, begin = tk.windows(w, n)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        maybe = np.flatnonzero(hashes[at] == h)
        if not len(maybe):
            continue
        low = tk.LOWER[piece.raw].tobytes() if low is None else low
        rows = tk.row_of(w.at, begin[maybe])
        for k, row in zip(maybe.tolist(), rows.tolist(), strict=True):
            b, j = int(begin[k]), int(at[k])
            text = b" ".join(low[s:e] for s, e in zip(w.start[b : b + n].tolist(), w.end[b : b + n].tolist(), strict=True))
            while j < len(hashes) and hashes[j] == h[k]:  # several windows may share a hash
                if index.spelled(int(first[j]), n) == text:
                    cover[b] += 1
                    cover[b + n] -= 1
                    full[row] += n == index.size
                    ids[row].update(index.ids[i] for i in owners[cut[j] : cut[j + 1]].tolist())
                j += 1
    hit = np.cumsum(cover)[:-1] > 0
    for row in range(len(piece)):
        a, b = int(w.at[row]), int(w.at[row + 1])
        own = hit[a:b]
        spans = []
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            spans = [{"start": int(w.start[a + s] - piece.at[row]), "end": int(w.end[a + e - 1] - piece.at[row])} for s, e in zip(edge[::2], edge[1::2], strict=True)]
        yield b - a, int(own.sum()), int(full[row]), sorted(ids.get(row, set()) - {None}), spans


def _parts(items: DataFrame, size: int) -> DataFrame:
    """``item, text`` with long items as several rows whose windows are those of the whole."""

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = [text]
                if text and len(text) > PART_WORDS:
                    piece = next(tk.pieces(pa.array([text], pa.large_string())))
                    w = tk.words(piece, tk.ALNUM)
                    ends = np.append(w.end, len(piece.raw))
                    begins = range(0, max(1, len(w.hash) - size + 1), PART_WORDS)
                    pieces = [piece.raw[w.start[a] : ends[min(a + PART_WORDS + size - 1, len(w.hash)) - 1]].tobytes().decode() if len(w.hash) else "" for a in begins]
                ids += [item] * len(pieces)
                rows += pieces
            for k in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 16], pa.string()), pa.array(rows[k : k + 16], pa.string())], ["item", "text"])

    return items.mapInArrow(run, "item string, text string")


def slices(benchmark: DataFrame, item_col: str, text_col: str, size: int, scratch: Scratch) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """How many slices the benchmark has, and they, read one at a time; rows and bytes of each are bounded."""
    items = _parts(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")), size)
    items = scratch.put(items, "items")
    n, weight = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // MAX_SLICE_ITEMS), -(-weight // MAX_SLICE_BYTES))
    if parts == 1:
        return 1, iter([[tuple(r) for r in items.collect()]])
    parts *= 2  # hashing deals slices unevenly
    keyed = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    return parts, ([tuple(r)[:2] for r in keyed.filter(F.col("part") == k).collect()] for k in range(parts))


def annotate(docs: DataFrame, benchmark: DataFrame, *, size: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", result: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``result``: words, words hit, full-length windows
    hit, items found, byte spans hit."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = without(docs, result)
    parts, found = slices(benchmark, item_col, item_text_col, size, scratch)
    if parts == 1:
        return _annotate_once(docs, spark.sparkContext.broadcast(WindowIndex(next(found), size)), text_col, result)
    key = F.sha2(F.col(text_col).cast("string"), 256)
    kind = None
    for k, items in enumerate(found):
        index = spark.sparkContext.broadcast(WindowIndex(items, size))
        hits = _annotate_once(docs.select(F.col(text_col).cast("string").alias("text")), index, "text", "h").filter("h.n_hit > 0")
        kind = scratch.put(hits.select(F.sha2("text", 256).alias("key"), "h.n_full", "h.item_ids", "h.spans").dropDuplicates(["key"]), f"hits/{k}").schema
        index.destroy()
    every = spark.read.schema(kind).parquet(f"{scratch.root}/hits/*")
    merged = every.groupBy("key").agg(F.sum("n_full").alias("n_full"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), _merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"))
    name = free_name(docs, "_merged")
    merged = scratch.put(merged, "merged").select(F.col("key").alias(f"{name}_key"), F.struct("n_full", "item_ids", "spans").alias(name))
    joined = docs.join(merged, key == F.col(f"{name}_key"), "left")
    at, none = F.col(name), F.array()
    spans = F.coalesce(at.spans, none.cast("array<struct<start:int,end:int>>"))
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    value = F.struct(words.alias("n_words"), _count_words(F.col(text_col), spans).alias("n_hit"), F.coalesce(at.n_full, F.lit(0)).cast("long").alias("n_full"), F.coalesce(at.item_ids, none.cast("array<string>")).alias("item_ids"), spans.alias("spans"))
    return joined.select(*own_columns(docs), value.alias(result))


def _annotate_once(docs: DataFrame, index, text_col: str, result: str) -> DataFrame:
    names = ("n_words", "n_hit", "n_full", "item_ids", "spans")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    def judge(texts: pa.Array) -> pa.Array:
        rows = [dict(zip(names, r, strict=True)) for p in tk.pieces(texts) for r in _scan(p, index.value)]
        return pa.array(rows, pa.struct(list(zip(names, kinds, strict=True))))

    return with_text_result(docs, text_col, result, RESULT, judge)


def _merge_spans(spans):
    """Sorted, disjoint spans."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))
        return F.when((F.size(acc) > 0) & (x.start < F.try_element_at(acc, F.lit(-1)).end), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, step)


def _count_words(text, spans):
    """How many words lie in byte spans of ``text``."""
    raw = F.encode(text, "UTF-8")
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + F.regexp_count(F.decode(F.substr(raw, x.start + 1, x.end - x.start), "UTF-8"), F.lit(WORD)))


def digest(docs: DataFrame, benchmark: DataFrame, *, size: int = 8, min_items: int = 2, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query's contract, one row per row of ``docs``."""
    hits = annotate(docs.select(id_col, "text"), benchmark, size=size)
    n = F.size("hits.item_ids")
    return hits.select(
        id_col, F.col("hits.n_words").alias("n_words"), F.col("hits.n_hit").alias("n_hit"), n.cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.item_ids"), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, size: int = 8) -> DataFrame:
    """``docs`` without its benchmark passages, in the same columns.

    A document that holds a window of ``size`` words goes whole; one that only holds
    shorter items loses just those words, and none for items of fewer than SPECIFIC words,
    which ordinary text holds by chance.
    """
    name = free_name(docs, "hits")
    specific = benchmark.filter(F.regexp_count(F.col("text"), F.lit(WORD)) >= min(size, SPECIFIC))
    hits = annotate(docs, specific, size=size, result=name)
    spans = F.col(name).spans
    raw = F.encode(F.col("text"), "UTF-8")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x.end))
    starts = F.concat(F.transform(spans, lambda x: x.start), F.array(F.octet_length("text")))
    kept = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.decode(F.substr(raw, x.a + 1, x.b - x.a), "UTF-8")), "")
    text = F.when(F.size(spans) > 0, kept).otherwise(F.col("text"))
    return hits.filter(F.col(name).n_full == 0).select([text.alias("text") if c == "text" else own for c, own in zip(docs.columns, own_columns(docs), strict=True)])


#: The contract in plain SQL, for tables whose doc_id is unique.
ORACLE_SQL = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS s
  FROM bench, unnest(range(1, greatest(1, len(w) - 7) + 1)) t(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (
  SELECT x.doc_id, x.i, x.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM doc, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) t(i)) x
  JOIN win ON win.n = x.n AND win.s = x.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN hit ON hit.doc_id = doc.doc_id LEFT JOIN items ON items.doc_id = doc.doc_id
"""
