"""Suffix-array dedup: bytes covered by a string of ``width`` bytes that starts elsewhere too.

A suffix array of a whole corpus does not fit one task, so the corpus is cut without
losing a match. The anchor of a position is the place of the least hash among the
24-byte grams of its next ``width`` bytes; equal strings have equal anchors at equal
distance. Positions in a row with one anchor form an interval, about 90 bytes long, and a
string can only recur in intervals whose anchor grams are equal. So:

1. equal texts become one text with a number of copies (all of it repeats);
2. intervals whose anchor gram occurs once are done: nothing in them recurs;
3. intervals that recur with all bytes that their positions reach recur whole;
4. the rest are cut into cells of 16 positions by distance from the anchor. All strings
   of a cell share 185 middle bytes, its core. The strings of cells with equal cores are
   laid end to end with the core as one symbol, and the suffix array of that text, built
   by linear grouping (``suffix``), tells which positions' windows recur.

Steps 2 and 3 only settle what hashes of 64 bits and more, within one anchor's group,
tell from counts; what hangs on single bytes is left to step 4. Tasks of step 4 hold
bounded blocks. A core with more than CROWD distinct strings, which could not be sorted in
one block, is settled by counting its windows, one row each.

Defined results: a null text is empty; texts shorter than ``width`` lose nothing;
repeated rows, with equal or different ids, are copies of each other; empty input gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Scratch, release
from quire.llm.suffix import repeated_windows

GRAM = 24
CELL = 16
CROWD = 4096
#: Text bytes of a bucket, and the most buckets that a table may have (Spark's own limit is 100,000).
BUCKET_BYTES, MAX_BUCKETS = 256 << 20, 100_000
#: Symbols sorted at once.
BLOCK = 1 << 16
U64 = np.uint64
SAME = np.arange(256, dtype=np.uint8)
LOW = U64(0xFFFFFFFF)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    padded = np.full(-(-len(v) // width) * width, ~U64(0))
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def intervals(piece: tk.Piece, width: int) -> dict[str, np.ndarray]:
    """Row, anchor hash, hash of all bytes reached, anchor, first and last position of each interval.

    Positions count from the start of the row's text.
    """
    total = len(piece.raw)
    if total < width:
        return {k: np.zeros(0, np.int64) for k in ("row", "key", "ext", "anchor", "lo", "hi")}
    prefix = tk.prefix_hash(piece.raw, SAME)
    grams = tk.span_hash(prefix, np.arange(total - GRAM + 1), np.arange(GRAM, total + 1))
    least = sliding_min((grams & ~LOW) | np.arange(len(grams), dtype=np.uint64), width - GRAM + 1)
    anchor = (least & LOW).astype(np.int64)
    row = np.repeat(np.arange(len(piece)), np.diff(piece.at))
    inside = row[: len(anchor)] == row[width - 1 : width - 1 + len(anchor)]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (row[1 : len(anchor)] != row[: len(anchor) - 1])
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(anchor)) - 1
    lo, hi = lo[inside[lo]], hi[inside[lo]]
    base = piece.at[row[lo]]
    return {"row": row[lo], "key": grams[anchor[lo]].view(np.int64), "ext": tk.span_hash(prefix, lo, hi + width).view(np.int64), "anchor": anchor[lo] - base, "lo": lo - base, "hi": hi - base}


def cells(raw: np.ndarray, spans: list[tuple[int, int, int, int]], width: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """(span id, cell, core hash, left bytes, right bytes) for each cell of spans (id, anchor, lo, hi)."""
    prefix = tk.prefix_hash(raw, SAME)
    body = raw.tobytes()
    ids, cell, start, lo, hi = [], [], [], [], []
    for span_id, anchor, first, last in spans:
        for t in range((anchor - last) // CELL, (anchor - first) // CELL + 1):
            ids.append(span_id)
            cell.append(t)
            start.append(anchor - CELL * t)
            lo.append(max(first, anchor - CELL * t - CELL + 1))
            hi.append(min(last, anchor - CELL * t))
    begin = np.array(start, np.int64)
    core = width - CELL + 1
    key = tk.mix(tk.span_hash(prefix, begin, begin + core) + np.array(cell, np.int64).astype(np.uint64) * tk.LANE[9]).view(np.int64).tolist()
    return [(i, t, k, body[a:s], body[s + core : b + width]) for i, t, k, a, b, s in zip(ids, cell, key, lo, hi, start, strict=True)]


def window_masks(strings: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """For strings (core group, left, right), a bit for each distance from the core at which the window recurs."""
    symbols, begins, at = [], [], 0
    for core, left, right in strings:
        part = np.empty(len(left) + len(right) + 2, np.int64)
        part[: len(left)] = np.frombuffer(left, np.uint8)
        part[len(left)] = 256 + core
        part[len(left) + 1 : -1] = np.frombuffer(right, np.uint8)
        part[-1] = -1
        begins.append(at)
        at += len(part)
        symbols.append(part)
    hit = repeated_windows(np.concatenate(symbols), CELL)
    masks = np.zeros(len(strings), np.int32)
    for k, (_, left, right) in enumerate(strings):
        for j in range(max(0, CELL - 1 - len(right)), len(left) + 1):
            if hit[begins[k] + len(left) - j]:
                masks[k] |= 1 << j
    return masks


def _pack(docs: DataFrame) -> DataFrame:
    """``id, a, b, n_bytes, sha, packed``: 128 bits that name a text, and the text compressed."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(5).cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([pack(t) for t in texts], pa.binary())], ["id", "a", "b", "n_bytes", "sha", "packed"])

    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text, F.length(text)).alias("b"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    return named.mapInArrow(run, "id long, a long, b long, n_bytes long, sha string, packed binary")


def _intervals(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                own = batch.slice(first, 512)
                bodies = pa.array([unpack(x) for x in own.column("packed").to_pylist()], pa.large_binary())
                a, b = (own.column(c).to_numpy() for c in "ab")
                done = 0
                for piece in tk.pieces(bodies):
                    x = intervals(piece, width)
                    row = x["row"] + done
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x["key"], x["ext"], a[row], b[row])] + [pa.array(x[c].astype(np.int32)) for c in ("anchor", "lo", "hi")], ["key", "ext", "a", "b", "anchor", "lo", "hi"])
                    done += len(piece)

    return texts.select("a", "b", "packed").mapInArrow(run, "key long, ext long, a long, b long, anchor int, lo int, hi int")


def _cells(texts: DataFrame, width: int) -> DataFrame:
    names = ["span", "cell", "core", "left", "right"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = np.frombuffer(unpack(packed), np.uint8)
                for k in range(0, len(spans), 4096):
                    found = cells(raw, [(s["span"], s["anchor"], s["lo"], s["hi"]) for s in spans[k : k + 4096]], width)
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

    return texts.select("packed", "spans").mapInArrow(run, "span long, cell int, core long, left binary, right binary")


def _sort(strings: DataFrame) -> DataFrame:
    """``core, left, right, mask`` of strings whose windows recur; in, strings come laid out and sorted by core.

    Strings of one core come in one task and stay in one block. No core here has more than CROWD strings.
    """
    names = ["core", "left", "right", "mask"]

    def settle(block: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        groups = {c: k for k, c in enumerate(dict.fromkeys(s[0] for s in block))}
        masks = window_masks([(groups[c], x, y) for c, x, y in block])
        found = [(c, x, y, int(m)) for (c, x, y), m in zip(block, masks.tolist(), strict=True) if m]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int32()))], names)

    def run(batches):
        block: list[tuple[int, bytes, bytes]] = []
        group: list[tuple[int, bytes, bytes]] = []
        size = 0
        for batch in batches:
            for s in zip(batch.column("core").to_pylist(), batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                if group and group[0][0] != s[0]:
                    if len(group) > 1:
                        block += group
                        size += sum(len(x) + len(y) + 2 for _, x, y in group)
                    group = []
                    if size >= BLOCK:
                        yield settle(block)
                        block, size = [], 0
                group.append(s)
        if len(group) > 1:
            block += group
        if block:
            yield settle(block)

    return strings.select("core", "left", "right").mapInArrow(run, "core long, left binary, right binary, mask int")


def _count_windows(strings: DataFrame) -> DataFrame:
    """The result of ``_sort`` for crowded cores, by counting windows, a row for each."""
    j = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(CELL - 1) - F.length("right")), F.length("left"))).alias("j")
    each = strings.select("core", "left", "right", j)
    window = F.concat(F.substr(F.col("left"), F.length("left") - F.col("j") + 1, F.col("j")), F.substr(F.col("right"), F.lit(1), F.lit(CELL - 1) - F.col("j")))
    each = each.withColumn("window", window)
    often = each.groupBy("core", "j", "window").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return each.join(often, ["core", "j", "window"]).groupBy("core", "left", "right").agg(F.sum(F.expr("shiftleft(1, j)")).cast("int").alias("mask"))


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """``a, b, n_removed, n_spans, kept_sha256, removed`` from texts with the positions that recur."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, copies, marks in zip(batch.column("packed").to_pylist(), batch.column("copies").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                body = unpack(packed)
                edge = np.zeros(len(body) + 1, np.int32)
                if copies > 1 and len(body) >= width:
                    edge[0], edge[-1] = 1, -1
                for m in marks or ():
                    if m["cells"] is None:
                        edge[m["lo"]] += 1
                        edge[m["hi"] + width] -= 1
                    for c in m["cells"] or ():
                        start = m["anchor"] - CELL * c["cell"]
                        for j in range(CELL):
                            if c["mask"] >> j & 1:
                                edge[start - j] += 1
                                edge[start - j + width] -= 1
                gone = (np.cumsum(edge)[:-1] > 0).view(np.int8)
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).tolist()
                spans = list(zip(turn[::2], turn[1::2], strict=True))
                kept = hashlib.sha256(np.frombuffer(body, np.uint8)[gone == 0].tobytes()).hexdigest()
                rows.append((int(gone.sum()), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
            out = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), span))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *out], ["a", "b", "n_removed", "n_spans", "kept_sha256", "removed"])

    return texts.mapInArrow(run, "a long, b long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")


def repeated_bytes(docs: DataFrame, *, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, removed`` (byte spans) for each row."""
    if width < GRAM + CELL:
        raise ValueError(f"width must be at least {GRAM + CELL}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    packed = _pack(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    rows = scratch.put(packed.select("id", "a", "b", "n_bytes", "sha"), "rows")
    # Texts are laid out once by name in a bucketed table, so later steps join them where they lie; buckets follow the bytes.
    weight = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // BUCKET_BYTES)))
    name = f"quire_texts_{uuid.uuid4().hex}"
    try:
        return _repeated(spark, scratch, packed, rows, name, parts, width)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _repeated(spark: SparkSession, scratch: Scratch, packed: DataFrame, rows: DataFrame, name: str, parts: int, width: int) -> DataFrame:
    """The result from ``rows`` and the texts, which are put into the table ``name``."""
    distinct = packed.select("a", "b", "packed").groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed"))
    distinct.write.bucketBy(parts, "a", "b").option("path", f"{scratch.root}/texts").format("parquet").saveAsTable(name)
    texts = spark.table(name)
    release(spark)
    found = scratch.put(_intervals(texts, width), "intervals")
    # Counts are written before they are joined: a join of two plain exchanges is one whose hot keys Spark splits.
    often = scratch.put(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "often")
    again = scratch.put(found.join(often.hint("merge"), "key"), "again")
    scratch.drop("intervals", "often")
    release(spark)
    # One row stands for all places of an interval with equal bytes.
    kinds = again.groupBy("key", "ext").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "anchor", "lo", "hi")).alias("r"))
    kinds = scratch.put(kinds.withColumn("span", F.monotonically_increasing_id()), "kinds")
    mixed = scratch.put(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "mixed")
    spans = kinds.join(mixed.hint("merge"), "key").select("r.*", "span").groupBy("a", "b").agg(F.collect_list(F.struct("span", "anchor", "lo", "hi")).alias("spans"))
    pieces = scratch.put(_cells(texts.join(spans.hint("merge"), ["a", "b"]), width), "cells")
    release(spark)
    strings = pieces.groupBy("core", "left", "right").agg(F.count(F.lit(1)).alias("n"))
    strings = scratch.put(strings, "strings")
    size = scratch.put(strings.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "sizes")
    # Spark may split a join's hot partition by rows, so what it gives is written and then laid out by core.
    several = scratch.put(strings.join(size.filter(F.col("c").between(2, CROWD)).select("core").hint("merge"), "core"), "several")
    release(spark)
    crowded = strings.join(size.filter(F.col("c") > CROWD).select("core").hint("merge"), "core")
    masks = scratch.put(_sort(several.repartition("core").sortWithinPartitions("core")).union(_count_windows(crowded)), "masks")
    scratch.drop("several")
    release(spark)
    # A string that stands in several intervals recurs at all its positions, whatever the sort says of it.
    every = F.expr(f"(shiftleft(1, length(left) + 1) - 1) & ~(shiftleft(1, greatest(0, {CELL - 1} - length(right))) - 1)")
    sure = strings.filter("n > 1").select("core", "left", "right", every.alias("mask"))
    best = scratch.put(masks.union(sure).groupBy("core", "left", "right").agg(F.max("mask").alias("mask")), "best")
    marked = pieces.join(best.hint("merge"), ["core", "left", "right"]).groupBy("span").agg(F.collect_list(F.struct("cell", "mask")).alias("cells"))
    whole = F.col("n") > 1
    flags = scratch.put(kinds.join(marked.hint("merge"), "span", "left").filter(whole | F.col("cells").isNotNull()).select("key", "ext", F.when(~whole, F.col("cells")).alias("cells")), "flags")
    scratch.drop("cells", "strings", "masks", "mixed", "sizes", "best")
    release(spark)
    marks = again.join(flags.hint("merge"), ["key", "ext"]).groupBy("a", "b").agg(F.collect_list(F.struct("anchor", "lo", "hi", "cells")).alias("marks"))
    cut = texts.join(marks.hint("merge"), ["a", "b"], "left").filter("marks is not null or copies > 1").select("a", "b", "copies", "packed", "marks")
    results = scratch.put(_cut(cut, width), "results")
    scratch.drop("again", "kinds", "flags")
    scratch.drop("texts")
    release(spark)
    joined = rows.join(results.hint("merge"), ["a", "b"], "left")
    return joined.select("id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    return repeated_bytes(docs).drop("removed").withColumnRenamed("id", "doc_id").withColumns({c: F.col(c).cast("long") for c in ("n_bytes", "n_removed", "n_spans")})
