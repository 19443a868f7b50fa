"""Embedding near-duplicates by collision-counting projections.

Vectors of one label are compared. Each unit vector is projected on many random lines.
Two vectors at the threshold lie ``d = sqrt(2 - 2 t)`` apart, so on a line they differ by
a normal number with deviation ``d``. Two uses are made of that:

- Who meets. The projections are sorted into windows of ``WINDOW * d`` on groups of lines,
  and a window of a group (the same place on all its lines) is a bucket. A group has as
  many lines as leave a vector few unlike companions in its bucket, so it depends on the
  logarithm of the largest label, and there are as many groups as lose a pair at the
  threshold with probability MISS at most. Work grows with the vectors times their
  companions, not with pairs.
- Who is verified. Those that meet count their collisions: on how many of LINES other lines
  one falls into the window centred on the other. The count that a pair must reach
  is the largest that loses a pair at the threshold with probability MISS at most; pairs
  that reach it are verified by their cosine in double precision.

Equal vectors of a label form one class first and cost nothing further. Buckets are dealt
to tasks of bounded size (``meetings``), which return the number of links of each vector
and stars, never the pairs. A pair that meets in several buckets is counted in the least.

Defined results: a null label, or a vector that is null, empty, zero, or holds null or
non-finite components, is linked with nothing and kept. Vectors of different length
are not compared. Vectors are scaled by powers of two before they are multiplied, so neither
very large nor very small components matter. Rows that repeat an id with an equal vector are one class member
each and count as other vectors. Empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import meetings
from quire.llm import textkit as tk
from quire.llm.common import Scratch
from quire.llm.graph import components

LINES = 20
#: Half a window, in deviations of a pair at the threshold.
HALF_WINDOW = 1.75
MISS = 1e-6
#: Width of the windows in which vectors meet, in deviations, and unlike companions that a vector may have.
WINDOW, COMPANIONS = 10.0, 0.1
#: Vectors of a bucket in a block; a task holds one or two blocks.
BLOCK = 1024


def lines(width: int, count: int = LINES, seed: int = 9) -> np.ndarray:
    """Directions as columns; the same for every task."""
    return np.random.Generator(np.random.PCG64([width, seed])).standard_normal((width, count))


def deviation(threshold: float) -> float:
    """How far apart a pair at the threshold lies."""
    return max(1e-4, math.sqrt(max(0.0, 2 - 2 * threshold)))


def _together(window: float, apart: float) -> float:
    """The probability that two vectors lie in one window of a line."""
    x = window / apart
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """Lines of a group, and groups, for labels of at most ``largest`` vectors."""
    d = deviation(threshold)
    near, far = _together(WINDOW * d, d), _together(WINDOW * d, math.sqrt(2))
    each = max(1, math.ceil(math.log(max(largest, 2) / COMPANIONS) / -math.log(far)))
    return each, math.ceil(math.log(MISS) / math.log1p(-(near**each)))


def needed(miss: float = MISS, count: int = LINES, half: float = HALF_WINDOW) -> int:
    """Collisions that a pair at the threshold reaches with probability 1 - miss."""
    p = math.erf(half / math.sqrt(2))
    below = 0.0
    for k in range(count + 1):
        below += math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if below > miss:
            return k
    return count


def _prepare(vectors: DataFrame) -> DataFrame:
    """``id, label, width, vec_key, x`` (scaled) of the vectors that can link (id, label, x)."""

    def run(batches):
        for batch in batches:
            ids, labels, raw = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for vec_id, label, v in zip(ids, labels, raw, strict=True):
                if vec_id is None or label is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, float)
                most = float(np.abs(x).max())
                if np.isfinite(x).all() and most > 0:
                    key = tk.mix((x + 0.0).view(np.uint64) + np.arange(len(x), dtype=np.uint64) * tk.LANE[3])
                    name = np.array([tk.mix(key).sum(dtype=np.uint64), tk.mix(key ^ tk.LANE[4]).sum(dtype=np.uint64)]).tobytes()
                    rows.append((vec_id, label, len(x), name, np.ldexp(x, -math.frexp(most)[1])))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "label", "width", "vec_key", "x"])

    return vectors.mapInArrow(run, "id long, label string, width int, vec_key binary, x array<double>")


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros after the shorter ones, and their lengths."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, size


def _project(x: np.ndarray, size: np.ndarray, count: int, seed: int) -> np.ndarray:
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    out = np.zeros((len(x), count))
    for width in np.unique(size).tolist():
        own = size == width
        out[own] = unit[own, :width] @ lines(width, count, seed)
    return out


def places(x: np.ndarray, size: np.ndarray, each: int, groups: int, threshold: float) -> np.ndarray:
    """A key for each vector and group: its window on the lines of the group."""
    shift = np.random.Generator(np.random.PCG64([each, groups])).random(each * groups)
    at = np.floor(_project(x, size, each * groups, 11) / (WINDOW * deviation(threshold)) + shift).astype(np.int64).view(np.uint64).reshape(len(x), groups, each)
    h = np.arange(groups, dtype=np.uint64) * tk.LANE[6] + size.astype(np.uint64)[:, None] * tk.LANE[7]
    for k in range(each):
        h = tk.mix(h * tk.LANE[8] + at[:, :, k])
    return h


def _keys(classes: DataFrame, each: int, groups: int, threshold: float) -> DataFrame:
    """``rep, label, keys`` of classes (rep, label, x)."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                own = batch.slice(first, 1024)
                keys = places(*_padded(own.column(2)), each, groups, threshold).view(np.int64).reshape(-1)
                ends = pa.array(np.arange(0, len(keys) + 1, groups, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.ListArray.from_arrays(ends, pa.array(keys))], ["rep", "label", "keys"])

    return classes.select("rep", "label", "x").mapInArrow(run, "rep long, label string, keys array<long>")


def _homes(lists: pa.Array, groups: int) -> np.ndarray:
    """The bucket of each row and group, zero where it meets no one."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), groups), np.int64)
    flat = lists.flatten()
    out[np.repeat(np.arange(len(size)), size), flat.field("place").to_numpy(zero_copy_only=False)] = flat.field("bucket").to_numpy(zero_copy_only=False)
    return out


def find_links(x: np.ndarray, seen: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that collide on enough lines and then have the threshold's cosine."""
    half = HALF_WINDOW * deviation(threshold) + 1e-9
    often = (np.abs(seen[i] - seen[j]) <= half).sum(axis=1) >= needed()
    i, j = i[often], j[often]
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    cosine = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], x[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0)]) / (norm[i] * norm[j])
    return i[cosine >= threshold], j[cosine >= threshold]


def _links(rows: DataFrame, groups: int, threshold: float) -> DataFrame:
    """``kind, a, b``: kind 0 adds b links to class a; kind 1 links two classes. ``rows``: rep, homes, copies, x."""

    def run(batches):
        for table in meetings.chunks(batches):
            rep, copies, bucket = (table.column(c).to_numpy() for c in ("rep", "copies", "bucket"))
            x, size = _padded(table.column("x").combine_chunks())
            seen, home = _project(x, size, LINES, 9), _homes(table.column("homes").combine_chunks(), groups)
            more = np.zeros(len(rep), np.int64)
            ends = [(np.zeros(0, int),) * 2]
            for i, j in meetings.pairs(table):
                i, j = find_links(x, seen, i, j, threshold)
                both = home[i]
                both = np.where((both == home[j]) & (both != 0), both, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
                first = both == bucket[i]
                i, j = i[first], j[first]
                np.add.at(more, i, copies[j])
                np.add.at(more, j, copies[i])
                ends.append(meetings.stars(i, j))
            some = np.flatnonzero(more)
            x, y = meetings.stars(*(np.concatenate(e) for e in zip(*ends, strict=True)))
            a, b = np.concatenate((rep[some], rep[x])), np.concatenate((more[some], rep[y]))
            yield pa.RecordBatch.from_arrays([pa.array((np.arange(len(a)) >= len(some)).astype(np.int64)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    return meetings.deal(meetings.each_home(rows), BLOCK).mapInArrow(run, "kind long, a long, b long")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, n_links, component_id`` for each row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "collision")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    ready = scratch.put(_prepare(rows), "vectors")
    # Ids that stand for several vectors stay apart until the last step by numbering classes.
    classes = scratch.put(ready.groupBy("label", "width", "vec_key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x")).withColumn("rep", F.xxhash64("label", "width", "vec_key")), "classes")
    largest = classes.groupBy("label", "width").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    each, groups = plan(largest, threshold)
    # Keys of unlike labels or widths are unlike, too (64-bit hashes).
    keys = _keys(classes, each, groups, threshold).select("rep", F.posexplode("keys").alias("place", "key"), "label").select("rep", "place", F.xxhash64("label", "place", "key").alias("key"))
    met = meetings.homes(keys, scratch).join(classes.select("rep", "copies", "x").hint("merge"), "rep")
    found = scratch.put(_links(met, groups, threshold), "found")
    more = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("more"))
    members = ready.select("id", F.xxhash64("label", "width", "vec_key").alias("rep"))
    # Nodes of the graph are class members with the least id; a link joins two of them.
    least = classes.select("rep", F.col("least").alias("node"))
    ends = found.filter("kind = 1").join(least.withColumnRenamed("rep", "a").withColumnRenamed("node", "x"), "a").join(least.withColumnRenamed("rep", "b").withColumnRenamed("node", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    own = members.join(least, "rep").filter("id != node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    several = ready.groupBy("id").count().filter("count > 1").limit(1).count()
    parts = components(ends.union(own) if several else ends, scratch, "parts")
    of_class = classes.select("rep", "least", "copies").join(parts, classes.least == parts.node, "left").join(more, classes.rep == more.a, "left").select("rep", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    linked = members.join(of_class, "rep").select("id", "n_links", "component_id")
    whole = F.col("x").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf)) & F.exists("x", lambda c: c != 0)
    alone = rows.filter(~F.coalesce(whole, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone)


def digest(vectors: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    found = near_duplicates(vectors)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The contract in plain SQL, for tables whose vec_id is unique and whose vectors are whole.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND list_dot_product(x, x) > 0 AND isfinite(list_dot_product(x, x))),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id
"""
