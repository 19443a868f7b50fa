"""Pairs of rows that meet in a bucket, in tasks of bounded size.

Rows have keys, one for each of several tables; rows with an equal key meet. Buckets with
the same members, as near copies make them in many tables, become one. A bucket of more
than a block of rows is dealt to blocks by a hash of its members, and every pair of its
blocks is a task, so a task holds two blocks at most, no row is left out, and no pair
leaves its task but as a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

#: Rows that a worker holds at once, besides one task; pairs that are looked at in one step.
CHUNK_ROWS, PAIRS = 8192, 1 << 16
TASK = ["bucket", "low", "high"]


def homes(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, homes``: the buckets of more than one row in which each row stands, by table, with their number of rows and least row.

    ``keys`` has rep, place (the table) and key, and a row has a key once. Members are
    compared by their number, their least and an exclusive or of hashes.
    """
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("all")).filter("c > 1")
    counts = scratch.put(counts, "buckets")
    first = counts.groupBy("c", "least", "all").agg(F.min("key").alias("bucket"))
    named = scratch.put(counts.join(first, ["c", "least", "all"]).select("key", "bucket", "c", "least"), "named")
    met = keys.join(named.hint("merge"), "key")
    return met.groupBy("rep").agg(F.collect_list(F.struct("place", "bucket", "c", "least")).alias("homes"))


def each_home(rows: DataFrame) -> DataFrame:
    """``rows`` once for each of their ``homes``, with bucket and c, its number of members."""
    own = rows.columns
    each = rows.withColumn("h", F.explode(F.array_distinct(F.transform("homes", lambda h: F.struct(h.bucket.alias("bucket"), h.c.alias("c"))))))
    return each.select(*own, "h.bucket", "h.c")


def deal(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (rep, bucket, c and what tasks need) once for each task, laid out by task: bucket, low, high and side.

    Side 2 is a block compared with itself; 0 and 1 are two blocks compared with each other.
    """
    own = [c for c in rows.columns if c not in ("bucket", "c")]
    parts = F.ceil(F.col("c") / block)
    placed = rows.select(*own, "bucket", F.pmod(F.xxhash64("rep"), parts).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("o"))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    dealt = placed.select(*own, "bucket", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), side.alias("side"))
    return dealt.repartition(*TASK).sortWithinPartitions(*TASK, "side")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tasks, small ones together, of a partition that ``deal`` laid out."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK_ROWS:
            table = pa.Table.from_batches(held)
            start = _starts(table)[-1]
            if start:
                yield table.slice(0, start)
            held, size = table.slice(start).to_batches(), table.num_rows - start
    if size:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> np.ndarray:
    """Where the tasks of a table begin."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for name in TASK:
        value = table.column(name).to_numpy()
        fresh[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(fresh)


def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs that the tasks of a chunk compare, in steps of about PAIRS."""
    n = table.num_rows
    start = _starts(table)
    end = np.append(start[1:], n)
    side = table.column("side").to_numpy()
    lefts = np.add.reduceat(side == 0, start)
    task = np.repeat(np.arange(len(start)), end - start)
    rows = np.arange(n)
    first = np.where(side == 2, rows + 1, np.where(side == 0, (start + lefts)[task], n))
    count = np.maximum(np.where(side == 1, 0, end[task] - first), 0)
    upto = np.cumsum(count)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        own = count[a:b]
        if own.any():
            i = np.repeat(rows[a:b], own)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[a:b], own)
        a = b


def stars(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all nodes but the roots of the components of the links (i, j)."""
    nodes, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]
