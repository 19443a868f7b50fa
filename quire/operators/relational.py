"""Checks on keys, chains and trees as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.shared import Scratch


def first_match(value: Column, signatures: list[tuple[str | bytes, str]], default: str | None) -> Column:
    """The label of the first signature that ``value`` starts with."""
    out = F
    for prefix, label in signatures:
        out = out.when(F.startswith(value, F.lit(prefix)), label)
    return out.otherwise(default)


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; the order's columns tell rows of a key apart.

    A partial aggregate, not a window: only one row of a key leaves each task.
    """
    whole = F.struct(*[c for c in rows.columns])
    picked = rows.groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def repeated(rows: DataFrame, key: list[str], count: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def chain_breaks(rows: DataFrame, group: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows whose start is not the end of the row before them, which is ``expected``."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("expected", F.lag(end).over(window)).filter(F.col("expected").isNotNull() & (F.col(start) != F.col("expected")))


def overlaps(rows: DataFrame, group: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows that begin before the ``furthest`` end of the rows before them."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("furthest", F.max(end).over(window)).filter(F.col(start) < F.col("furthest"))


def _on(left: DataFrame, right: DataFrame, key: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in key.items()])


def dangling(left: DataFrame, right: DataFrame, key: dict[str, str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right, _on(left, right, key), "left_anti")


def existing(left: DataFrame, right: DataFrame, key: dict[str, str]) -> DataFrame:
    """Rows of ``left`` with a partner."""
    return left.join(right, _on(left, right, key), "left_semi")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks, columns by place; nulls are equal."""
    on = reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in zip(left.columns, right.columns, strict=True)])
    return left.join(right, on, "left_anti").distinct()


def first_seen_members(rows: DataFrame, group: list[str], member: Column, position: Column) -> DataFrame:
    """Distinct members of each group in the order of their first position, and the number of rows.

    Members are made distinct before they are gathered, so a group holds each once.
    """
    seen = rows.groupBy(*group, member.alias("_m")).agg(F.min(position).alias("_at"), F.count(F.lit(1)).alias("_n"))
    gathered = seen.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_all"), F.sum("_n").alias("n"))
    return gathered.select(*group, F.transform("_all", lambda x: x["_m"]).alias("members"), "n")


def exact_copies(rows: DataFrame, id_col: str, payload: str) -> DataFrame:
    """Rows whose payload occurs more than once: id, the first id, the number of copies.

    Hashes of 256 bits and lengths pick the rows, so only those that may be copies are
    shuffled with their payload; they are grouped by the payload itself.
    """
    hashed = rows.select(id_col, F.col(payload).alias("_payload"), F.sha2(F.col(payload).cast("binary"), 256).alias("_h"))
    several = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_h")
    likely = hashed.join(several, "_h", "left_semi")
    groups = likely.groupBy("_h", "_payload").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return likely.join(groups, ["_h", "_payload"]).select(id_col, "first_id", "copies")


def first_listed(rows: DataFrame, group: list[str], value: str, most: int) -> DataFrame:
    """How many rows a group has (``total``), and its ``most`` smallest values (``first``)."""
    window = Window.partitionBy(*group).orderBy(value)
    listed = rows.select(*group, value).withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= most)
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    return listed.groupBy(*group).agg(F.array_sort(F.collect_list(value)).alias("first")).join(totals, group)


def clamp_levels(rows: DataFrame, group: list[str], order: list[str], level: str) -> DataFrame:
    """``rows`` with ``written``: a level, but at most one more than what was written before it in its group.

    In closed form, so no group is gathered: levels cap those after them, each by its distance.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    place = F.row_number().over(window)
    lowest = F.min(F.col(level) - F.col("_place")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_place", place).withColumn("written", (F.col("_place") + F.least(F.lit(0), lowest)).cast("int")).drop("_place")


def closure(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) for all ``b`` that are reached from ``a`` through pairs; cycles end.

    What is reached is joined with itself, so the rounds grow with the logarithm of the longest way.
    """
    scratch = Scratch(pairs.sparkSession, "closure")
    current = scratch.put(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct(), "0")
    size, k = current.count(), 0
    while True:
        k += 1
        on = current.select(F.col("a").alias("b"), F.col("b").alias("c"))
        current = scratch.put(current.union(current.join(on, "b").select("a", F.col("c").alias("b"))).distinct(), str(k))
        if (more := current.count()) == size:
            return current.select(F.col("a").alias(a), F.col("b").alias(b))
        size = more
        scratch.drop(str(k - 1))


def walk(nodes: DataFrame, id_col: str, parent_col: str, name_col: str, separator: str = "/") -> DataFrame:
    """``id, depth, path`` of all nodes that hang below one without a parent; a join for each level."""
    scratch = Scratch(nodes.sparkSession, "walk")
    nodes = scratch.put(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(name_col).alias("name")), "nodes")
    level = scratch.put(nodes.filter("parent is null").select("id", F.lit(0).alias("depth"), F.col("name").alias("path")), "levels/0")
    below, k = nodes.filter("parent is not null"), 0
    while level.limit(1).count():
        k += 1
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        level = scratch.put(below.join(above, "parent").select("id", F.lit(k).alias("depth"), F.concat_ws(separator, "above", "name").alias("path")), f"levels/{k}")
    return nodes.sparkSession.read.schema(level.schema).parquet(f"{scratch.root}/levels/*")


def modulo_zip(left: DataFrame, right: DataFrame, group: list[str], left_order: str, right_order: str) -> DataFrame:
    """Pairs rows of a group by position; the right side starts again when it ends."""
    place = lambda order: F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    r = right.withColumn("_i", place(right_order)).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    l = left.withColumn("_k", place(left_order)).alias("l")  # noqa: E741
    r = r.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{g}") == F.col(f"r.{g}") for g in group]) & (F.col("_k") % F.col("_c") == F.col("_i"))
    return l.join(r, on).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in group]).drop("_k")


def stride(width: Column) -> Column:
    """Bytes of a one-bit image row, padded to four."""
    return F.floor((width + 31) / 32) * 4


def visible_bytes(width: Column) -> Column:
    """Bytes of a one-bit image row that hold pixels."""
    return F.floor((width + 7) / 8)
