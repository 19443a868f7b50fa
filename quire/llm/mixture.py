"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source has a target number of words. It is met in two parts: certain whole copies
of every document, then a sample of one more copy. The sample has unequal inclusion
probabilities: they are proportional to the documents' words (the size measure that the
targets count in), and documents whose probability would reach one are certain and leave
the rest to the others, until the probabilities' words add up to what is left of the
target. Documents are ranked by random odds over inclusion odds,
``q = (u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of the document's id and the
seed, and taken in that order until the words that are left are reached, so a sample's
size in words is fixed, not random.

No source is gathered in one task: probabilities come from the histogram of a source's
sizes; words are summed by source and by one of 65,536 bands of ``q``; only the band in
which the sample ends is ordered exactly. Sources are ranked by range partitions, and
their shares and caps meet over distinct ratios, so there may be very many of them.

Defined results: a null or empty text has size 0; a null source is a source of its
own, last in order; sources without words have target 0. If ids repeat or are null, rows
are told apart by their place in the input instead of by id, so such an input should be
a table that is read the same way twice. Documents of one rank go by id. Empty input
gives an empty result. Results are one struct; a column of its name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch, broadcast_if_small, free_name, own_columns, without

BANDS = 1 << 16
#: Sources up to this many are broadcast (about 100 bytes each); beyond, the join shuffles.
MAX_BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with ``rank``: the place of each in order of code points, null last, from 0."""
    order = F.col("source").asc_nulls_last()
    placed = scratch.put(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "placed")
    # The id's upper bits are the partition, the lower 33 the place in it.
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row for each partition
    return placed.join(firsts, "part").select("source", "source_size", (F.col("first") + F.col("place")).alias("rank"))


def targets(sources: DataFrame, weights: list[float], share: float, most: float, scratch: Scratch) -> DataFrame:
    """``sources`` (source, source_size) with weight and target columns.

    Water filling in closed form: sources reach their cap in the order of cap over
    weight, so one pass over distinct ratios finds the level at which shares and caps meet.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = _ranked(sources, scratch).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    capped = scratch.put(capped, "capped")
    ratios = capped.groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.sum("source_size").alias("size"))
    order = Window.orderBy("ratio")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share
    level = (total - before) / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The level holds from the first ratio that it does not pass.
    first = ratios.select("ratio", level.alias("level")).filter("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("f")).first().f
    target = F.col("cap") if first is None else F.when(F.col("ratio") < F.lit(first.ratio), F.col("cap")).otherwise(F.lit(first.level) * F.col("weight"))
    return capped.select("source", "source_size", "weight", target.alias("target"))


def _unit(*parts: Column) -> Column:
    """A uniform number strictly between 0 and 1: 52 bits of a hash of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _rank(size: Column, u: Column, per_word: Column, below: Column) -> Column:
    """``q / (1 + q)``, which lies between 0 and 1: 0 for certain documents, 1 for those without words."""
    p = F.when(F.coalesce(size > below, F.lit(True)), 1.0).otherwise(per_word * size)
    return u * (1 - p) / (u * (1 - p) + p * (1 - u))


def _odds(narrow: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with the inclusion probability of a word, ``per_word``, and the largest size that is not certain, ``below``."""
    sizes = narrow.groupBy("source", "size").agg(F.count(F.lit(1)).cast("double").alias("n")).filter("size > 0")
    same = F.col("h.source").eqNullSafe(F.col("g.source"))
    sizes = sizes.alias("h").join(broadcast_if_small(goal, MAX_BROADCAST_SOURCES).alias("g"), same).select("h.*", "left")
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    certain = F.coalesce(F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = F.sum(F.col("n") * F.col("size") * F.col("size")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = sizes.select("source", "size", ((F.col("left") - certain) / squares).alias("per_word")).filter("per_word * size < 1")
    found = tried.groupBy("source").agg(F.max(F.struct("size", "per_word")).alias("o"))
    same = F.col("g.source").eqNullSafe(F.col("o.source"))
    return goal.alias("g").join(found.alias("o"), same, "left").select("g.*", F.col("o.o.per_word").alias("per_word"), F.col("o.o.size").alias("below"))


def _plan(narrow: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """What to take of each source: whole copies, the odds of one more, and where the sample ends (band, cut)."""
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets(sources, list(weights), share, most, scratch).withColumn("whole", F.floor(ratio).cast("int")).withColumn("part", ratio - F.floor(ratio))
    goal = scratch.put(goal.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "goal")
    goal = scratch.put(_odds(narrow, goal), "odds")
    same = F.col("n.source").eqNullSafe(F.col("g.source"))
    ranked = narrow.alias("n").join(broadcast_if_small(goal, MAX_BROADCAST_SOURCES).alias("g"), same).filter("part > 0").select("n.source", "id", "size", "left", _rank(F.col("size"), F.col("u"), F.col("per_word"), F.col("below")).alias("v"))
    banded = ranked.withColumn("band", F.floor(F.col("v") * BANDS).cast("int"))
    sums = banded.groupBy("source", "left", "band").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = sums.withColumn("upto", F.sum("size").over(running)).filter(F.col("upto") >= F.col("left"))
    edge = scratch.put(last.groupBy("source").agg(F.min(F.struct("band", (F.col("upto") - F.col("size")).alias("before"))).alias("e")).select("source", "e.band", "e.before"), "edge")
    inside = banded.alias("b").join(broadcast_if_small(edge, MAX_BROADCAST_SOURCES).alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")) & (F.col("b.band") == F.col("e.band"))).select("b.source", "b.v", "b.id", "b.size", "b.left", "e.before")
    ties = inside.groupBy("source", "v", "id", "left", "before").agg(F.sum("size").alias("size"))
    exact = Window.partitionBy("source").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = ties.withColumn("upto", F.col("before") + F.sum("size").over(exact)).filter(F.col("upto") - F.col("size") / 2 <= F.col("left"))
    cut = taken.groupBy("source").agg(F.max(F.struct("v", "id")).alias("cut"))
    # Without a document in the last band, the sample ends with the band before it.
    joined = goal.alias("g").join(edge.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
    return scratch.put(joined.select("g.*", F.col("e.band").alias("band"), F.col("c.cut").alias("cut")), "plan")


def _copies(size: Column, u: Column, id_: Column, plan: Column) -> Column:
    v = _rank(size, u, plan.per_word, plan.below)
    band = F.floor(v * BANDS).cast("int")
    before = (band < plan.band) | ((band == plan.band) & plan.cut.isNotNull() & (F.struct(v.alias("v"), id_.alias("id")) <= plan.cut))
    more = (plan.part > 0) & F.coalesce(before, plan.band.isNull())
    return plan.whole + more.cast("int")


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> Column:
    """A struct of what sampling needs of a row: source, id, size and u."""
    name = F.col(id_col).cast("string")
    repeats = docs.select(name.alias("id")).groupBy("id").count().filter("count > 1 or id is null").limit(1).count()
    place = F.monotonically_increasing_id().cast("string") if repeats else F.lit("")
    own = F.concat_ws("#", name, place) if repeats else name
    return F.struct(F.col(source_col).cast("string").alias("source"), own.alias("id"), word_count(F.col(text_col)).alias("size"), _unit(F.lit(str(seed)), name, place).alias("u"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", result: str = "mix") -> DataFrame:
    """``docs`` with a struct ``result``: size, source_size, target, copies.

    ``most`` bounds a source's target and so the copies of a document, to its whole
    number rounded up.
    """
    docs = without(docs, result)
    plan_col, doc_col = free_name(docs, "_p"), free_name(docs, "_d")
    scratch = Scratch(docs.sparkSession, "mix")
    key = _keyed(docs, id_col, source_col, text_col, seed)
    narrow = scratch.put(docs.select(key.alias("d")).select("d.*"), "narrow")
    plan = _plan(narrow, weights, share, most, scratch)
    p = broadcast_if_small(plan, MAX_BROADCAST_SOURCES).select(F.struct("*").alias(plan_col))
    base = docs.select(*own_columns(docs), key.alias(doc_col))
    joined = base.join(p, F.col(doc_col).source.eqNullSafe(F.col(plan_col).source))
    d, at = F.col(doc_col), F.col(plan_col)
    return joined.select(*own_columns(docs), F.struct(d.size.alias("size"), at.source_size.alias("source_size"), at.target.alias("target"), _copies(d.size, d.u, d.id, at).alias("copies")).alias(result))


def digest(docs: DataFrame, *, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """The columns of the query's contract, one row per row of ``docs``; texts are read once."""
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.select(id_col, "source", "text")
    narrow = scratch.put(docs.select(F.col(id_col).alias("own"), _keyed(docs, id_col, "source", "text", seed).alias("d")).select("own", "d.*"), "narrow")
    plan = _plan(narrow, (5, 2, 1), 1.5, 2.0, scratch)
    joined = narrow.alias("d").join(broadcast_if_small(plan, MAX_BROADCAST_SOURCES).select(F.struct("*").alias("p")), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = _copies(F.col("d.size"), F.col("d.u"), F.col("d.id"), F.col("p"))
    return joined.select(F.col("d.own").alias(id_col), F.col("d.size").alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), (copies * F.col("d.size")).alias("taken"))


def materialise_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in its own columns, each row as often as the mix takes it."""
    name, copy = free_name(docs, "mix"), free_name(docs, "_copy")
    mixed = mix(docs, **options, result=name)
    copies = F.col(name).copies
    return mixed.filter(copies > 0).select("*", F.explode(F.sequence(F.lit(1), copies)).alias(copy)).select(*own_columns(docs))


#: The contract in plain SQL, for tables whose doc_id is unique and not null.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('17/' || CAST(doc_id AS VARCHAR) || '/'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, source_size * 2 AS cap, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT cap / weight AS ratio, sum(cap) AS cap, CAST(sum(weight) AS DOUBLE) AS weight FROM w GROUP BY cap / weight),
l AS (
  SELECT ratio, ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT ratio, level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT w.source, w.source_size, CASE WHEN f.ratio IS NULL OR w.cap / w.weight < f.ratio THEN w.cap ELSE f.level * w.weight END AS target FROM w LEFT JOIN f ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part FROM t),
h AS (SELECT source, size, CAST(count(*) AS DOUBLE) AS n FROM d WHERE size > 0 GROUP BY source, size),
o AS (
  SELECT h.source, size, (target - whole * source_size - coalesce(sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                         / sum(n * size * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_word
  FROM h JOIN g ON g.source IS NOT DISTINCT FROM h.source),
b AS (SELECT source, size AS below, per_word FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS i FROM o WHERE per_word * size < 1) WHERE i = 1),
p AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.part, g.target - g.whole * g.source_size AS rest, CASE WHEN coalesce(d.size > b.below, true) THEN CAST(1 AS DOUBLE) ELSE b.per_word * d.size END AS p
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS v FROM p),
z AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST((whole + CASE WHEN part > 0 AND upto - CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM z
"""
