"""Relational shapes of document checking, applied to the driver's tables.

A checker of binary documents looks up signatures, rejects repeated keys and broken
chains, keeps the newest revision of an object and walks page trees. Each query here is
such a shape as a declarative plan on relational tables (a *shape analogue*), with the
same thing in SQL beside it. The operators that run on real documents are in
``quire.operators``; they share the functions of ``quire.operators.relational``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import relational as ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


@query(
    """SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN spot > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_marker, CAST(max(spot) AS BIGINT) AS furthest
    FROM (SELECT CASE WHEN starts_with(p_name, 'blue b') THEN 'blue b' WHEN starts_with(p_name, 'blue') THEN 'blue' WHEN starts_with(p_name, 's') THEN 's' ELSE 'other' END AS kind,
                 strpos(left(p_name, 10), 'ring') AS spot FROM part) GROUP BY kind"""
)
def signature_case(spark, sf_dir):
    """First matching signature wins; a marker is looked for in the first characters."""
    kind = ops.first_match(F.col("p_name"), [("blue b", "blue b"), ("blue", "blue"), ("s", "s")], "other")
    at = F.instr(F.substring("p_name", 1, 10), "ring")
    return _table(spark, sf_dir, "part").select(kind.alias("kind"), at.alias("at")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") > 0).alias("with_marker"), F.max("at").cast("long").alias("furthest"))


@query(
    """SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN l_returnflag IN ('N', 'O') THEN 1 ELSE 0 END) AS BIGINT) AS open_flags,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(count(*) AS BIGINT) AS total FROM lineitem GROUP BY l_linestatus"""
)
def format_counts(spark, sf_dir):
    """Counts by class in one pass, as of images by codec."""
    flag = F.col("l_returnflag")
    return _table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(flag == "A").alias("accepted"), F.count_if(flag.isin("N", "O")).alias("open_flags"), F.count_if(flag == "R").alias("returned"), F.count(F.lit(1)).alias("total"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def first_revision_wins(spark, sf_dir):
    """The newest row of each key, as of object revisions."""
    return ops.newest(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS times FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Keys that occur more than once."""
    return ops.repeated(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "times")


@query("""SELECT user_id, event_id, expected FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS expected FROM events) WHERE expected IS NOT NULL AND event_id <> expected""")
def contiguity_breaks(spark, sf_dir):
    """Rows that do not continue where the row before them ended."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") + 1).alias("end"))
    return ops.chain_breaks(rows, ["user_id"], ["event_id"], "event_id", "end").select("user_id", "event_id", "expected")


@query("""SELECT 'document' AS side, doc_id AS key FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)
    UNION ALL SELECT 'event' AS side, event_id AS key FROM events WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = event_id)""")
def dangling_refs(spark, sf_dir):
    """References without a target, in both directions."""
    documents, labels, events = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label")), _table(spark, sf_dir, "events").select("event_id")
    one = ops.dangling(documents, labels, {"doc_id": "label"}).select(F.lit("document").alias("side"), F.col("doc_id").alias("key"))
    return one.unionByName(ops.dangling(events, documents, {"event_id": "doc_id"}).select(F.lit("event").alias("side"), F.col("event_id").alias("key")))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS parts FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') GROUP BY p_brand")
def existing_refs(spark, sf_dir):
    """Rows with a target."""
    returned = _table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return ops.existing(_table(spark, sf_dir, "part"), returned, {"p_partkey": "l_partkey"}).groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))


@query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM region JOIN nation ON n_regionkey = r_regionkey
    JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def lookup_join(spark, sf_dir):
    """A chain of look-ups by key; the join order is left to the optimizer."""
    t = lambda name: _table(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("""SELECT c_mktsegment, string_agg(nation, ',' ORDER BY first) AS nations, CAST(sum(n) AS BIGINT) AS customers FROM (
    SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation, min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) GROUP BY c_mktsegment""")
def ordered_group_members(spark, sf_dir):
    """Distinct members of each group in the order they were first seen."""
    out = ops.first_seen_members(_table(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_nationkey").cast("string"), F.col("c_custkey"))
    return out.select("c_mktsegment", F.array_join("members", ",").alias("nations"), F.col("n").alias("customers"))


_TREE = """WITH RECURSIVE node AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
walk AS (
  SELECT id, name, 0 AS depth, name AS path FROM node WHERE parent IS NULL
  UNION ALL SELECT node.id, node.name, walk.depth + 1, walk.path || '/' || node.name FROM walk JOIN node ON node.parent = walk.id)
SELECT id, depth, path FROM walk"""


@query(_TREE)
def tree_walk(spark, sf_dir):
    """A tree from its roots down, with the path that orders it as a document."""
    t = lambda name, *columns: _table(spark, sf_dir, name).select(*columns)
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column))
    nodes = t("region", key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.union(t("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")).union(t("supplier", key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name"))
    return ops.walk(nodes, "id", "parent", "name")


@query("""WITH RECURSIVE ref AS (SELECT DISTINCT p_size AS a, (p_size * 7 + 3) % 50 AS b FROM part),
reach AS (SELECT a, b FROM ref UNION SELECT reach.a, ref.b FROM reach JOIN ref ON ref.a = reach.b)
SELECT a, b FROM reach""")
def dependency_closure(spark, sf_dir):
    """All that is reached through references, from every one of them; cycles end."""
    refs = _table(spark, sf_dir, "part").select(F.col("p_size").alias("a"), ((F.col("p_size") * 7 + 3) % 50).alias("b"))
    return ops.closure(refs, "a", "b")


@query("SELECT doc_id, first_id, CAST(copies AS BIGINT) AS copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL) WHERE copies > 1")
def exact_duplicates(spark, sf_dir):
    """Equal payloads; the first is the original."""
    return ops.exact_copies(_table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")


@query("SELECT event_id AS key FROM events WHERE event_type = 'click' EXCEPT SELECT doc_id FROM documents")
def set_difference(spark, sf_dir):
    """Keys of one set that the other lacks."""
    clicks = _table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("event_id").alias("key"))
    return ops.difference(clicks, _table(spark, sf_dir, "documents").select("doc_id"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS total, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE r <= 16) AS first_ids
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) GROUP BY event_type""")
def first_n_list(spark, sf_dir):
    """All are counted, the first sixteen are listed."""
    return ops.first_listed(_table(spark, sf_dir, "events"), ["event_type"], "event_id", 16).select("event_type", "total", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first_ids"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'LimitExceeded' END AS error FROM orders""")
def limit_violations(spark, sf_dir):
    """A limit marks a row; it never drops one."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 400000, "LimitExceeded").alias("error"))


@query("""WITH RECURSIVE item AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, 1 + CAST(event_id % 5 AS INTEGER) AS level FROM events),
fold AS (SELECT user_id, k, level, 1 AS written FROM item WHERE k = 1
  UNION ALL SELECT item.user_id, item.k, item.level, least(item.level, fold.written + 1) FROM fold JOIN item ON item.user_id = fold.user_id AND item.k = fold.k + 1)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(written) AS BIGINT) AS written, CAST(sum(CASE WHEN written < level THEN 1 ELSE 0 END) AS BIGINT) AS clamped FROM fold GROUP BY user_id""")
def clamped_levels(spark, sf_dir):
    """Depths that may rise by one at most, each judged by what was written before it."""
    level = (F.col("event_id") % 5 + 1).cast("int")
    out = ops.clamp_levels(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", level.alias("level")), ["user_id"], ["ts", "event_id"], "level")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("written").alias("written"), F.count_if(F.col("written") < F.col("level")).alias("clamped"))


@query("""WITH g AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation),
s AS (SELECT s_suppkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s.s_suppkey, g.n_name FROM s JOIN g ON s.n_regionkey = g.n_regionkey AND s.i % g.c = g.i""")
def modulo_zip(spark, sf_dir):
    """Rows paired by position, the shorter side again and again, as images with coordinates."""
    nation = _table(spark, sf_dir, "nation")
    supplier = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    return ops.modulo_zip(supplier, nation.select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], "s_suppkey", "n_nationkey").select("s_suppkey", "n_name")


@query("""SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum((octet_length(encode(text)) + 31) // 32 * 4) AS BIGINT) AS padded, CAST(max((octet_length(encode(text)) + 7) // 8) AS BIGINT) AS widest
    FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def byte_length_stats(spark, sf_dir):
    """Row strides: lengths rounded up to whole units."""
    n = F.octet_length("text").cast("long")
    return _table(spark, sf_dir, "documents").filter("text is not null").groupBy("lang").agg(F.sum(n).alias("bytes"), F.sum(ops.stride(n)).alias("padded"), F.max(ops.visible_bytes(n)).alias("widest"))


@query("""SELECT l_orderkey, CAST(max(greatest(l_partkey, l_suppkey)) AS BIGINT) AS next_after, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_orderkey""")
def highest_number(spark, sf_dir):
    """The largest of several numbers over a group, from which new numbers go on."""
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.greatest("l_partkey", "l_suppkey")).alias("next_after"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT DISTINCT o_custkey AS owner, CAST(year(o_orderdate) AS INTEGER) AS target FROM orders")
def distinct_pairs(spark, sf_dir):
    """Distinct (owner, target) pairs."""
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.year("o_orderdate").alias("target")).distinct()


@query("""SELECT l_orderkey, l_linenumber, running FROM (SELECT l_orderkey, l_linenumber, l_quantity, CAST(max(l_linenumber * 100 + CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS running FROM lineitem) WHERE l_linenumber * 100 < running""")
def overlapping_spans(spark, sf_dir):
    """Spans that begin before the furthest end so far."""
    spans = _table(spark, sf_dir, "lineitem").withColumn("start", (F.col("l_linenumber") * 100).cast("long")).withColumn("end", F.col("start") + F.col("l_quantity").cast("long"))
    return ops.overlaps(spans, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "start", "end").select("l_orderkey", "l_linenumber", F.col("furthest").alias("running"))

