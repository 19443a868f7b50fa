"""Chat formatting: multi-party perspective rotation, in DataFrame operations.

Every participant of a conversation gets the dialogue rendered with that speaker as
the assistant and the others as named users; only the assistant's words carry loss.
System turns stay system turns for everyone and no one takes their place.

A conversation may be of any length, so it is rendered in blocks of turns numbered in
order, one row each, never as one row: a block holds the turns of one range of BLOCK turn
numbers. Where rows repeat turn numbers so often that a range holds more than CROWD rows,
its turns, and within a turn ranges of a hash of speaker and text, form the blocks.
Blocks laid end to end are the whole dialogue, and masks count from a block's start.

Markup in a text or a name is taken apart by a blank (``< |im_end|>``), and line breaks in a
name become blanks, so no turn can pass for several.

Defined results: turns go by number, null first, then by a hash of speaker and text;
repeated rows are rendered as often as they stand; a null or empty role is the
speaker ``unknown``; a null text is empty; a null conv_id is a conversation. One
that holds system turns alone has no participants and gives no rows. Empty input gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
CROWD = 256
#: Fixed values of the chat markup.
START, STOP = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _plain(text: Column) -> Column:
    """``text`` without markup."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _blocks(turns: DataFrame) -> DataFrame:
    """``turns`` with block and part, which order the blocks of a conversation."""
    ranged = turns.withColumn("range", F.floor(F.col("turn") / BLOCK) * BLOCK)
    sizes = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("many"))
    crowds = ranged.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("c"))
    crowds = crowds.withColumn("range", F.floor(F.col("turn") / BLOCK) * BLOCK)
    same = F.col("s.conv").eqNullSafe(F.col("c.conv")) & F.col("s.range").eqNullSafe(F.col("c.range"))
    plan = crowds.alias("c").join(sizes.alias("s"), same).select("c.conv", "c.turn", "c.range", F.when(F.col("s.many") <= CROWD, 0).otherwise(F.ceil(F.col("c.c") / CROWD)).alias("parts"))
    here = F.col("t.conv").eqNullSafe(F.col("p.conv")) & F.col("t.turn").eqNullSafe(F.col("p.turn"))
    # The hash's range is cut into ``parts`` equal pieces, so pieces follow the order of the hash.
    piece = F.floor((F.col("t.h") / F.lit(float(1 << 64)) + 0.5) * F.col("p.parts")).cast("int")
    return turns.alias("t").join(plan.alias("p"), here).select("t.*", F.when(F.col("p.parts") == 0, F.col("p.range")).otherwise(F.col("p.turn")).alias("block"), F.when(F.col("p.parts") == 0, 0).otherwise(F.least(piece, F.col("p.parts") - 1)).cast("int").alias("part"))


def _head(speaker: Column, me: Column) -> Column:
    """Who speaks, as seen by ``me``."""
    return F.when(speaker == me, F.lit("assistant")).when(speaker == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), speaker))


def rotate(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, speaker, block, part, n_turns, text, mask``: mask holds [start, end) character spans that carry loss."""
    speaker = F.coalesce(F.nullif(F.trim(F.col(role_col).cast("string")), F.lit("")), F.lit("unknown"))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), _plain(F.translate(speaker, "\r\n", "  ")).alias("speaker"), _plain(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    turns = turns.withColumn("h", F.xxhash64("speaker", "text"))
    speakers = turns.filter(F.col("speaker") != SYSTEM).select("conv", "speaker").distinct()
    blocks = _blocks(turns).groupBy("conv", "block", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "h", "speaker", "text"))).alias("turns"))
    seen = blocks.alias("b").join(speakers.alias("s"), F.col("b.conv").eqNullSafe(F.col("s.conv"))).select("b.*", F.col("s.speaker").alias("me"))
    lines = seen.withColumn("lines", F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _head(t.speaker, F.col("me")), F.lit("\n")).alias("head"), t.text.alias("body"), (t.speaker == F.col("me")).alias("mine"))))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x.head, x.body, F.lit(STOP))), "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc.at + F.length(x.head)
        end = start + F.length(x.body) + len(STOP)
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x.mine, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    mask = F.aggregate("lines", none, step, lambda acc: acc.spans)
    return lines.select(F.col("conv").alias("conv_id"), F.col("me").alias("speaker"), F.col("block"), F.col("part"), F.size("turns").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def digest(conversations: DataFrame) -> DataFrame:
    """``rotate`` with the text's hash and the mask's size beside the text."""
    out = rotate(conversations)
    masked = F.aggregate("mask", F.lit(0), lambda n, s: n + s.end - s.start)
    return out.select("conv_id", "speaker", F.col("block").alias("first_turn"), "part", "n_turns", F.length("text").alias("n_chars"), masked.alias("n_masked"), F.sha2("text", 256).alias("text_sha256"))


#: Each speaker's view by plain string aggregation; the driver's tables hold no crowded turns.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(replace(replace(coalesce(nullif(trim(role), ''), 'unknown'), chr(13), ' '), chr(10), ' '), '<|im_', '< |im_') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS body,
         CAST(floor(turn / 64.0) * 64 AS BIGINT) AS block
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS me FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, p.me, t.block, t.turn, t.speaker = p.me AS mine, t.body,
         '<|im_start|>' || CASE WHEN t.speaker = p.me THEN 'assistant' WHEN t.speaker = 'system' THEN 'system'
              ELSE 'user name=' || t.speaker END || chr(10) || t.body || '<|im_end|>' || chr(10) AS line
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, me AS speaker, block AS first_turn, 0 AS part, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(length(string_agg(line, '' ORDER BY turn)) AS INTEGER) AS n_chars,
       CAST(sum(CASE WHEN mine THEN length(body) + 11 ELSE 0 END) AS INTEGER) AS n_masked,
       sha256(string_agg(line, '' ORDER BY turn)) AS text_sha256
FROM r GROUP BY conv_id, me, block
"""
