"""Chat formatting after the collapse of cumulative snapshots.

Logs often hold a conversation once per turn, each time a turn longer. A rolling hash
over its turns identifies every prefix of a conversation. A conversation whose whole
hash is a proper prefix of another is removed by an anti-join; of equal conversations
the smallest conv_id stays. What remains is rendered.

Turns are ordered by ``turn`` (ties by role, then text); a null role is ``user``, a
null text empty, and a null turn comes first. Rows that repeat a turn are turns of
their own. A null conv_id names no conversation: each of its rows is a conversation of one
turn, so that no group of strangers is gathered. A conversation is one row of the
result, so one must fit in memory; what many conversations share (a first turn, a whole
log) is only ever compared by hash, pre-aggregated before the shuffle. Very long texts
are hashed once. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rows(turns: DataFrame) -> DataFrame:
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv"), turn.alias("t"))


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv and its turns (turn, role, text) in order, for rows that name one."""
    return _rows(turns).where("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _parts(place, turn) -> list:
    """A turn at its place as four numbers of 60 bits."""
    whole = F.sha2(F.concat_ws("\n", place.cast("string"), F.length(turn["role"]).cast("string"), turn["role"], turn["text"]), 256)
    return [F.conv(F.substring(whole, 1 + 15 * j, 15), 16, 10).cast("decimal(20,0)").alias(f"p{j}") for j in range(4)]


def prefix_hashes(whole: DataFrame) -> DataFrame:
    """conv and the ``hash`` of its first turns, for every number of them; ``end`` marks whole conversations.

    The hash rolls: each turn adds 240 bits of the digest of its place and content, so all
    prefixes cost one running sum over the turns in order.
    """
    each = whole.select("conv", F.size("turns").alias("n"), F.posexplode("turns").alias("i", "t")).select("conv", "n", "i", *_parts(F.col("i"), F.col("t")))
    w = Window.partitionBy("conv").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("conv", F.concat_ws(":", (F.col("i") + 1).cast("string"), *[F.sum(f"p{j}").over(w).cast("string") for j in range(4)]).alias("hash"), (F.col("i") + 1 == F.col("n")).alias("end"))


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that no longer one starts with, one of each kind: conv, turns, copies."""
    all_ = conversations_of(turns)
    hashes = prefix_hashes(all_)
    starts = hashes.where("not end").select("hash").distinct()
    alone = _rows(turns).where("conv is null").select("t", *_parts(F.lit(0), F.col("t")))
    alone = alone.select("t", F.concat_ws(":", F.lit("1"), *[F.col(f"p{j}").cast("string") for j in range(4)]).alias("hash"))
    ends = hashes.where("end").select("hash", "conv", F.lit(None).cast(alone.schema["t"].dataType).alias("t"))
    one = ends.unionByName(alone.withColumn("conv", F.lit(None).cast("long"))).groupBy("hash").agg(F.min("conv").alias("conv"), F.min("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    kept = one.join(starts, "hash", "left_anti").drop("hash")
    named = all_.join(kept.where("conv is not null").drop("t"), "conv")
    return named.unionByName(kept.where("conv is null").select("conv", F.array("t").alias("turns"), "copies"))


def render(turns):
    """<|role|>, newline, text, newline for each turn, and <|end|>."""
    return F.concat(F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), ""), F.lit("<|end|>"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered of each maximal conversation."""
    kept = maximal(turns)
    return kept.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.col("copies").alias("n_copies"), render(F.col("turns")).alias("rendered"))


SQL = """
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE CAST(conv_id AS VARCHAR) END AS conv, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv) AS n,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') OVER w AS body
  FROM t WINDOW w AS (PARTITION BY conv ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
one AS (SELECT min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies, body FROM p WHERE k = n GROUP BY body)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, body || '<|end|>' AS rendered
FROM one WHERE body NOT IN (SELECT body FROM p WHERE k < n)
"""
