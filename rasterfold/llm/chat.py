"""Op 1: chat formatting. Logged snapshots that are prefixes of longer conversations collapse into them; the rest is rendered.

Each turn gets a rolling hash of its conversation so far: the exclusive-or of (position, role, text) hashes of the turns up to
it, twice with different seeds, so that 128 bits tell prefixes apart. A conversation's own hash is that of its last turn.
Anti-joins drop conversations whose own hash is a proper prefix hash of another, and repeats of an equal conversation. Only
DataFrame functions are used. Turns are placed over ranges of the order and hashed and rendered in chunks of CHUNK places, so a
conversation of any length is dealt out, whatever its turn numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from rasterfold.llm.common import cut, prepare

#: Turns that are hashed and rendered together, counted by their place in the conversation.
CHUNK = 1024
#: Characters of role and text that deal turns into stretches; within a stretch whole texts are ordered.
DEAL = 256
#: Repeats of one row that are written out at a time.
REPEATS = 100_000


def placed(turns: DataFrame) -> DataFrame:
    """Rows with their position in the conversation, from 0, in the order of (turn, role, text).

    Equal rows count once and are written out again at the end. The order deals rows into stretches by range, so that one
    conversation may fill many of them, whatever its turn numbers; a stretch starts where the counts before it end.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    rows = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), *(e.alias(c) for c, e in text.items()))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("_n"))
    rows = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, DEAL), F.substring("text", 1, DEAL))
    rows = cut(rows.withColumn("_stretch", F.spark_partition_id()))
    key = ["conv_id", "_stretch"]
    counts = rows.groupBy(*key).agg(F.sum("_n").alias("_rows"))
    starts = counts.select(*key, _sum_before("_rows", Window.partitionBy("conv_id").orderBy("_stretch")).alias("_start"))
    rows = rows.withColumn("_in", _sum_before("_n", Window.partitionBy(*key).orderBy("turn", "role", "text")))
    rows = _null_safe(rows, starts, key)
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(REPEATS).cast("long"))))
    repeat = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + REPEATS, F.col("_n")) - 1))
    return rows.withColumn("_k", repeat).select("conv_id", "turn", "role", "text", (F.col("_start") + F.col("_in") + F.col("_k")).alias("position"))


def _sum_before(column: str, order: WindowSpec) -> Column:
    return F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """Adds position (from 0), chunk (of the position), a and b (rolling hashes) to rows with conv_id, turn, role, text."""
    rows = placed(turns).withColumn("chunk", F.floor(F.col("position") / CHUNK))
    key = ["conv_id", "chunk"]
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_a", F.xxhash64("position", "role", "text")).withColumn("_b", F.xxhash64(F.lit(77), "text", "position", "role"))
    sums = rows.groupBy(*key).agg(F.expr("bit_xor(_a)").alias("_ca"), F.expr("bit_xor(_b)").alias("_cb"))
    sums = sums.select(*key, *(F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0).cast("long")).alias(c) for c in ("_ca", "_cb")))
    rows = _null_safe(rows, sums, key)
    return rows.select("conv_id", "chunk", "turn", "role", "text", "position", *(F.expr(f"bit_xor({c})").over(run).bitwiseXOR(F.col(t)).alias(n) for c, t, n in (("_a", "_ca", "a"), ("_b", "_cb", "b"))))


def _null_safe(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in right.columns if c not in key])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return left.join(right, on).drop(*[f"_{k}" for k in key])


def render_turn(role: Column, text: Column, start: str, end: str) -> Column:
    return F.concat(F.lit(start), role, F.lit("\n"), text, F.lit(end + "\n"))


def format_chats(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, part, text: maximal conversations, rendered; long ones in several parts, in order, from 0.

    A conversation is its turns in the order of (turn, role, text). It is dropped if another one begins with all of its turns
    and has more, or equals it and has a smaller conv_id. Null roles and texts count as empty, null turns come first, all
    rows with a null conv_id are one conversation; repeated rows are turns of their own. A part holds CHUNK turns. Turns are compared by role and text, not by
    turn number. Empty table: no rows; other columns are ignored.
    """
    prepare(turns.sparkSession)
    hashed = cut(turn_hashes(turns))
    last = hashed.groupBy("conv_id").agg((F.max("position") + 1).alias("n_turns"), F.max_by(F.struct("a", "b"), "position").alias("h"))
    last = cut(last.select("conv_id", "n_turns", "h.a", "h.b"))
    inner = _null_safe(hashed.select("conv_id", "position", "a", "b"), last.select("conv_id", "n_turns"), ["conv_id"])
    prefixes = inner.filter("position + 1 < n_turns").select((F.col("position") + 1).alias("n_turns"), "a", "b").distinct()
    maximal = last.join(prefixes, ["n_turns", "a", "b"], "left_anti")
    firsts = maximal.groupBy("n_turns", "a", "b").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"))
    parts = _null_safe(hashed, firsts.select("conv_id", "n_turns"), ["conv_id"])
    piece = render_turn(F.col("role"), F.col("text"), start, end)
    parts = parts.groupBy("conv_id", "n_turns", "chunk").agg(F.array_sort(F.collect_list(F.struct("position", piece.alias("piece")))).alias("p"))
    return parts.select("conv_id", "n_turns", F.col("chunk").alias("part"), F.concat_ws("", F.col("p.piece")).alias("text"))
