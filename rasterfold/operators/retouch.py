"""Brush strokes and their history: a log of actions that is only added to, the strokes that are live after it, and their dabs replayed.

Strokes are kept in slots: a stroke takes the slot after the last live one and ends what could have been redone from there on; an undo
and a redo only move along the slots. So what is live after any action is, for each slot up to the place then reached, the latest stroke that took it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.functions.pixels import clamp
from rasterfold.operators.keep import dropped, kept
from rasterfold.operators.regions import CELL, cells

ACTIONS = ("stroke", "undo", "redo")


def walked(log: DataFrame, keys: list[str]) -> DataFrame:
    """The log (keys, seq, action, ...) without undos that had nothing to undo, with `step`, `place` (live strokes) and `top` (those and the ones that a redo may bring back).

    A redo counts only while something undone since the last stroke is left: how far a walk of undos and redos, which can't pass
    its start, is below it. Undos at an empty history are found by the first place below zero and taken out, a run of them at a time.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    parts = Window.partitionBy(*keys, "_part").orderBy("seq")
    rows = kept(log.filter(F.col("action").isin(*ACTIONS)).withColumn("_part", F.sum((F.col("action") == "stroke").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    while True:
        down = F.when(F.col("action") == "undo", 1).when(F.col("action") == "redo", -1).otherwise(0)
        at = rows.withColumn("_w", F.sum(down).over(parts))
        at = at.withColumn("_z", F.col("_w") - F.least(F.min("_w").over(parts), F.lit(0)))
        step = F.when(F.col("action") == "stroke", 1).when(F.col("action") == "undo", -1).otherwise((F.col("_z") < F.lag("_z", 1, 0).over(parts)).cast("int"))
        placed = kept(at.withColumn("step", step).withColumn("place", F.sum("step").over(order)).drop("_w", "_z"))
        low = placed.filter("place < 0").groupBy(*keys).agg(F.min("seq").alias("_low"))
        if low.isEmpty():
            dropped(rows)
            return placed.withColumn("top", F.coalesce(F.max(F.when(F.col("action") == "stroke", F.col("place"))).over(parts), F.lit(0))).drop("_part")
        after = placed.join(low, keys).filter("seq > _low and action != 'undo'").groupBy(*keys).agg(F.min("seq").alias("_next"))
        bad = low.join(after, keys, "left") if keys else low.join(after)
        gone = (F.col("action") == "undo") & (F.col("seq") >= F.col("_low")) & (F.col("seq") < F.coalesce("_next", F.lit(2**62)))
        left = kept((rows.join(bad, keys, "left") if keys else rows.join(bad)).filter(~F.coalesce(gone, F.lit(False))).select(*rows.columns))
        dropped(rows)
        dropped(placed)
        rows = left


def depths(log: DataFrame, keys: list[str], upto: int | None = None) -> DataFrame:
    """keys, undos, redos: how many actions each direction has left after the log (up to `upto`)."""
    at = walked(log if upto is None else log.filter(F.col("seq") <= upto), keys)
    last = at.groupBy(*keys).agg(F.max_by(F.struct("place", "top"), "seq").alias("_l"))
    every = log.select(*keys).distinct()  # a log of undos alone has no row left
    return every.join(last, keys, "left").select(*keys, F.coalesce("_l.place", F.lit(0)).alias("undos"), F.coalesce(F.col("_l.top") - F.col("_l.place"), F.lit(0)).alias("redos"))


def live_strokes(log: DataFrame, keys: list[str], upto: int | None = None) -> DataFrame:
    """keys, slot (from 1), stroke: the strokes in effect after the log (up to `upto`), in the order in which they are painted."""
    at = walked(log if upto is None else log.filter(F.col("seq") <= upto), keys)
    end = at.groupBy(*keys).agg(F.max_by("place", "seq").alias("_end"))
    taken = at.filter("action = 'stroke'").groupBy(*keys, F.col("place").alias("slot")).agg(F.max_by("stroke", "seq").alias("stroke"))
    return taken.join(end, keys).filter("slot <= _end").select(*keys, "slot", "stroke")


def replay(target: DataFrame, source: DataFrame, dabs: DataFrame, upto: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, y, x, v after the dabs (keys, stroke, seq, dx, dy, r, hard), blended one after the other and cut to 16 bits each; strokes after `upto` are left out.

    A dab weighs 1 up to `hard` of its radius and falls to 0 at its edge. Dabs meet pixels in cells that both are dealt to.
    """
    keys = keys or []
    log = dabs if upto is None else dabs.filter(F.col("stroke") <= upto)
    log = log.select(*keys, "stroke", "seq", "dx", "dy", F.greatest("r", F.lit(0.5)).alias("r"), F.least(F.greatest("hard", F.lit(0.0)), F.lit(0.999)).alias("hard"))
    dealt = log
    for c in "xy":
        dealt = dealt.withColumn(f"_{c}", F.explode(cells(F.col(f"d{c}") - F.col("r"), F.col(f"d{c}") + F.col("r"))))
    at = [*keys, "y", "x"]
    both = target.join(source.select(*at, F.col("v").alias("s")), at).withColumns({f"_{c}": F.floor(F.col(c) / CELL) for c in "xy"})
    t = F.sqrt((F.col("x") - F.col("dx")) ** 2 + (F.col("y") - F.col("dy")) ** 2) / F.col("r")
    u = clamp((F.col("t") - F.col("hard")) / (1 - F.col("hard")))
    hits = both.join(dealt, [*keys, "_y", "_x"]).withColumn("t", t).filter("t < 1").withColumn("a", 1 - u * u * (3 - 2 * u))
    order = hits.groupBy(*at).agg(F.first("v").alias("v"), F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("stroke", "seq", "a"))).alias("k"))
    done = order.select(*at, F.aggregate("k", F.col("v").cast("double"), lambda v, e: F.floor(v + e["a"] * (F.col("s") - v) + 0.5).cast("double")).alias("_v"))
    return target.join(done, at, "left").select(*at, F.coalesce("_v", F.col("v").cast("double")).alias("v"))
