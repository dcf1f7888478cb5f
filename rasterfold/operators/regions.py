"""Connected regions of masks as relations: runs of pixels, edges between runs that touch, least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.operators.keep import dropped, kept

#: Runs and windows meet in cells of so many pixels.
CELL = 64


def cells(first: Column, last: Column, size: int = CELL) -> Column:
    return F.sequence(F.floor(first / size), F.floor(last / size))


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, root for every node (keys, id): root is the least id that edges (keys, a, b) reach.

    Each round takes the least root among the neighbours and then the root of that root, so paths halve; the labels are
    written between rounds.
    """
    both = kept(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    first = both.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("m"))
    labels = kept(nodes.select(*keys, "id").join(first, [*keys, "id"], "left").select(*keys, "id", F.least("id", F.coalesce("m", "id")).alias("root")))
    while True:
        near = both.join(labels.select(*keys, F.col("id").alias("b"), "root"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("root").alias("m"))
        least = labels.join(near, [*keys, "id"], "left").select(*keys, "id", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("_up"))
        far = labels.select(*keys, F.col("id").alias("_up"), F.col("root").alias("_far"))
        new = kept(least.join(far, [*keys, "_up"]).select(*keys, "id", "was", F.least("_up", "_far").alias("root")))
        done = new.filter("was != root").isEmpty()
        dropped(labels)
        labels = new.drop("was")
        if done:
            dropped(both)
            return labels


def runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1, id: maximal runs of set pixels (mask > 0) in each row; ids grow from the top left on."""
    lit = mask.filter("mask > 0").select(*keys, "y", "x")
    island = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    found = lit.withColumn("_i", island).groupBy(*keys, "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return found.select(*keys, "y", "x0", "x1", (F.shiftleft(F.col("y").cast("long"), 32) + F.col("x0")).alias("id"))


def touching(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: runs of neighbouring rows that share a side or a corner, each pair once, met in cells."""
    above = found.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("id").alias("a")).withColumn("cell", F.explode(cells(F.col("p0"), F.col("p1"))))
    below = found.select(*keys, "y", (F.col("x0") - 1).alias("q0"), (F.col("x1") + 1).alias("q1"), F.col("id").alias("b")).withColumn("cell", F.explode(cells(F.col("q0"), F.col("q1"))))
    both = above.join(below, [*keys, "y", "cell"])
    return both.filter((F.col("p0") <= F.col("q1")) & (F.col("q0") <= F.col("p1")) & (F.col("cell") == F.floor(F.greatest("p0", "q0") / CELL))).select(*keys, "a", "b")


def regions(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, region: 8-connected regions of set pixels, numbered from 1 in the order of their first pixel."""
    found = kept(runs(mask, keys))
    labels = components(found, touching(found, keys), keys)
    number = labels.filter("id = root").select(*keys, "root", F.row_number().over(Window.partitionBy(*keys).orderBy("root")).cast("long").alias("region"))
    named = found.join(labels.join(number, [*keys, "root"]), [*keys, "id"])
    return named.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "region")


def windows_meeting(a: DataFrame, b: DataFrame, keys: list[str], size: int = CELL) -> DataFrame:
    """Rows of a and b whose windows (x, y, w, h) share a pixel, each pair once; columns of b come with a prefix other_.

    Windows of any size meet in the cells that they cover, and a pair is told in the first cell that both cover.
    """
    other = b.select(*keys, *[F.col(c).alias(f"other_{c}") for c in b.columns if c not in keys])

    def in_cells(df: DataFrame, p: str) -> DataFrame:
        across = df.withColumn("cell_x", F.explode(cells(F.col(f"{p}x"), F.col(f"{p}x") + F.col(f"{p}w") - 1, size)))
        return across.withColumn("cell_y", F.explode(cells(F.col(f"{p}y"), F.col(f"{p}y") + F.col(f"{p}h") - 1, size)))

    both = in_cells(a, "").join(in_cells(other, "other_"), [*keys, "cell_x", "cell_y"])
    for c, n in (("x", "w"), ("y", "h")):
        meet = (F.col(c) < F.col(f"other_{c}") + F.col(f"other_{n}")) & (F.col(f"other_{c}") < F.col(c) + F.col(n))
        both = both.filter(meet & (F.col(f"cell_{c}") == F.floor(F.greatest(c, f"other_{c}") / size)))
    return both.drop("cell_x", "cell_y")
