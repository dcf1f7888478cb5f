"""Rasters, capture times and frame lists derived from the driver's tables; any DataFrame of the same schema will do in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAMES, HEIGHT, WIDTH = 7, 24, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, y, x, r, g, b: seven RGB frames of 24 x 32; cells without rows are 0."""
    items = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("frame"), (F.col("l_suppkey") % HEIGHT).cast("int").alias("y"), (F.col("l_partkey") % WIDTH).cast("int").alias("x"))
    cells = items.agg((F.avg("l_discount") * 10).alias("r"), (F.avg("l_tax") * 12.5).alias("g"), (F.avg("l_quantity") / 50).alias("b"))
    n = F.col("id")
    grid = spark.range(FRAMES * HEIGHT * WIDTH).select((n / (HEIGHT * WIDTH)).cast("int").alias("frame"), ((n / WIDTH).cast("int") % HEIGHT).alias("y"), (n % WIDTH).cast("int").alias("x"))
    return grid.join(cells, ["frame", "y", "x"], "left").fillna(0.0, ["r", "g", "b"])


def emb_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack, frame, y, x, v: stacks of ten 8 x 8 gray frames."""
    cells = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("stack"), (F.col("vec_id") % 10).cast("int").alias("frame"), F.posexplode("embedding").alias("i", "e"))
    return cells.select("stack", "frame", (F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.least(F.greatest(F.col("e").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)).alias("v"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list, frame, t (seconds): a list of capture times for each user."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("list"), (F.row_number().over(order) - 1).alias("frame"), t.alias("t"))


def frame_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, path: one list of frames in several folders."""
    c = table(spark, sf_dir, "conversations")
    ext = F.when(F.col("turn") % 2 == 0, "tif").otherwise("png")
    path = F.concat(F.lit("shoot/"), F.col("conv_id") % 7, F.lit("/f"), F.col("turn"), F.lit("."), ext)
    return c.select("conv_id", "turn", path.alias("path"))
