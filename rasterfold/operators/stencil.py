"""Neighbourhood operators on planes keyed by (keys..., y, x). Weight relations follow the frame's edge and are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.functions.kernels import Taps, binomial, expand_taps, linear_taps, reduce_taps, reflect, window_taps


def along(df: DataFrame, taps: Taps, axis: str, values: list[str], keys: list[str]) -> DataFrame:
    """Sum of weight times value along one axis; the rows of a line are summed before they are shuffled."""
    other = "x" if axis == "y" else "y"
    weights = F.broadcast(df.sparkSession.createDataFrame(taps, "_o int, _i int, _w double"))
    joined = df.join(weights, F.col(axis) == F.col("_i"))
    return joined.groupBy(*keys, other, F.col("_o").alias(axis)).agg(*[F.sum(F.col(v) * F.col("_w")).alias(v) for v in values])


def separable(df: DataFrame, ty: Taps, tx: Taps, values: list[str], keys: list[str]) -> DataFrame:
    return along(along(df, tx, "x", values, keys), ty, "y", values, keys)


def reduce(df: DataFrame, h: int, w: int, values: list[str], keys: list[str]) -> DataFrame:
    return separable(df, reduce_taps(h), reduce_taps(w), values, keys)


def expand(df: DataFrame, h: int, w: int, values: list[str], keys: list[str]) -> DataFrame:
    return separable(df, expand_taps(h), expand_taps(w), values, keys)


def expand_linear(df: DataFrame, h: int, w: int, values: list[str], keys: list[str]) -> DataFrame:
    """EXPAND with borders that go on as a slope: a falling background keeps falling at the frame's edge."""
    return separable(df, linear_taps(h), linear_taps(w), values, keys)


def window_sum(df: DataFrame, h: int, w: int, r: int, values: list[str], keys: list[str]) -> DataFrame:
    return separable(df, window_taps(h, binomial(r)), window_taps(w, binomial(r)), values, keys)


def combine(a: DataFrame, b: DataFrame, values: list[str], keys: list[str], sign: int) -> DataFrame:
    """a + sign * b, pixel by pixel."""
    right = b.select(*keys, "y", "x", *[F.col(v).alias(f"_{v}") for v in values])
    return a.join(right, [*keys, "y", "x"]).select(*keys, "y", "x", *[(F.col(v) + sign * F.col(f"_{v}")).alias(v) for v in values])


def box(df: DataFrame, r: int, values: list[str], keys: list[str]) -> DataFrame:
    """Mean over the clipped window: sums along both axes, divided by the clipped count."""
    wx = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-r, r)
    wy = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-r, r)
    once = df.select(*keys, "y", "x", F.count("*").over(wx).alias("_n"), *[F.sum(v).over(wx).alias(v) for v in values])
    twice = once.select(*keys, "y", "x", F.sum("_n").over(wy).alias("_n"), *[F.sum(v).over(wy).alias(v) for v in values])
    return twice.select(*keys, "y", "x", *[(F.col(v) / F.col("_n")).alias(v) for v in values])


def guided_coefficients(df: DataFrame, guide: str, value: str, r: int, eps: float, keys: list[str]) -> DataFrame:
    """Mean a and b of the guided filter: value is about a times the guide plus b around each pixel."""
    g, p = F.col(guide), F.col(value)
    first = box(df.select(*keys, "y", "x", g.alias("mi"), p.alias("mp"), (g * p).alias("mip"), (g * g).alias("mii")), r, ["mi", "mp", "mip", "mii"], keys)
    a = (F.col("mip") - F.col("mi") * F.col("mp")) / (F.col("mii") - F.col("mi") * F.col("mi") + eps)
    return box(first.select(*keys, "y", "x", a.alias("a"), (F.col("mp") - a * F.col("mi")).alias("b")), r, ["a", "b"], keys)


def guided(df: DataFrame, guide: str, value: str, r: int, eps: float, keys: list[str]) -> DataFrame:
    """The guided filter: mean a times the guide plus mean b. Adds `out`."""
    second = guided_coefficients(df, guide, value, r, eps, keys)
    return df.join(second, [*keys, "y", "x"]).withColumn("out", F.col("a") * F.col(guide) + F.col("b")).drop("a", "b")


def convolve(df: DataFrame, taps: list[tuple[int, int, float]], h: int, w: int, value: str, keys: list[str]) -> DataFrame:
    """Sum over (dy, dx, weight) with reflected borders. Each pixel is sent to the places that read it."""
    rows = [(t, d, s, weight, o, reflect(o + d, h)) for t, (d, s, weight) in enumerate(taps) for o in range(h)]
    ys = df.sparkSession.createDataFrame([(t, weight, o, i) for t, d, s, weight, o, i in rows], "_t int, _w double, _oy int, _iy int")
    xs = df.sparkSession.createDataFrame([(t, o, reflect(o + s, w)) for t, (d, s, _) in enumerate(taps) for o in range(w)], "_t int, _ox int, _ix int")
    sent = df.join(F.broadcast(ys), F.col("y") == F.col("_iy")).join(F.broadcast(xs.withColumnRenamed("_t", "_u")), (F.col("x") == F.col("_ix")) & (F.col("_t") == F.col("_u")))
    return sent.groupBy(*keys, F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(F.sum(F.col(value) * F.col("_w")).alias(value))


def ring_taps(inner: int, outer: int) -> list[tuple[int, int, float]]:
    """Mean over the disk less mean over the ring around it."""
    at = [(y, x, y * y + x * x) for y in range(-outer, outer + 1) for x in range(-outer, outer + 1)]
    disk, ring = [(y, x) for y, x, d in at if d <= inner * inner], [(y, x) for y, x, d in at if inner * inner < d <= outer * outer]
    return [(y, x, 1 / len(disk)) for y, x in disk] + [(y, x, -1 / len(ring)) for y, x in ring]


def modified_laplacian(df: DataFrame, step: int, h: int, w: int, value: str, keys: list[str]) -> DataFrame:
    """|2c - left - right| + |2c - up - down| at a distance of step."""
    across = convolve(df, [(0, 0, 2.0), (0, -step, -1.0), (0, step, -1.0)], h, w, value, keys)
    down = convolve(df, [(0, 0, 2.0), (-step, 0, -1.0), (step, 0, -1.0)], h, w, value, keys).withColumnRenamed(value, "_d")
    return across.join(down, [*keys, "y", "x"]).select(*keys, "y", "x", (F.abs(value) + F.abs("_d")).alias(value))


def block_mean(df: DataFrame, k: int, values: list[str], keys: list[str]) -> DataFrame:
    """Means of k x k blocks; blocks at the border have their own counts."""
    return df.groupBy(*keys, F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x")).agg(*[F.avg(v).alias(v) for v in values])


def _neighbours(df: DataFrame, h: int, w: int, r: int, value: str, keys: list[str], inside) -> DataFrame:
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if inside(dy, dx)]
    rows = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])).alias("_d")
    return df.select(*keys, "y", "x", value, rows)


def median3(df: DataFrame, h: int, w: int, value: str, keys: list[str]) -> DataFrame:
    """The fifth of the nine values around a pixel, borders reflected."""
    spark = df.sparkSession
    y = F.broadcast(spark.createDataFrame([(o, reflect(o + d, h)) for o in range(h) for d in (-1, 0, 1)], "_oy int, _iy int"))
    x = F.broadcast(spark.createDataFrame([(o, reflect(o + d, w)) for o in range(w) for d in (-1, 0, 1)], "_ox int, _ix int"))
    near = df.join(y, F.col("y") == F.col("_iy")).join(x, F.col("x") == F.col("_ix"))
    return near.groupBy(*keys, F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(F.element_at(F.array_sort(F.collect_list(value)), 5).alias(value))


def dilate_disk(df: DataFrame, h: int, w: int, r: int, value: str, keys: list[str]) -> DataFrame:
    """The largest value within a disk."""
    near = _neighbours(df, h, w, r, value, keys, lambda dy, dx: dy * dy + dx * dx <= r * r)
    at = near.select(*keys, (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x"), value)
    return at.filter((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)).groupBy(*keys, "y", "x").agg(F.max(value).alias(value))


def dilate_square(df: DataFrame, r: int, value: str, keys: list[str]) -> DataFrame:
    wx = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-r, r)
    wy = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-r, r)
    return df.select(*keys, "y", "x", F.max(value).over(wx).alias(value)).select(*keys, "y", "x", F.max(value).over(wy).alias(value))


def local_contrast(df: DataFrame, r: int, value: str, keys: list[str]) -> DataFrame:
    mean = box(df, r, [value], keys).withColumnRenamed(value, "_m")
    return df.join(mean, [*keys, "y", "x"]).select(*keys, "y", "x", F.abs(F.col(value) - F.col("_m")).alias(value))
