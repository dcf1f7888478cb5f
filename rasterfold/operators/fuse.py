"""Pyramids and the fold over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.functions.kernels import window_taps
from rasterfold.functions.pixels import clamp, luma
from rasterfold.operators.stencil import combine, expand, reduce, separable, window_sum

RGB = ["r", "g", "b"]


def sizes(h: int, w: int, levels: int) -> list[tuple[int, int]]:
    out = [(h, w)]
    for _ in range(levels):
        out.append(((out[-1][0] + 1) // 2, (out[-1][1] + 1) // 2))
    return out


def auto_levels(h: int, w: int, least: int = 32) -> int:
    """The deepest pyramid whose residual's short side has `least` pixels or more; at least one level."""
    n = 0
    while (min(h, w) + 1) // 2 >= least:
        h, w, n = (h + 1) // 2, (w + 1) // 2, n + 1
    return max(n, 1)


def pyramid(df: DataFrame, h: int, w: int, levels: int, values: list[str], keys: list[str]) -> list[DataFrame]:
    """Laplacian levels, then the residual."""
    out = []
    for hh, ww in sizes(h, w, levels)[:-1]:
        small = reduce(df, hh, ww, values, keys)
        out.append(combine(df, expand(small, hh, ww, values, keys), values, keys, -1))
        df = small
    return [*out, df]


def collapse(levels: list[DataFrame], h: int, w: int, values: list[str], keys: list[str]) -> DataFrame:
    df = levels[-1]
    for level, (hh, ww) in reversed(list(zip(levels[:-1], sizes(h, w, len(levels) - 1)))):
        df = combine(level, expand(df, hh, ww, values, keys), values, keys, 1)
    return df


def node_energy(chroma: bool) -> Column:
    r, g, b = (F.col(c) for c in RGB)
    y = luma(r, g, b)
    return r * r + g * g + b * b if chroma else y * y


def region_energy(level: DataFrame, h: int, w: int, keys: list[str], r: int = 1, chroma: bool = False) -> DataFrame:
    """Binomially windowed energy, to ten digits so that ties don't hang on the order of summing. Adds e."""
    e = window_sum(level.select(*keys, "y", "x", node_energy(chroma).alias("e")), h, w, r, ["e"], keys)
    return level.join(e.withColumn("e", F.round("e", 10)), [*keys, "y", "x"])


def fold(level: DataFrame, keys: list[str]) -> DataFrame:
    """Of each coefficient the frame with the most energy; ties go to the earlier frame. Partial results combine."""
    best = F.max_by(F.struct("frame", "e", *RGB), F.struct("e", (-F.col("frame")).alias("_f")))
    return level.groupBy(*keys, "y", "x").agg(best.alias("_b")).select(*keys, "y", "x", F.col("_b.frame").alias("winner"), "_b.e", *[f"_b.{c}" for c in RGB])


def winner_shares(winners: DataFrame, frames: int) -> DataFrame:
    """frame and its share of the cells whose energy is over 1 % of the largest; frames that win nothing stay."""
    top = winners.agg(F.max("e").alias("top"))
    detail = winners.join(F.broadcast(top), F.col("e") > 0.01 * F.col("top"))
    won = detail.groupBy(F.col("winner").alias("frame")).agg(F.count("*").alias("n"))
    total = won.agg(F.sum("n").alias("total"))
    every = winners.sparkSession.range(frames).select(F.col("id").cast("int").alias("frame"))
    return every.join(won, "frame", "left").join(F.broadcast(total)).select("frame", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"))


def share_note(shares: DataFrame) -> DataFrame:
    low = F.array_sort(F.collect_list(F.when(F.col("share") < 0.01, F.col("frame"))))
    return shares.agg(F.min_by("frame", F.struct("share", "frame")).alias("least"), F.max_by("frame", F.struct("share", (-F.col("frame")).alias("f"))).alias("most"), low.alias("under"))


def deviation_entropy(df: DataFrame, h: int, w: int, r: int, bins: int, keys: list[str]) -> DataFrame:
    """Local variance (dev) and entropy (ent, natural logarithm) of v over (2r+1)^2 reflected windows."""
    ones = [1.0] * (2 * r + 1)
    bin_ = F.floor(clamp(F.col("v")) * (bins - 1) + 0.5).cast("int")
    rows = df.select(*keys, "y", "x", "v", bin_.alias("bin"))
    n = float((2 * r + 1) ** 2)
    spark = df.sparkSession
    ty = F.broadcast(spark.createDataFrame(window_taps(h, ones), "_oy int, _iy int, _wy double"))
    tx = F.broadcast(spark.createDataFrame(window_taps(w, ones), "_ox int, _ix int, _wx double"))
    near = rows.join(ty, F.col("y") == F.col("_iy")).join(tx, F.col("x") == F.col("_ix")).withColumn("_w", F.col("_wy") * F.col("_wx"))
    by_bin = near.groupBy(*keys, F.col("_oy").alias("y"), F.col("_ox").alias("x"), "bin").agg(F.sum("_w").alias("c"), F.sum(F.col("_w") * F.col("v")).alias("s"), F.sum(F.col("_w") * F.col("v") * F.col("v")).alias("q"))
    p = F.col("c") / n
    mean = F.sum("s") / n
    return by_bin.groupBy(*keys, "y", "x").agg(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0)).alias("dev"), (-F.sum(p * F.ln(p))).alias("ent"))


def residual(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Residuals over frames with dev and ent: `avg`, `dev` (largest deviation, ties earlier) or `de` (mean of the frames that no frame beats in both)."""
    values = RGB
    if rule == "avg":
        return df.groupBy(*keys, "y", "x").agg(*[F.avg(v).alias(v) for v in values])
    if rule == "dev":
        best = F.max_by(F.struct(*values), F.struct("dev", (-F.col("frame")).alias("_f"))).alias("_b")
        return df.groupBy(*keys, "y", "x").agg(best).select(*keys, "y", "x", *[f"_b.{v}" for v in values])
    other = df.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "y", "x")], F.col("dev").alias("_dev"), F.col("ent").alias("_ent"))
    same = [F.col(k) == F.col(f"_{k}") for k in (*keys, "y", "x")]
    beaten = (F.col("_dev") >= F.col("dev")) & (F.col("_ent") >= F.col("ent")) & ((F.col("_dev") > F.col("dev")) | (F.col("_ent") > F.col("ent")))
    return df.join(other, [*same, beaten], "left_anti").groupBy(*keys, "y", "x").agg(*[F.avg(v).alias(v) for v in values])


def halo_weight(e: Column, power: float) -> Column:
    return F.exp(F.least(F.greatest(power * F.ln((e + 1e-8) / 1e-4), F.lit(-60.0)), F.lit(60.0)))


def halo_level(level: DataFrame, power: float, keys: list[str]) -> DataFrame:
    """Sum of w v over sum of w, instead of a winner."""
    w = halo_weight(F.col("e"), power)
    return level.groupBy(*keys, "y", "x").agg(*[(F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in RGB])


def fuse(df: DataFrame, h: int, w: int, levels: int, rule: str = "de", chroma: bool = False, r: int = 1, top_r: int = 2, bins: int = 64, halo: float | None = None, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """image, winners: the whole fold of a stack of frames."""
    keys = keys or []
    each = pyramid(df, h, w, levels, RGB, [*keys, "frame"])
    dims = sizes(h, w, levels)
    kept, winners = [], None
    for k, level in enumerate(each[:-1]):
        rated = region_energy(level, *dims[k], [*keys, "frame"], r, chroma)
        won = fold(rated, keys)
        winners = won if winners is None else winners
        kept.append((halo_level(rated, halo, keys) if halo else won).select(*keys, "y", "x", *RGB))
    top = each[-1]
    if rule == "avg":
        kept.append(residual(top, rule, keys))
    else:
        marks = deviation_entropy(top.select(*keys, "frame", "y", "x", luma(*[F.col(c) for c in RGB]).alias("v")), *dims[-1], top_r, bins, [*keys, "frame"])
        marks = marks.withColumn("dev", F.round("dev", 10)).withColumn("ent", F.round("ent", 10))
        kept.append(residual(top.join(marks, [*keys, "frame", "y", "x"]), rule, keys))
    image = collapse(kept, h, w, RGB, keys)
    return {"image": image.select(*keys, "y", "x", *[clamp(F.col(c)).alias(c) for c in RGB]), "winners": winners}
