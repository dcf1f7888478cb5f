"""Scale bars and what is burnt into pictures: lengths of bars, coverage of outlines, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.operators.batch import length_label, nice_floor, nice_length

RGB = ["r", "g", "b"]
# The colours of ink and of what lies behind it, how opaque a box is, and sizes in heights of the letters.
INKS = {"white": (1.0, 0.0), "black": (0.0, 1.0)}
BOX_OPACITY = 0.6
MARGIN, BOX_PAD, HALO = 0.8, 0.35, 0.05


def letter_height(h: Column, size: Column) -> Column:
    """Pixels of the letters of a picture h high, of which they take the share `size`."""
    return F.greatest(F.least(F.greatest(size, F.lit(0.002)), F.lit(0.5)) * h, F.lit(4.0))


def halo_radius(em: Column) -> Column:
    return F.greatest(F.floor(HALO * em + 0.5), F.lit(1)).cast("int")


def bar(um: Column, wanted: Column, w: Column, h: Column, size: Column, style: str, scale: Column | None = None) -> Column:
    """length (micrometres; pixels of the frames where um isn't given), px and label of a bar in a picture of w x h.

    um: micrometres of a frame's pixel. wanted: the length asked for; else the round length nearest a fifth of the width. What doesn't
    fit becomes the longest round length that does. scale: pixels of the picture for one of the frames.
    """
    em = letter_height(h, size)
    pad = {"plain": F.lit(1.0), "halo": halo_radius(em) + 1.0, "box": BOX_PAD * em + 1}[style]
    known = F.coalesce(um > 0, F.lit(False))
    each = F.when(known, um).otherwise(1.0) / (F.lit(1.0) if scale is None else scale)
    most = F.greatest(w - 2 * MARGIN * em - 2 * pad, F.lit(2.0)) * each
    first = F.when(wanted > 0, wanted).otherwise(nice_length(0.2 * w * each))
    # Bound once: the label's expression uses the length many times.
    fitting = F.transform(F.array(F.struct(first.alias("a"), most.alias("b"))), lambda s: F.when(s["a"] > s["b"], nice_floor(s["b"])).otherwise(s["a"]))
    pixels = lambda v: F.greatest(F.floor(v / each + 0.5), F.lit(1)).cast("int")
    plain = lambda v: F.concat(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"\.?0+$", ""), F.lit(" px"))
    return F.get(F.transform(fitting, lambda v: F.struct(v.alias("length"), pixels(v).alias("px"), F.when(known, length_label(v)).otherwise(plain(v)).alias("label"))), F.lit(0))


def coverage(outlines: DataFrame, h: int, w: int, keys: list[str]) -> DataFrame:
    """keys, y, x, cover (0 to 1) of the pixels of a frame that upright rectangles (keys, x0, y0, x1, y1) touch; where several do, the greatest counts."""
    span = lambda lo, hi, n: F.sequence(F.greatest(F.floor(lo), F.lit(0)).cast("int"), F.least(F.ceil(hi), F.lit(n)).cast("int") - 1)
    inside = outlines.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("x1") > 0) & (F.col("y1") > 0) & (F.col("x0") < w) & (F.col("y0") < h))
    cells = inside.withColumn("y", F.explode(span(F.col("y0"), F.col("y1"), h))).withColumn("x", F.explode(span(F.col("x0"), F.col("x1"), w)))
    part = lambda c, lo, hi: F.least(F.col(c) + 1.0, F.col(hi)) - F.greatest(F.col(c) + 0.0, F.col(lo))
    return cells.groupBy(*keys, "y", "x").agg(F.max(part("x", "x0", "x1") * part("y", "y0", "y1")).alias("cover"))


def halo(cover: DataFrame, r: int, h: int, w: int, keys: list[str]) -> DataFrame:
    """The coverage grown by a disk: the greatest within r pixels, soft edges included."""
    disk = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]
    near = cover.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy, dx in disk])))
    near = near.select(*keys, (F.col("y") + F.col("_d.y")).alias("y"), (F.col("x") + F.col("_d.x")).alias("x"), "cover")
    return near.filter(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)).groupBy(*keys, "y", "x").agg(F.max("cover").alias("cover"))


def burn(pixels: DataFrame, ink: DataFrame, behind: DataFrame | None, colour: str, style: str, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x, r, g, b) under a coverage of ink and what lies behind it, which is blended first; all others stay as they are."""
    at = [*keys, "y", "x"]
    front, back = INKS[colour]
    both = ink.select(*at, F.col("cover").alias("_ink"))
    if behind is not None:
        both = both.join(behind.select(*at, F.col("cover").alias("_back")), at, "full")
    else:
        both = both.withColumn("_back", F.lit(0.0))
    k = F.coalesce("_back", F.lit(0.0)) * (BOX_OPACITY if style == "box" else 1.0)
    i = F.coalesce("_ink", F.lit(0.0))
    return pixels.join(both, at, "left").select(*at, *[((F.col(c) * (1 - k) + back * k) * (1 - i) + front * i).alias(c) for c in RGB])
