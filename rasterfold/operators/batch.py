"""Frame lists: order, skipping, splitting into stacks, names; capture times and other metadata in text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterfold.operators.order import numbered, running

IMAGE_TYPES = ("png", "jpg", "jpeg", "tif", "tiff")


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def dir_name(path: Column) -> Column:
    d = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*IMAGE_TYPES)


def natural_key(path: Column) -> Column:
    """A string whose order is the natural order: a run of digits becomes `0`, the length of its value and the value."""
    tokens = F.regexp_extract_all(path, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(t: Column) -> Column:
        value = F.regexp_replace(t, "^0+(?=.)", "")
        return F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(value).cast("string"), 3, "0"), value)).otherwise(t)

    return F.array_join(F.transform(tokens, key), "")


def natural_order(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Adds n, the place in natural order; equal names keep their order."""
    placed = numbered(df.withColumn("_natural", natural_key(F.col("path"))), ["_natural", position], "n", keys)
    return placed.drop("_natural")


def expanded(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """n and path: several inputs (place, path, is_dir) in order, a folder replaced by the images directly in it (of files: path) in natural order.

    Other inputs stay where they are, and an input given twice is there twice. A folder without images is an error.
    """
    images = files.filter(is_image(F.col("path"))).select(folder(F.col("path")).alias("_d"), F.col("path").alias("_f"))
    given = inputs.select("place", F.when(F.col("is_dir"), F.regexp_replace("path", "/+$", "")).otherwise(F.col("path")).alias("path"), "is_dir")
    found = given.join(images, F.col("is_dir") & (F.col("path") == F.col("_d")), "left")
    path = F.when(~F.col("is_dir"), F.col("path")).when(F.col("_f").isNull(), F.raise_error(F.concat("path", F.lit(" holds no images"))).cast("string")).otherwise(F.col("_f"))
    listed = found.select("place", path.alias("path"))
    return numbered(listed.withColumn("_natural", natural_key(F.col("path"))), ["place", "_natural", "path"], "n").select("n", "path")


def skip_list(spec: str, n: int) -> list[int]:
    """0-based frames of a list like 3,7-9,12; backward or overlong ranges are errors."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        ends = [e.strip() for e in part.split("-", 1)]
        if not all(e.isdigit() and int(e) >= 1 for e in ends):
            raise ValueError(f"'{part}' is not a frame or a range a-b, counted from 1")
        a, b = int(ends[0]), int(ends[-1])
        if b < a or b > n:
            raise ValueError(f"'{part}' runs backward or past the {n} frames")
        out.update(range(a - 1, b))
    return sorted(out)


def without(df: DataFrame, frames: list[int], column: str = "frame") -> DataFrame:
    gone = df.sparkSession.createDataFrame([(f,) for f in frames], "_gone int")
    return df.join(F.broadcast(gone), F.col(column) == F.col("_gone"), "left_anti")


def split_gap(df: DataFrame, gap: float, keys: list[str]) -> DataFrame:
    """Adds stack: a new one wherever the time steps by more than gap, in either direction."""
    order = Window.partitionBy(*keys).orderBy("frame")
    step = F.when(F.abs(F.col("t") - F.lag("t").over(order)) > gap, 1).otherwise(0)
    return df.withColumn("_s", step).withColumn("stack", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def split_count(df: DataFrame, n: int, keys: list[str], order: str = "frame") -> DataFrame:
    placed = numbered(df, [order], "_place", keys)
    return placed.withColumn("stack", F.floor(F.col("_place") / max(n, 1)).cast("long")).drop("_place")


def split_dir(df: DataFrame, position: str, consecutive: bool = False) -> DataFrame:
    """Adds stack: one a folder, in the order in which folders first appear; or one for each run of a folder."""
    at = df.withColumn("_d", folder(F.col("path")))
    if consecutive:
        placed = numbered(at, [position], "_at")
        before = placed.select((F.col("_at") + 1).alias("_at"), F.col("_d").alias("_before"))
        new = placed.join(before, "_at", "left").withColumn("_new", F.coalesce(F.col("_d") != F.col("_before"), F.lit(False)).cast("long"))
        return running(new, ["_at"], "stack", F.col("_new")).withColumn("stack", F.col("stack") + F.col("_new")).select(*df.columns, "stack")
    first = numbered(at.groupBy("_d").agg(F.min(position).alias("_p")), ["_p"], "stack").drop("_p")
    return at.join(first, "_d").select(*df.columns, "stack")


def split_info(df: DataFrame, keys: list[str]) -> DataFrame:
    """step: the upper median of the steps within stacks; pause: the longest step of all."""
    order = Window.partitionBy(*keys).orderBy("frame")
    d = df.select(*keys, F.abs(F.col("t") - F.lag("t").over(order)).alias("d"), (F.col("stack") == F.lag("stack").over(order)).alias("same")).filter("d is not null")
    ranked = d.filter("same").select(*keys, "d", F.row_number().over(Window.partitionBy(*keys).orderBy("d")).alias("r"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    return d.groupBy(*keys).agg(F.max("d").alias("pause")).join(ranked.filter("r - 1 = n div 2").select(*keys, F.col("d").alias("step")), keys, "left")


def reverse(df: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("frame", (n - 1 - F.col("frame")).cast("int"))


def cull(frames: DataFrame, shares: DataFrame, percent: float) -> DataFrame:
    """Frames with a share of at least percent; all gone is an error."""
    kept = shares.filter(F.col("share") * 100 >= percent)
    if not kept.limit(1).count():
        raise ValueError("no frame holds so large a share")
    return frames.join(F.broadcast(kept.select("frame")), "frame", "left_semi")


def output_name(template: Column, n: Column, count: Column, first: Column, directory: Column) -> Column:
    """{n}, {first} and {dir} replaced; without them _NN goes before the extension if there are several."""
    width = F.greatest(F.length(F.greatest(count, F.lit(1)).cast("string")), F.lit(2))
    digits = n.cast("string")
    number = F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0"))  # lpad alone would cut longer numbers
    filled = F.replace(F.replace(F.replace(template, F.lit("{n}"), number), F.lit("{first}"), first), F.lit("{dir}"), directory)
    numbered = F.when(template.rlike(r"[^/\\]\.[^./\\]*$"), F.concat(F.regexp_extract(template, r"^(.*[^/\\])(\.[^./\\]*)$", 1), F.lit("_"), number, F.regexp_extract(template, r"(\.[^./\\]*)$", 1))).otherwise(F.concat(template, F.lit("_"), number))
    return F.when(template.rlike(r"\{(n|first|dir)\}"), filled).when(count < 2, template).otherwise(numbered)


def clock(t: Column) -> Column:
    s = F.floor(F.pmod(t, F.lit(86400.0))).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60)


def caption(text: Column, t: Column, frames: Column, first: Column, n: Column) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n"))
    date = F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd")
    for field, value in (("{date}", F.coalesce(date, F.lit(""))), ("{time}", F.coalesce(clock(t), F.lit(""))), ("{frames}", frames.cast("string")), ("{first}", first), ("{n}", n.cast("string"))):
        out = F.replace(out, F.lit(field), value)
    return out


_WHEN = r"^(\d{4}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).(\d{2})(?:\.(\d*))?"


def parse_time(s: Column, sub: Column) -> Column:
    """Seconds since 1970 of an EXIF or XMP time without a zone; null if a part is out of range."""
    y, mo, d, h, mi, sec = (F.regexp_extract(s, _WHEN, k).try_cast("int") for k in range(1, 7))
    ok = s.rlike(_WHEN) & mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (sec <= 60)
    # Day numbers by the civil calendar, so that 31 February counts on into March as an odd camera clock would.
    a = F.when(mo <= 2, y - 1).otherwise(y)
    m = F.pmod(mo + 9, F.lit(12))
    days = 365 * a + F.floor(a / 4) - F.floor(a / 100) + F.floor(a / 400) + F.floor((153 * m + 2) / 5) + d - 1 - 719468
    own = F.regexp_extract(s, _WHEN, 7)
    other = F.regexp_extract(F.trim(F.coalesce(sub, F.lit(""))), r"^(\d*)", 1)
    digits = F.when(F.substring(s, 20, 1) == ".", own).otherwise(other)
    fraction = F.when(digits == "", 0.0).otherwise(F.concat(F.lit("0."), digits).try_cast("double"))
    return F.when(ok, (days * 86400 + h * 3600 + mi * 60 + sec).cast("double") + fraction)


def capture_time(original: Column, digitised: Column, plain: Column, xmp: Column, modified: Column) -> Column:
    return F.coalesce(original, digitised, plain, xmp, modified)


def subject_distance(text: Column) -> Column:
    """Metres from a rational or a number; zero denominators and infinities are no distance."""
    a, b = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(?:/|$)", 1).try_cast("double"), F.coalesce(F.regexp_extract(text, r"/\s*([0-9.]+)\s*$", 1).try_cast("double"), F.lit(1.0))
    v = F.when(b != 0, a / F.when(b != 0, b))
    return F.when((v > 0) & (a < 4294967295), v)


def pixel_size(description: Column, make: Column, x_resolution: Column, resolution_unit: Column) -> Column:
    """um and source: micrometres a pixel from what a microscope's software wrote into a TIFF file; null where nothing usable is written.

    The first that applies counts: PhysicalSizeX of an OME description, in its PhysicalSizeXUnit or micrometres; pixels a unit of a
    description by ImageJ; the plain resolution, an inch (2) or a centimetre (3), unless a camera made the file.
    """
    text = F.coalesce(description, F.lit(""))
    size = F.trim(F.regexp_extract(text, r'PhysicalSizeX="([^"]*)"', 1)).try_cast("double")
    given = F.regexp_extract(text, r'PhysicalSizeXUnit="([^"]*)"', 1)
    ome_unit = F.when(text.contains('PhysicalSizeXUnit="'), unit_um(given)).otherwise(1.0)
    each = F.when(x_resolution > 0, x_resolution)
    line = F.regexp_extract(text, r"(?:^|\n)unit=([^\r\n]*)", 1)
    plain = F.when(resolution_unit == 2, 25400.0).when(resolution_unit == 3, 1e4)

    def found(um: Column, name: str) -> Column:
        return F.when(um.isNotNull(), F.struct(um.alias("um"), F.lit(name).alias("source")))

    return F.when(size > 0, found(size * ome_unit, "OME-XML")).when(text.startswith("ImageJ"), found(unit_um(line) / each, "ImageJ")).when(make.isNull(), found(plain / each, "TIFF resolution"))


def near_end(df: DataFrame, keys: list[str]) -> DataFrame:
    """near_first: whether the first frame with a distance is nearer than the last; null if neither is."""
    ends = df.filter("dist is not null").groupBy(*keys).agg(F.min_by("dist", "frame").alias("a"), F.max_by("dist", "frame").alias("b"))
    return ends.select(*keys, F.when(F.col("a") < F.col("b"), True).when(F.col("a") > F.col("b"), False).alias("near_first"))


# Units of length in micrometres.
UNITS = {"nm": 1e-3, "um": 1.0, "µm": 1.0, "micron": 1.0, "microns": 1.0, "mm": 1e3, "cm": 1e4, "m": 1e6, "in": 25400.0, "inch": 25400.0, "inches": 25400.0, "angstrom": 1e-4, "å": 1e-4}


def unit_um(u: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    return F.try_element_at(known, F.lower(F.rtrim(F.trim(u), F.lit("."))))


def length_um(s: Column) -> Column:
    """Micrometres of a length such as `2.5 mm`; without a unit it is in micrometres; null if it isn't a positive length."""
    pattern = r"^\s*([-+0-9.,eE]+)\s*(.*)$"
    v = F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.trim(F.regexp_extract(s, pattern, 2))
    out = v * F.when(unit == "", 1.0).otherwise(unit_um(unit))
    return F.when(out > 0, out)


def nice_length(target: Column) -> Column:
    """The 1-2-5 value nearest in the logarithm; 1 for what isn't positive."""
    l10 = F.log10(F.when(target > 0, target))
    e = F.floor(l10)
    best = F.array_min(F.array(*[F.struct(F.round(F.abs(F.log10(F.lit(m)) + e - l10), 12).alias("d"), (m * F.pow(F.lit(10.0), e)).alias("v")) for m in (1.0, 2.0, 5.0, 10.0)]))
    return F.coalesce(best["v"], F.lit(1.0))


def nice_floor(most: Column) -> Column:
    base = F.pow(F.lit(10.0), F.floor(F.log10(F.when(most > 0, most))))
    top = most * (1 + 1e-9)
    return F.coalesce(F.when(5 * base <= top, 5 * base).when(2 * base <= top, 2 * base).otherwise(base), F.lit(1.0))


def length_label(um: Column) -> Column:
    """Micrometres as text, in the unit that keeps the number under 1000: up to three significant digits, no zeros at the end."""
    units = F.array(*[F.struct(F.lit(most).alias("most"), F.lit(size).alias("of"), F.lit(name).alias("name")) for most, size, name in ((1.0, 1e-3, "nm"), (1e3, 1.0, "µm"), (1e6, 1e3, "mm"), (math.inf, 1e6, "m"))])
    fitting = F.transform(F.array(F.when(um > 0, um)), lambda u: F.transform(F.slice(F.filter(units, lambda k: u < k["most"]), 1, 1), lambda k: F.struct((u / k["of"]).alias("v"), k["name"].alias("name"))))

    def text(v: Column) -> Column:
        places = F.least(F.greatest(2 - F.floor(F.log10(v)), F.lit(0)), F.lit(6)).cast("int")
        short = F.get(F.array(*[F.round(v, k) for k in range(7)]), places)
        number = F.when(F.abs(v - F.round(v)) < 1e-6 * F.greatest(v, F.lit(1.0)), F.round(v)).otherwise(short)
        return F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")  # doubles would print an exponent

    return F.get(F.flatten(F.transform(fitting, lambda f: F.transform(f, lambda k: F.concat_ws(" ", text(k["v"]), k["name"])))), F.lit(0))


# ---- short specifications -----------------------------------------------------------------------


def focus_measure(spec: Column) -> Column:
    """kind, inner, outer of `rdf[:inner[:outer]]` (outer is 2 more unless given, and larger) or kind, step of `sml[:step]`; null if it is neither."""
    parts = F.split(spec, ":")
    number = lambda k, default: F.when(F.size(parts) <= k, default).when(F.get(parts, F.lit(k)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(k)).try_cast("int"))
    inner, kind, none = number(1, F.lit(1)), F.get(parts, F.lit(0)), F.lit(None).cast("int")
    outer = number(2, inner + 2)
    of = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, ("kind", "inner", "outer", "step"))])
    return F.when((kind == "rdf") & (outer > inner), of(F.lit("ring"), inner, outer, none)).when((kind == "sml") & inner.isNotNull(), of(F.lit("laplacian"), none, none, inner))


def upsampling(spec: Column) -> Column:
    """radius, eps of `guided[:radius[:eps]]`; radius 0 and no eps for `bilinear`; null if it is neither."""
    parts = F.split(spec, ":")
    kind, last = F.get(parts, F.lit(0)), F.size(parts)
    radius = F.when(last <= 1, 2).when(F.get(parts, F.lit(1)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(1)).try_cast("int"))
    eps = F.when(last <= 2, 1e-2).otherwise(F.get(parts, F.lit(2)).try_cast("double"))
    of = lambda r, e: F.struct(r.cast("int").alias("radius"), e.alias("eps"))
    return F.when(kind == "bilinear", of(F.lit(0), F.lit(None).cast("double"))).when((kind == "guided") & radius.isNotNull() & eps.isNotNull(), of(radius, eps))
