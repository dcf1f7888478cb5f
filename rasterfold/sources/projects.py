"""Project files: frames, and the settings of a run with them, as relations of one row a project or frame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.sources.heads import opened

# The fields of a project file and the names of its outputs that have no counterpart here.
_FLAGS = ("align", "shift", "scale", "rotation", "brightness", "use_chroma", "render_wav", "wav_edge", "render_dmap", "ov_bar")
_NUMBERS = ("coarsen", "rotate", "draft", "levels", "energy_radius", "top_radius", "halo", "depth_scale", "depth_level", "wav_power", "wav_smooth", "wav_gate", "split_n", "split_gap", "dust_thr", "dust_margin", "ov_um", "ov_size")
_TEXTS = ("interp", "model", "top", "split", "dust_mode", "ov_len", "ov_text", "ov_bar_pos", "ov_text_pos", "ov_color", "ov_style")
_ELSEWHERE = ("dfr", "winner", "anim-depth", "anim-focus", "anim-peak")
_PARAMS = ", ".join([f"{k}: boolean" for k in _FLAGS] + [f"{k}: double" for k in _NUMBERS] + [f"{k}: string" for k in _TEXTS])
_SAVE = ", ".join(f"`{k}`: string" for k in ("sv-format", "sv-meta", "sv-crop", "v3-near", "v3-shift", "v3-layout", "v3-rock", "v3-views", "m3-format", "m3-relief", "m3-grid", "m3-tex"))
_SCHEMA = f"name string, frames array<struct<name: string, path: string, off: boolean, note: string>>, params struct<{_PARAMS}>, save struct<sel: array<string>, {_SAVE}>, run struct<crop: struct<x: double, y: double, w: double, h: double>>, dust struct<name: string>"


def texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """project (its path) and text of project files."""
    return spark.read.text(paths, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("project"), F.col("value").alias("text"))


def _parsed(projects: DataFrame) -> DataFrame:
    """A project is marked by a field whose name ends in _project, with the value 1; anything else is an error."""
    marked = F.exists(F.map_entries(F.from_json("text", "map<string, string>")), lambda e: e["key"].endswith("_project") & (e["value"] == "1"))
    checked = F.when(marked, F.col("text")).otherwise(F.raise_error(F.concat(F.col("project"), F.lit(": not a project file"))).cast("string"))
    return projects.select("project", F.from_json(checked, _SCHEMA).alias("p"))


def settings(projects: DataFrame) -> DataFrame:
    """One row a project (project, text): what a run takes from it, null where the file says nothing, and notes on what is left out.

    fixed: the fields of a transform that aren't sought. window: cut out of the outputs, in pixels of the turned frame. split: how a list of frames
    falls into stacks. outputs: what is made besides the image. Fields of another type than expected count as absent.
    """
    p, s = (lambda k: F.col(f"p.params.{k}")), (lambda k: F.col(f"p.save.`{k}`"))
    positive = lambda v: F.when(v > 0, v)
    number = lambda k, default=None: F.coalesce(s(k).try_cast("double"), F.lit(default).cast("double"))
    has = lambda *names: F.coalesce(F.arrays_overlap(F.col("p.save.sel"), F.array(*[F.lit(n) for n in names])), F.lit(False))
    name = F.col("p.name")
    form = F.when(s("sv-format") == "jpeg", "jpg").when(s("sv-format") == "dng", "dng").otherwise("png")
    off = [(p("shift"), ["xoff", "yoff"]), (p("scale"), ["scale"]), (p("rotation"), ["rot"])]
    fixed = F.flatten(F.array(*[F.when(~c, F.array(*[F.lit(f) for f in fields])).otherwise(F.array().cast("array<string>")) for c, fields in off]))
    crop = [F.round(F.col(f"p.run.crop.{k}")).cast("int") for k in "xywh"]
    whole = crop[0].isNotNull() & crop[1].isNotNull() & crop[2].isNotNull() & crop[3].isNotNull()
    average = F.struct(p("wav_power").alias("power"), p("wav_smooth").alias("smooth"), p("wav_gate").alias("gate"), F.coalesce(p("wav_edge"), F.lit(True)).alias("edge"))
    split = F.when(p("split").isin("count", "gap", "dir"), F.struct(p("split").alias("by"), F.when(p("split") == "count", F.coalesce(p("split_n"), F.lit(30.0))).when(p("split") == "gap", F.coalesce(p("split_gap"), F.lit(10.0))).alias("size")))
    dust = F.struct(F.col("p.dust.name").alias("map"), p("dust_thr").alias("threshold"), p("dust_margin").alias("margin"), p("dust_mode").alias("mode"))
    bar = F.when(p("ov_bar"), F.struct(positive(p("ov_um")).alias("um"), F.nullif(F.trim(p("ov_len")), F.lit("")).alias("length")))
    outputs = F.array_compact(F.array(F.when(has("depth", "depth16"), "depth"), F.when(has("conf"), "confidence"), F.when(has("stereo"), "stereo"), F.when(has("anim-rock"), "rocking"), F.when(has("mesh"), "mesh")))
    left = F.array_join(F.array_intersect(F.array(*[F.lit(k) for k in _ELSEWHERE]), F.col("p.save.sel")), ", ")
    notes = F.array_compact(F.array(F.when(p("render_dmap"), "the depth-map rendering isn't made"), F.when(left != "", F.concat(F.lit("left out: "), left))))
    return _parsed(projects).select(
        "project", name.alias("name"), F.concat(name, F.lit("_stacked."), form).alias("output"),
        F.coalesce(p("align"), F.lit(True)).alias("align"), fixed.alias("fixed"), F.coalesce(p("brightness"), F.lit(True)).alias("brightness"), p("coarsen").cast("int").alias("coarsen"), p("interp").alias("kernel"), p("model").alias("model"),
        positive(p("rotate")).alias("rotate"), positive(p("draft")).cast("int").alias("draft"), positive(p("levels")).cast("int").alias("levels"), p("energy_radius").cast("int").alias("energy_radius"), p("top").alias("rule"), p("top_radius").cast("int").alias("top_radius"), F.coalesce(p("use_chroma"), F.lit(False)).alias("chroma"), positive(p("halo")).alias("halo"),
        p("depth_scale").cast("int").alias("depth_scale"), p("depth_level").cast("int").alias("depth_level"), F.when(p("render_wav"), average).alias("average"), split.alias("split"), F.when(F.col("p.dust.name").isNotNull(), dust).alias("dust"), bar.alias("bar"), F.nullif(p("ov_text"), F.lit("")).alias("caption"),
        F.when(whole, F.struct(*[c.alias(k) for c, k in zip(crop, "xywh")])).alias("window"), (F.coalesce(s("sv-crop"), F.lit("true")) != "false").alias("crop"), (F.coalesce(s("sv-meta"), F.lit("true")) != "false").alias("metadata"), F.when(s("v3-near").isin("first", "last"), s("v3-near") == "first").alias("near_first"),
        outputs.alias("outputs"), F.when(has("stereo"), F.struct(number("v3-shift", 3.0).alias("shift"), F.coalesce(s("v3-layout"), F.lit("sbs")).alias("layout"))).alias("stereo"), F.when(has("anim-rock"), F.struct(number("v3-rock", 3.0).alias("shift"), number("v3-views", 24.0).cast("int").alias("views"))).alias("rocking"),
        F.when(has("mesh"), F.struct(F.coalesce(s("m3-format"), F.lit("glb")).alias("form"), number("m3-relief").alias("relief"), number("m3-grid").cast("int").alias("grid"), positive(number("m3-tex")).cast("int").alias("texture"))).alias("mesh"), notes.alias("notes"),
    )


def frames(projects: DataFrame) -> DataFrame:
    """project, frame (from 0), name, path, note of the frames that aren't switched off; without a path the name is one."""
    shown = F.filter("p.frames", lambda f: ~F.coalesce(f["off"], F.lit(False)))
    rows = _parsed(projects).select("project", F.posexplode(shown).alias("frame", "f"))
    name = F.coalesce("f.name", F.lit(""))
    return rows.select("project", "frame", name.alias("name"), F.coalesce("f.path", name).alias("path"), "f.note")


def resolved(listed: DataFrame) -> DataFrame:
    """Adds file: where a frame lies, by its path or its name beside the project or by its path alone, and found, whether there is a file.

    Files must be on paths or addresses that executors can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, found = [], []
            for project, name, path in zip(*(batch[c].to_pylist() for c in ("project", "name", "path"))):
                beside = f"{project.rpartition('/')[0]}/"
                places = [path if path.startswith("/") else beside + path, beside + name, path]
                held = [at for at in places if (lambda system, own: system.get_file_info(own).type == fs.FileType.File)(*opened(at))]
                files.append((held or places)[0])
                found.append(bool(held))
            yield batch.append_column("file", pa.array(files, pa.string())).append_column("found", pa.array(found))

    kinds = ", ".join(f"`{c}` {t}" for c, t in listed.dtypes)
    return listed.mapInArrow(run, f"{kinds}, file string, found boolean")


def missing_note(listed: DataFrame) -> DataFrame:
    """project and note: how many of a project's frames weren't found; projects that have all of theirs have no row."""
    n = F.count_if(~F.col("found"))
    return listed.groupBy("project").agg(n.alias("_n")).filter("_n > 0").select("project", F.concat(F.col("_n"), F.lit(" of the project's frames aren't beside the project file")).alias("note"))
