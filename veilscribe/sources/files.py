"""JSONL, CSV, JSON and text sources with their rules for missing files, bad rows and types."""

from __future__ import annotations

import json
import os
import re
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilscribe import schemas
from veilscribe.functions.text import SPACE, rebased, strip
from veilscribe.operators.selection import numbered
from veilscribe.shared import checkpointed


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def _positioned(rows: DataFrame, pos: str | None) -> DataFrame:
    """With ``pos``: the place of each row over the files in the order of their names."""
    return rows if pos is None else numbered(rows.withColumns({"__f": F.col("_metadata.file_path"), "__b": F.col("_metadata.file_block_start"), "__i": F.monotonically_increasing_id()}), ["__f", "__b", "__i"], pos).drop("__f", "__b", "__i")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, *, tolerant: bool = False, pos: str | None = None) -> DataFrame:
    """Rows of JSON lines; a missing file is an empty table, blank lines are skipped.

    A malformed line raises, or with ``tolerant`` is left out.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([*schema.fields, *([StructField(pos, LongType())] if pos else [])]))
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return _positioned(reader.json(path), pos)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank, malformed ones too."""
    return spark.read.text(path).filter(F.trim("value") != "").count() if exists(spark, path) else 0


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; all columns are strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path)


def as_number(value: Column, kind: str = "double") -> Column:
    """A number from a string; 0 for what is none."""
    return F.coalesce(value.try_cast("double").try_cast(kind), F.lit(0).cast(kind))


def read_yaml(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_json(path: str) -> dict[str, Any]:
    """A JSON object from a local file; an empty one if it is missing or bad."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def read_manifest(spark: SparkSession, path: str, *, root: str, most: int = 0) -> DataFrame:
    """item_id, audio_path, duration_sec and the place in the file, of rows with an audio path.

    Relative paths are rebased; ids default to item_000000 by the row's place in the file
    with all rows; ``most`` counts after rows without audio are gone.
    """
    rows = read_jsonl(spark, path, schemas.MANIFEST, pos="_pos").filter(F.coalesce("audio_path", F.lit("")) != "")
    out = rows.withColumns({"item_id": F.coalesce("item_id", F.format_string("item_%06d", F.col("_pos"))), "audio_path": rebased(F.col("audio_path"), root)})
    return out.orderBy("_pos").limit(most) if most > 0 else out


def read_audio_folder(spark: SparkSession, folder: str, pattern: str = "*.wav", *, recursive: bool = True) -> DataFrame:
    """item_id, audio_path, bytes of files in the order of their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select(F.col("path").alias("audio_path"), F.col("length").alias("bytes"))
    return numbered(files, ["audio_path"], "__n").withColumn("item_id", F.format_string("local_%06d", F.col("__n"))).drop("__n")


def asr_inputs(spark: SparkSession, config: dict, *, root: str) -> DataFrame:
    """What the ``data`` part of a configuration names: a manifest or a folder; another ``source_type`` raises ValueError."""
    kind, most = config.get("source_type", "local_dir"), int(config.get("max_items") or 0)
    if kind == "manifest":
        return read_manifest(spark, config.get("manifest", {}).get("path", ""), root=root, most=most)
    if kind == "local_dir":
        folder, _, pattern = config.get("local", {}).get("audio_glob", "data/raw/**/*.wav").rpartition("/")
        found = read_audio_folder(spark, os.path.join(root, folder.removesuffix("/**")), pattern)
        return found.orderBy("audio_path").limit(most) if most > 0 else found
    raise ValueError(f"unsupported source_type: {kind}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """utt_id, textgrid_rel, wav_rel from lines of three words or more."""
    parts = F.split(F.trim(F.regexp_replace("value", f"{SPACE}+", " ")), " ")
    return spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 3).select(F.col("p")[0].alias("utt_id"), F.col("p")[1].alias("textgrid_rel"), F.col("p")[2].alias("wav_rel"))


def textgrid_text(content: Column) -> Column:
    """The text of all tiers, joined by spaces."""
    found = F.regexp_extract_all(content, F.lit(r'(?s)text\s*=\s*"(.*?)"'), 1)
    return F.array_join(F.filter(F.transform(found, strip), lambda t: t != ""), " ")


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), textgrid_text(F.col("value")).alias("text"))


def repaired_json(raw: Column) -> Column:
    """JSON with a comma between neighbouring objects or arrays that lack it; what parses stays as it is."""
    fixed = F.regexp_replace(F.regexp_replace(raw, r"(?U)\}(\s*)\{", "}$1,{"), r"(?U)\](\s*)\[", "]$1,[")
    return F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(fixed)


def read_json_arrays(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Rows of files that hold a JSON array each, repaired if need be; missing files are left out."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema)
    whole = spark.read.text(there, wholetext=True)
    return whole.select(F.inline(F.from_json(repaired_json(F.col("value")), f"array<{schema.simpleString()}>", {"mode": "FAILFAST"})))


def dataset_layout(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """Configurations of an exported dataset, each with its splits and their files.

    A configuration is a folder, and ``default`` for files that lie in ``path`` itself or in
    its folder ``data``; a split is a file's name up to the first dot or ``-00000``-like
    number.  Other files than Parquet, JSON and JSON lines do not count.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, out = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), {}
    if not found.exists(root):
        return out
    base, listed = found.getFileStatus(root).getPath().toUri().getPath().rstrip("/"), found.listFiles(root, True)
    while listed.hasNext():
        file = listed.next().getPath()
        *folders, name = file.toUri().getPath().removeprefix(base).strip("/").split("/")
        match = re.fullmatch(r"([^.]+?)(?:-\d+(?:-of-\d+)?)?\.(parquet|jsonl?|ndjson)", name)
        if match and not any(f.startswith(("_", ".")) for f in folders):
            out.setdefault("/".join(folders) if folders not in ([], ["data"]) else "default", {}).setdefault(match[1], []).append(file.toString())
    return {c: {k: sorted(v) for k, v in sorted(splits.items())} for c, splits in sorted(out.items())}


def read_exported(spark: SparkSession, path: str, *, split: str | None = None, config: str | None = None, subset: str | None = None) -> DataFrame:
    """A dataset exported as Parquet, or as JSON lines: a file or folder, or a split of a configuration.

    With ``split`` the configuration is ``subset`` if there is one of that name, else
    ``config``, else the first; what is not there raises ValueError, which a caller may
    answer with another source.
    """
    if split is None:
        return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)
    layout = dataset_layout(spark, path)
    chosen = subset if subset in layout else config if config is not None else next(iter(layout), None)
    names = layout.get(chosen, {}).get(split)
    if not names:
        raise ValueError(f"{path} has no split {split} in {chosen}; there are {({c: list(x) for c, x in layout.items()})}")
    return spark.read.parquet(*names) if names[0].endswith(".parquet") else spark.read.json(names)


# ------------------------------------------------------------------- benchmark references


def two_line_references(lines: DataFrame, *, file: str = "file", pos: str = "pos", text: str = "value") -> DataFrame:
    """utt_id, display, ref of files in which an indented line with the normal form follows nine digits, a tab and the text.

    Blank lines do not count; without such a line the display form in lower case stands
    in.  Of lines with one id the last wins.  ``lines`` has the file, the place and the text.
    """
    raw = F.col(text)
    bare = strip(raw)
    kept = lines.filter(bare != "")
    order = Window.partitionBy(file).orderBy(pos)
    follow = F.lead(raw).over(order)
    head = kept.withColumn("__next", follow).withColumn("__id", F.regexp_extract(bare, r"(?U)^(\d{9})\t(.+)$", 1)).filter("__id != ''")
    display = strip(F.regexp_extract(strip(F.col(text)), r"(?U)^(\d{9})\t(.+)$", 2))
    found = head.select(F.col("__id").alias("utt_id"), display.alias("display"), F.when(F.col("__next").startswith("\t") | F.col("__next").startswith(" "), strip(F.col("__next"))).alias("normal"), F.struct(F.col(file), F.col(pos)).alias("at"))
    last = found.groupBy("utt_id").agg(F.max_by(F.struct("display", "normal"), "at").alias("r"))
    return last.select("utt_id", "r.display", F.coalesce(F.nullif("r.normal", F.lit("")), F.lower("r.display")).alias("ref"))


def stamped_references(lines: DataFrame, *, stem: str = "stem", text: str = "value", shortest: float = 0.2) -> DataFrame:
    """seg_id, start_sec, end_sec, ref of lines ``[start,end]<tab>speaker<tab>gender<tab>text``; marks, speaker 0 and short ones are left out."""
    pattern = r"(?U)^\[([0-9]+(?:\.[0-9]+)?),([0-9]+(?:\.[0-9]+)?)\]\t(\d+)\t(\S+)\t(.+)$"
    line = strip(F.col(text))
    part = lambda i: F.regexp_extract(line, pattern, i)
    rows = lines.filter(line.rlike(pattern)).select(F.col(stem), part(1).cast("double").alias("start_sec"), part(2).cast("double").alias("end_sec"), part(3).alias("speaker"), strip(part(5)).alias("ref"))
    kept = rows.filter(~F.col("ref").startswith("[") & (F.col("speaker") != "0") & ~((F.col("end_sec") - F.col("start_sec")) < shortest))
    return kept.select(F.concat(F.col(stem), F.lit("_"), F.format_string("%09d", (F.col("start_sec") * 1000).cast("long"))).alias("seg_id"), "start_sec", "end_sec", "ref")


def resolve_audio(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Records with the audio_path of a listing (split, folder, stem, path): of their own split first, else dev for eval and eval for dev; mixed ids also under their other name."""
    number = F.regexp_extract("audio_id", r"(?U)^clip_mixed_mix_(\d+)$", 1)
    ids = F.array_compact(F.array(F.col("audio_id"), F.when(number != "", F.format_string("clip_mixed_%04d", number.try_cast("int")))))
    splits = F.array_compact(F.array(F.col("split"), F.when(F.col("split") == "dev", "eval").when(F.col("split") == "eval", "dev")))
    folder = F.when(F.col("language") == "en", "En").when(F.col("language") == "zh", "Zh").when(F.col("language") == "mixed", "Mix")
    options = F.flatten(F.transform(splits, lambda s, i: F.transform(ids, lambda a, j: F.struct((i * 2 + j).alias("rank"), s.alias("s"), a.alias("a")))))
    # written out, so that a row has one number however often it is read
    keyed = checkpointed(records.withColumn("__row", F.monotonically_increasing_id()))
    tried = keyed.select("__row", folder.alias("folder"), F.inline(options))
    best = tried.join(listing, (tried["s"] == listing["split"]) & (tried["folder"] == listing["folder"]) & (tried["a"] == listing["stem"])).groupBy("__row").agg(F.min_by("path", "rank").alias("audio_path"))
    return keyed.join(best, "__row").drop("__row")
