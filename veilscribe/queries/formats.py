"""Sources and sinks as round trips, and operators on what they hold.

Each query writes a table in a format to the shared folder, reads it back and derives
columns that SQL finds in the table itself.
"""

from __future__ import annotations

import io
import os
import posixpath
import tarfile
import uuid
import wave

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilscribe.functions import labels, spans
from veilscribe.functions.matches import find_spans
from veilscribe.functions.text import better_retry, names_of_ids, needs_retry
from veilscribe.operators import diagnostics, masking, scoring, selection, transcripts
from veilscribe.operators.masking import MaskOptions
from veilscribe.operators.rules import RULES
from veilscribe.queries._tables import rounded, spread, table
from veilscribe.schemas import WORD
from veilscribe.shared import checkpoint_folder, checkpointed
from veilscribe.sources import audio, files, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return posixpath.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def q_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through JSON lines, with lists and nulls."""
    path = _folder(spark, "jsonl")
    rows = _customers(spark, sf_dir).select("k", F.when(F.col("k") % 3 > 0, F.col("name")).alias("name"), F.array(F.col("k"), F.col("k") + 1).alias("pair"))
    sinks.write_jsonl(rows, path)
    back = files.read_jsonl(spark, path, StructType.fromDDL("k long, name string, pair array<long>"), pos="_pos")
    return back.select("k", "name", (F.get("pair", F.lit(1)) - F.get("pair", F.lit(0))).alias("step"))


def q_json_lines_of_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which every third is broken: how many there are, and how many are read."""
    path = _folder(spark, "broken")
    _customers(spark, sf_dir).select(F.when(F.col("k") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("k"))).alias("value")).write.text(path)
    good = files.read_jsonl(spark, path, StructType.fromDDL("k long"), tolerant=True)
    return good.agg(F.count("k").alias("n_read"), F.sum("k").alias("sum_k")).withColumn("n_lines", F.lit(files.count_lines(spark, path)).cast("long"))


def q_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through CSV, with quotes, commas and line breaks in a field."""
    path = _folder(spark, "csv")
    sinks.write_csv(_customers(spark, sf_dir).select("k", F.concat(F.lit('say "'), "name", F.lit('",\nagain')).alias("text"), "balance"), path)
    back = files.read_csv(spark, path, ["k", "text", "balance"])
    return back.select(F.col("k").cast("long").alias("k"), F.md5("text").alias("text_md5"), F.round(files.as_number(F.col("balance")), 2).alias("balance"))


def q_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one JSON array in which every comma between objects is missing."""
    path = _folder(spark, "array")
    rows = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("j"))
    rows.groupBy().agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), "\n"), F.lit("]")).alias("value")).write.text(path)
    return files.read_json_arrays(spark, [posixpath.join(path, "*.txt")], StructType.fromDDL("k long, name string"))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of suppliers: rows without audio go, ids of their own stay, and relative paths are rebased."""
    path = _folder(spark, "manifest")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("item_id"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("audio/"), "s_suppkey", F.lit(".wav"))).alias("audio_path"), (F.col("s_suppkey") * 1.5).alias("duration_sec")
    )
    sinks.write_jsonl(rows, path)
    return files.read_manifest(spark, path, root="/data/root").select("item_id", "audio_path", "duration_sec")


def q_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an index; those of two words are none."""
    path = _folder(spark, "index")
    k = F.col("s_suppkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("only "), k)).otherwise(F.concat(F.lit("u"), k, F.lit("  g/"), k, F.lit(".TextGrid\t w/"), k, F.lit(".wav more")))
    table(spark, sf_dir, "supplier").select(line.alias("value")).write.text(path)
    return files.read_index(spark, path)


def q_textgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the tiers of annotation files made of nations' names."""
    content = F.concat(F.lit('item []:\n text = "'), "n_name", F.lit('"\n xmax = 3\n text = ""\n text="  '), F.lower("n_name"), F.lit('\n here "'))
    return table(spark, sf_dir, "nation").select("n_nationkey", files.textgrid_text(content).alias("text"))


def q_two_line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in two lines, of which every other one lacks its normal form."""
    k = F.col("s_suppkey")
    head = F.struct((k * 2).alias("pos"), F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("\t"), F.col("s_name"), F.lit(" Says ")).alias("value"))
    normal = F.struct((k * 2 + 1).alias("pos"), F.when(k % 2 == 0, F.concat(F.lit("\tnormal "), k)).otherwise(F.lit("  ")).alias("value"))
    lines = table(spark, sf_dir, "supplier").select(F.lit("f").alias("file"), F.inline(F.array(head, normal)))
    return files.two_line_references(lines)


def q_stamped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with times; speaker 0, marks and short ones go."""
    k = F.col("s_suppkey")
    text = F.when(k % 7 == 0, F.lit("[noise]")).otherwise(F.concat(F.lit("hello "), k))
    line = F.concat(F.lit("["), k, F.lit("."), k % 10, F.lit(","), k + F.when(k % 3 == 0, 0).otherwise(2), F.lit(".9]\t"), k % 4, F.lit("\tfemale\t"), text)
    found = files.stamped_references(table(spark, sf_dir, "supplier").select(F.lit("r").alias("stem"), line.alias("value")), shortest=0.5)
    return rounded(found)


def _store(files_: dict[str, bytes], folder: str) -> None:
    """A few small files into the shared folder."""
    where, path = pafs.FileSystem.from_uri("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)
    for name, data in files_.items():
        where.create_dir(posixpath.dirname(posixpath.join(path, name)), recursive=True)
        with where.open_output_stream(posixpath.join(path, name), compression=None) as out:
            out.write(data)


def _tone(rate: int, seconds: float, width: int, channels: int) -> bytes:
    top = {1: 127, 2: 32767, 3: 2**23 - 1, 4: 2**31 - 1}[width]
    samples = np.repeat(np.rint(np.sin(np.arange(int(rate * seconds)) * 0.1) * top * 0.5)[:, None], channels, axis=1)
    samples = (samples + 128).astype(np.uint8) if width == 1 else samples.astype({2: "<i2", 3: "<i4", 4: "<i4"}[width])
    return masking.write_wave(samples, wave._wave_params(channels, width, rate, len(samples), "NONE", ""))


#: Sampling rates by key, and bytes of a sample.
_RATES, _WIDTHS = (8000, 16000, 22050), (1, 2, 3, 4)


def _waves(spark, sf_dir, name: str) -> str:
    """A recording for each nation, of key / 10 + 1 seconds, rate and width by the key."""
    folder = _folder(spark, name)
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    _store({f"n{k:02d}.wav": _tone(_RATES[k % 3], k / 10 + 1, _WIDTHS[k % 4], 1 + k % 2) for k in keys}, folder)
    return folder


def _key_of(path: str = "path"):
    return F.regexp_extract(path, r"n(\d+)[^/]*\.wav$", 1).cast("int")


def q_wave_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds and rates of recordings from their headers."""
    found = audio.read_headers(spark, _waves(spark, sf_dir, "headers"))
    return rounded(found.select(_key_of().alias("k"), "duration_sec", "sampling_rate"), 4)


def q_audio_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of a folder in the order of their names."""
    return files.read_audio_folder(spark, _waves(spark, sf_dir, "folder")).select("item_id", _key_of("audio_path").alias("k"))


def q_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of any rate, width and number of channels as 16 kHz mono: their lengths."""
    found = audio.normalised(spark, _waves(spark, sf_dir, "decoded"))
    # a header of 44 bytes, two bytes a sample
    return found.select(_key_of().alias("k"), F.round((F.octet_length("content") - 44) / 32000, 1).alias("seconds"))


def _loud(content: pd.Series) -> pd.Series:
    out = []
    for data in content:
        samples, params = masking.read_wave(data)
        zero = 128 if params.sampwidth == 1 else 0
        out.append(float(np.abs(samples.astype(np.int64) - zero)[: params.framerate // 2].max()))
    return pd.Series(out)


def q_masked_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with the first half second masked where their key is even, of a missing file where it is 24: how each went out, and whether it still sounds there."""
    folder, out = _waves(spark, sf_dir, "sources"), _folder(spark, "masked")
    keyed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    local = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
    name = F.concat(F.lit(local + "/n"), F.lpad(F.col("k").cast("string"), 2, "0"), F.when(F.col("k") == 24, "gone.wav").otherwise(".wav"))
    one = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.5).alias("end")))
    audit = keyed.select("k", name.alias("source_audio"), F.when(F.col("k") % 2 == 0, one).otherwise(F.slice(one, 1, 0)).alias("all_intervals"))
    done = checkpointed(masking.mask_files(audit, out, MaskOptions(), root=local).select("k", "method"))
    sound = F.pandas_udf(_loud, "double")
    heard = spark.read.format("binaryFile").load(out).select(_key_of().alias("at"), (sound("content") > 0).alias("sounds"))
    return done.join(heard, F.col("k") == F.col("at"), "left").select("k", "method", F.coalesce("sounds", F.lit(False)).alias("sounds"))


def q_split_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their texts out of an archive in three parts, joined to their index; one recording is missing and one text."""
    folder = _folder(spark, "archive")
    local = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
    keys = [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    members = {f"w/{k}.wav": b"RIFF" * (k + 1) for k in keys if k != 1} | {f"g/{k}.TextGrid": f'text = "region {k}"'.encode() for k in keys if k != 2}
    with tarfile.open(fileobj=(raw := io.BytesIO()), mode="w:gz") as tar:
        for name, data in members.items():
            (about := tarfile.TarInfo(name)).size = len(data)
            tar.addfile(about, io.BytesIO(data))
    data = raw.getvalue()
    third = -(-len(data) // 3)
    parts = {f"a.tar.gz.{i}": data[i * third : (i + 1) * third] for i in range(3)}
    _store(parts, folder)
    index = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("w/"), "r_regionkey", F.lit(".wav")).alias("wav_rel"), F.concat(F.lit("g/"), "r_regionkey", F.lit(".TextGrid")).alias("textgrid_rel"))
    read = audio.read_archives(spark, [[os.path.join(local, p) for p in parts]])
    return audio.with_members(index, read).select("k", F.octet_length("wav").alias("n_bytes"), "transcript")


# ------------------------------------------------------------------- operators on rows


def q_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a rate by model and length of the reference, over lines of orders."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("model"), F.repeat(F.lit("w "), (F.col("l_quantity")).cast("int")).alias("ref_norm"), (F.col("l_discount") * 100).alias("wer"))
    return rounded(transcripts.by_length(rows), 4)


def q_annotation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with and without places, by split and language."""
    k = F.col("c_custkey")
    entity = lambda i: F.struct(F.lit("NAME").alias("pii_type"), F.lit("x").alias("text"), F.when(k % (i + 2) > 0, i).alias("start_char"), F.when(k % 7 > 0, i + 1).alias("end_char"))
    entities = F.when(k % 5 > 0, F.slice(F.array(*(entity(i) for i in range(3))), 1, (k % 4).cast("int")))
    gold = table(spark, sf_dir, "customer").select((k % 2).cast("string").alias("split"), (k % 3).cast("string").alias("language"), entities.alias("entities"))
    return scoring.annotation_stats(gold)


def q_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long clips with short texts are tried again in the other language, and the longer text stays."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).cast("double").alias("d"), F.repeat(F.lit("a"), (F.col("o_orderkey") % 25).cast("int")).alias("t"), F.when(F.col("o_orderkey") % 2 == 0, "zh_prompt").otherwise("en_prompt").alias("chosen"))
    again = F.repeat(F.lit("b"), (F.col("o_orderkey") % 17).cast("int"))
    return o.select("o_orderkey", needs_retry(F.col("d"), "t", F.col("chosen")).alias("retry"), F.length(better_retry(F.col("t"), again)).alias("n"))


def q_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 orders by key; the limit is the feature."""
    return selection.in_file_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


def q_segmentation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How segments cover conversations, over all, from rows made of orders' numbers."""
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_orderkey") % 97 / 10.0).alias("segments_per_min"), (F.col("o_custkey") % 31 / 3.0).alias("avg_segment_sec"), (F.col("o_orderkey") % 11 / 11.0).alias("seg_audio_coverage_ratio"), (F.col("o_custkey") % 53 / 50.0).alias("wer"))
    return rounded(diagnostics.segmentation_summary(rows))


def q_error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five texts by type of what was wrongly found, over customers; five is the feature."""
    k = F.col("c_custkey")
    wrong = F.array(F.struct((k % 4).cast("string").alias("type"), F.concat(F.lit("a"), k).alias("text"), F.lit("rule").alias("source")), F.struct(F.when(k % 3 > 0, "X").alias("type"), F.concat(F.lit("b"), k).alias("text"), F.lit("ner").alias("source")))
    errors = table(spark, sf_dir, "customer").select(k.alias("record_id"), wrong.alias("false_positives"))
    return scoring.texts_by_type(errors, "false_positives").select("type", F.array_join("texts", ",").alias("texts"))


def q_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names and their brands' or containers' words, of which one holds the other."""
    p = table(spark, sf_dir, "part")
    a, b = F.concat(F.lit(" "), F.col("p_type"), F.lit("  ")), F.when(F.col("p_partkey") % 3 == 0, F.split("p_type", " ")[0]).when(F.col("p_partkey") % 3 == 1, F.lit(" ")).otherwise(F.col("p_brand"))
    return p.select("p_partkey", spans.containment(a, b).alias("held"))


def q_tokens_to_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens joined to a text, spans placed in it, and tags from the spans, of every line of every document: a span of two tokens after every sixth."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    tokens = F.filter(F.split("value", " +"), lambda w: w != "")
    j = spread(lines).filter(F.size(tokens) > 0).select("doc_id", "line", labels.joined_tokens(tokens).alias("j"))
    o = F.col("j.offsets")
    at = F.filter(F.sequence(F.lit(1), F.size(o)), lambda i: (i % 6 == 0) & (i + 2 <= F.size(o)))
    made = F.transform(at, lambda i: F.struct(F.get(o, i)["start"].alias("start"), F.get(o, i + 1)["end"].alias("end"), F.lit("person").alias("type"), F.lit("").alias("text"), F.lit(None).cast("double").alias("score"), F.lit("ner").alias("source")))
    return j.select("doc_id", "line", F.md5("j.text").alias("text_md5"), F.array_join(labels.tags_from_spans(made, o, ["PERSON"]), " ").alias("tags"))


def q_names_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of tag ids, of which some are unknown."""
    k = F.col("c_custkey").cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(names_of_ids(F.array(k % 4, F.lit(1), k % 7), {0: "O", 1: "B-PER", 2: "I-PER"}), ",").alias("names"))


def q_resolve_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of annotated records: even keys have one in their own split, every fifth one in the other of dev and eval, and mixed ones under their other name."""
    k = F.col("c_custkey")
    split, language = F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("eval")), (k % 3 + 1).cast("int")), F.element_at(F.array(F.lit("en"), F.lit("zh"), F.lit("mixed")), (k % 4 % 3 + 1).cast("int"))
    keyed = table(spark, sf_dir, "customer").select(k.alias("k"), split.alias("split"), language.alias("language"))
    records = keyed.select("k", F.when(F.col("language") == "mixed", F.concat(F.lit("clip_mixed_mix_"), "k")).otherwise(F.concat(F.lit("clip_"), "k")).alias("audio_id"), "split", "language")
    folder = F.when(F.col("language") == "en", "En").when(F.col("language") == "zh", "Zh").otherwise("Mix")
    stem = F.when(F.col("language") == "mixed", F.format_string("clip_mixed_%04d", "k")).otherwise(F.concat(F.lit("clip_"), "k"))
    other = F.when(F.col("split") == "dev", "eval").when(F.col("split") == "eval", "dev").otherwise("train")
    here = keyed.select("k", folder.alias("folder"), stem.alias("stem"), "split", other.alias("other"))
    own = here.filter("k % 2 = 0").select("split", "folder", "stem", F.concat_ws("/", "split", "folder", "stem").alias("path"))
    far = here.filter("k % 5 = 0 AND other <> 'train'").select(F.col("other").alias("split"), "folder", "stem", F.concat_ws("/", "other", "folder", "stem").alias("path"))
    return files.resolve_audio(records, own.unionByName(far)).select("k", "audio_path")


def q_span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their segments, of which every second is missing and every fourth is there twice; the later one counts."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("s"), k).alias("segment_id"))
    nothing = F.expr(f"cast(null as array<{WORD}>)")
    first = o.filter("o_orderkey % 2 = 0").select("segment_id", F.concat(F.lit("a"), k, F.lit(".wav")).alias("audio_path"), F.lit("Ann Lee here").alias("text"), F.lit(0.0).alias("start"), F.lit(12.0).alias("end"), nothing.alias("words"), F.lit(1).alias("_pos"))
    again = first.filter("right(segment_id, 1) IN ('0', '4', '8')").withColumns({"audio_path": F.concat(F.lit("later"), "audio_path"), "_pos": F.lit(2)})
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit("NAME").alias("type"), F.lit("Ann Lee").alias("text"), F.lit(None).cast("double").alias("score"), F.lit("ner").alias("source")))
    rows = o.select(F.concat(F.lit(" "), "segment_id").alias("segment_id"), F.when(k % 2 == 1, "own.wav").alias("audio_path"), F.lit("Ann Lee here").alias("text"), one.alias("spans"))
    placed = masking.placed_spans(rows, first.unionByName(again))
    return rounded(placed.select("segment_id", "source_audio", "has_words", F.get("intervals", F.lit(0))["end"].alias("placed_end")))


def q_postal_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes after a road; a number with a digit too many, or without a road, is none."""
    rule = next(r for r in RULES if r.name == "postal_code" and r.group)
    k = F.col("c_custkey")
    code = F.concat(F.lpad(k.cast("string"), 6, "1"), F.when(k % 5 == 0, "7").otherwise(""))
    text = F.concat(F.when(k % 3 == 0, "at Orchard Road 12, ").when(k % 3 == 1, "in Green Lane, ").otherwise("no where, "), code, F.lit(" ok"))
    found = table(spark, sf_dir, "customer").select(k.alias("k"), F.explode(find_spans(text, rule.pattern, rule.kind, group=rule.group, hints=rule.hints)).alias("s"))
    return found.select("k", "s.start", "s.end", "s.type", "s.text")


QUERIES = {
    f.__name__: f
    for f in (
        q_jsonl, q_json_lines_of_both_kinds, q_csv, q_json_array, q_manifest, q_index, q_textgrid, q_two_line_references, q_stamped_references, q_wave_headers, q_audio_folder, q_decoded, q_masked_waves, q_split_archive,
        q_by_length, q_annotation_stats, q_retry, q_file_order, q_segmentation_summary, q_error_texts, q_containment, q_tokens_to_tags, q_names_of_ids, q_resolve_audio, q_span_segments, q_postal_rule,
    )
}

_TONE = "(SELECT n_nationkey AS k, [8000, 16000, 22050][CAST(n_nationkey % 3 + 1 AS INTEGER)] AS rate, trunc([8000, 16000, 22050][CAST(n_nationkey % 3 + 1 AS INTEGER)] * (CAST(n_nationkey AS DOUBLE) / 10 + 1)) AS frames FROM nation)"
SQL = {
    "q_jsonl": "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CAST(1 AS BIGINT) AS step FROM customer",
    "q_json_lines_of_both_kinds": "SELECT count(*) FILTER (c_custkey % 3 <> 0) AS n_read, CAST(sum(c_custkey) FILTER (c_custkey % 3 <> 0) AS BIGINT) AS sum_k, count(*) AS n_lines FROM customer",
    "q_csv": """SELECT c_custkey AS k, md5('say "' || c_name || '",' || chr(10) || 'again') AS text_md5, round(c_acctbal, 2) AS balance FROM customer""",
    "q_json_array": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation",
    "q_manifest": "SELECT 's' || s_suppkey AS item_id, '/data/root/audio/' || s_suppkey || '.wav' AS audio_path, CAST(s_suppkey * 1.5 AS DOUBLE) AS duration_sec FROM supplier WHERE s_suppkey % 4 > 0",
    "q_index": "SELECT 'u' || s_suppkey AS utt_id, 'g/' || s_suppkey || '.TextGrid' AS textgrid_rel, 'w/' || s_suppkey || '.wav' AS wav_rel FROM supplier WHERE s_suppkey % 5 <> 0",
    "q_textgrid": "SELECT n_nationkey, n_name || ' ' || lower(n_name) || chr(10) || ' here' AS text FROM nation",
    "q_two_line_references": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS utt_id, s_name || ' Says' AS display, CASE WHEN s_suppkey % 2 = 0 THEN 'normal ' || s_suppkey ELSE lower(s_name || ' Says') END AS ref FROM supplier",
    "q_stamped_references": """
WITH t AS (SELECT s_suppkey AS k, CAST(s_suppkey || '.' || s_suppkey % 10 AS DOUBLE) AS a, CAST((s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2 END) || '.9' AS DOUBLE) AS b FROM supplier)
SELECT 'r_' || lpad(CAST(CAST(trunc(a * 1000) AS BIGINT) AS VARCHAR), 9, '0') AS seg_id, round(a, 6) AS start_sec, round(b, 6) AS end_sec, 'hello ' || k AS ref FROM t WHERE k % 7 <> 0 AND k % 4 <> 0 AND NOT b - a < 0.5""",
    "q_wave_headers": f"SELECT CAST(k AS INTEGER) AS k, round(frames / rate, 4) AS duration_sec, CAST(rate AS INTEGER) AS sampling_rate FROM {_TONE}",
    "q_audio_folder": "SELECT 'local_' || lpad(CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR), 6, '0') AS item_id, CAST(n_nationkey AS INTEGER) AS k FROM nation",
    "q_decoded": "SELECT CAST(n_nationkey AS INTEGER) AS k, round(CAST(n_nationkey AS DOUBLE) / 10 + 1, 1) AS seconds FROM nation",
    "q_masked_waves": "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 24 THEN 'source_missing' WHEN n_nationkey % 2 = 0 THEN 'time_aligned_silence_mask' ELSE 'copy_no_detected_spans' END AS method, n_nationkey % 2 = 1 AS sounds FROM nation",
    "q_split_archive": "SELECT r_regionkey AS k, CAST(4 * (r_regionkey + 1) AS INTEGER) AS n_bytes, CASE WHEN r_regionkey <> 2 THEN 'region ' || r_regionkey END AS transcript FROM region WHERE r_regionkey <> 1",
    "q_by_length": """
WITH l AS (SELECT 'm' || l_linenumber % 3 AS model, CAST(l_quantity AS INTEGER) AS n, l_discount * 100 AS w FROM lineitem)
SELECT model, CASE WHEN n <= 5 THEN '1–5 words' WHEN n <= 10 THEN '6–10 words' WHEN n <= 15 THEN '11–15 words' ELSE '16+ words' END AS bucket, round(avg(w), 4) AS avg_wer, count(*) AS n FROM l GROUP BY ALL""",
    "q_annotation_stats": """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 ELSE 0 END AS n FROM customer)
SELECT CAST(k % 2 AS VARCHAR) AS split, CAST(k % 3 AS VARCHAR) AS language, count(*) AS records, CAST(sum(n) AS BIGINT) AS entities,
  CAST(sum(CASE WHEN k % 7 > 0 THEN len(list_filter(range(0, CAST(n AS BIGINT)), lambda i: k % (i + 2) > 0)) ELSE 0 END) AS BIGINT) AS with_offsets FROM c GROUP BY ALL""",
    "q_retry": "SELECT o_orderkey, CASE WHEN o_orderkey % 30 > 12 AND o_orderkey % 25 < 20 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'zh' ELSE 'en' END END AS retry, CAST(greatest(o_orderkey % 25, o_orderkey % 17) AS INTEGER) AS n FROM orders",
    "q_file_order": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "q_segmentation_summary": """
WITH r AS (SELECT o_orderkey % 97 / 10.0::DOUBLE AS s, o_custkey % 31 / 3.0::DOUBLE AS a, o_orderkey % 11 / 11.0::DOUBLE AS c, o_custkey % 53 / 50.0::DOUBLE AS w FROM orders)
SELECT round(avg(s), 6) AS mean_segments_per_min, round(quantile_cont(s, 0.9), 6) AS p90_segments_per_min, round(avg(a), 6) AS mean_avg_segment_sec, round(avg(c), 6) AS mean_seg_audio_coverage_ratio, round(corr(s, w), 6) AS corr_segments_per_min_with_wer, round(corr(a, w), 6) AS corr_avg_segment_sec_with_wer FROM r""",
    "q_error_texts": """
WITH e AS (SELECT c_custkey AS k, CAST(c_custkey % 4 AS VARCHAR) AS type, 'a' || c_custkey AS text FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'X' ELSE 'UNKNOWN' END, 'b' || c_custkey FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY k) AS i FROM e)
SELECT type, string_agg(text, ',' ORDER BY i) AS texts FROM n WHERE i <= 5 GROUP BY type""",
    "q_containment": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE contains(p_type, p_brand) OR contains(p_brand, p_type) END AS held FROM part",
    "q_names_of_ids": """
SELECT c_custkey, array_to_string(list_transform([c_custkey % 4, 1, c_custkey % 7], lambda i: CASE i WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' WHEN 2 THEN 'I-PER' ELSE 'UNKNOWN' END), ',') AS names FROM customer""",
    "q_resolve_audio": """
WITH c AS (SELECT c_custkey AS k, ['train', 'dev', 'eval'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS split, ['train', 'eval', 'dev'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS other, CAST(c_custkey % 4 % 3 AS INTEGER) AS l FROM customer),
p AS (SELECT *, ['En', 'Zh', 'Mix'][l + 1] || '/' || CASE WHEN l = 2 THEN 'clip_mixed_' || CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END ELSE 'clip_' || k END AS stem FROM c)
SELECT k, CASE WHEN k % 2 = 0 THEN split || '/' || stem ELSE other || '/' || stem END AS audio_path FROM p WHERE k % 2 = 0 OR (k % 5 = 0 AND other <> 'train')""",
    "q_span_segments": """
SELECT 's' || o_orderkey AS segment_id, CASE WHEN o_orderkey % 2 = 1 THEN 'own.wav' WHEN o_orderkey % 10 IN (0, 4, 8) THEN 'latera' || o_orderkey || '.wav' ELSE 'a' || o_orderkey || '.wav' END AS source_audio,
  CASE WHEN o_orderkey % 2 = 0 THEN false END AS has_words, CASE WHEN o_orderkey % 2 = 0 THEN CAST(7.12 AS DOUBLE) END AS placed_end FROM orders""",
    "q_postal_rule": """
WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 20 ELSE 15 END AS a FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 5 > 0)
SELECT k, CAST(a AS INTEGER) AS start, CAST(a + 6 AS INTEGER) AS "end", 'ADDRESS' AS type, lpad(CAST(k AS VARCHAR), 6, '1') AS text FROM t""",
    "q_tokens_to_tags": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
t AS (SELECT doc_id, CAST(line AS INTEGER) AS line, list_filter(string_split(value, ' '), lambda x: x <> '') AS w FROM l)
SELECT doc_id, line, md5(array_to_string(w, ' ')) AS text_md5, array_to_string(list_transform(range(0, len(w)), lambda i: CASE WHEN i > 0 AND i % 6 = 0 AND i + 2 <= len(w) THEN 'B-PERSON' WHEN i > 6 AND i % 6 = 1 THEN 'I-PERSON' ELSE 'O' END), ' ') AS tags
FROM t WHERE len(w) > 0""",
}
