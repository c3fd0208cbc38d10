import io
import json
import tarfile
import wave

import pytest
from pyspark.sql import functions as F

from veilscribe import schemas
from veilscribe.sources import audio, files, sinks


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def tone(seconds, rate=8000, channels=1):
    with wave.open(out := io.BytesIO(), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(b"\x10\x20" * int(seconds * rate) * channels)
    return out.getvalue()


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path / "m.jsonl", {"item_id": "a"}, "", {"item_id": "b", "audio_path": "x.wav"})
    rows = files.read_jsonl(spark, path, schemas.MANIFEST, pos="_pos")
    assert [(r["item_id"], r["_pos"]) for r in rows.orderBy("_pos").collect()] == [("a", 0), ("b", 1)]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.MANIFEST, pos="_pos").collect() == []
    bad = lines(tmp_path / "bad.jsonl", {"item_id": "a"}, "{oops")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_jsonl(spark, bad, schemas.MANIFEST).collect()
    assert files.read_jsonl(spark, bad, schemas.MANIFEST, tolerant=True).count() == 1 and files.count_lines(spark, bad) == 2


def test_manifest(spark, tmp_path):
    path = lines(tmp_path / "m.jsonl", {"item_id": "no audio"}, {"audio_path": "x.wav"}, {"item_id": "c", "audio_path": "/y.wav"})
    rows = files.asr_inputs(spark, {"source_type": "manifest", "manifest": {"path": path}, "max_items": 2}, root="/r")
    assert [(r["item_id"], r["audio_path"]) for r in rows.orderBy("_pos").collect()] == [("item_000001", "/r/x.wav"), ("c", "/y.wav")]
    with pytest.raises(ValueError, match="source_type"):
        files.asr_inputs(spark, {"source_type": "ftp"}, root="/r")


def test_folder_and_headers(spark, tmp_path):
    for name in ("b.wav", "a.wav", "c.txt"):
        (tmp_path / name).write_bytes(tone(0.5) if name.endswith("wav") else b"x")
    (tmp_path / "broken.wav").write_bytes(b"nothing")
    rows = files.read_audio_folder(spark, str(tmp_path)).orderBy("item_id").collect()
    assert [(r["item_id"], r["audio_path"].rpartition("/")[2]) for r in rows] == [("local_000000", "a.wav"), ("local_000001", "b.wav"), ("local_000002", "broken.wav")]
    about = {r["path"].rpartition("/")[2]: (r["duration_sec"], r["sampling_rate"]) for r in audio.read_headers(spark, str(tmp_path)).collect()}
    assert about == {"a.wav": (0.5, 8000), "b.wav": (0.5, 8000), "broken.wav": (None, None)}


def test_decoding():
    samples, rate = audio.decode(tone(0.25, rate=8000, channels=2))
    assert rate == 16000 and len(samples) == 4000 and abs(float(samples[10]) - 0x2010 / 32768) < 1e-4


def test_texts(spark, tmp_path):
    index = lines(tmp_path / "index", "u1 a.TextGrid a.wav more", "short line", "")
    assert [tuple(r) for r in files.read_index(spark, index).collect()] == [("u1", "a.TextGrid", "a.wav")]
    grid = spark.createDataFrame([('x text = "hi" y text = "  " text= "two\nlines"',)], "t string")
    assert grid.select(files.textgrid_text(F.col("t"))).first()[0] == "hi two\nlines"


def test_split_archive(spark, tmp_path):
    with tarfile.open(fileobj=(raw := io.BytesIO()), mode="w:gz") as tar:
        for name, data in (("./a/x.wav", b"one"), ("b.txt", b"two"), ("c.txt", b"three")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    whole = raw.getvalue()
    parts = []
    for k in range(3):
        (tmp_path / f"p{k}").write_bytes(whole[k * 70 : (k + 1) * 70] if k < 2 else whole[140:])
        parts.append(str(tmp_path / f"p{k}"))
    assert {(r["name"], bytes(r["content"])) for r in audio.read_archives(spark, [parts], ["a/x.wav", "c.txt"]).collect()} == {("a/x.wav", b"one"), ("c.txt", b"three")}
    assert audio.read_archives(spark, [parts, parts]).count() == 6


def test_json_arrays_are_repaired(spark, tmp_path):
    (tmp_path / "en.json").write_text('[{"record_id": "a"} {"record_id": "b"}]', encoding="utf-8")
    (tmp_path / "zh.json").write_text('[{"record_id": "c, } {"}]', encoding="utf-8")
    rows = files.read_json_arrays(spark, [str(tmp_path / n) for n in ("en.json", "zh.json", "none.json")], schemas.GOLD)
    assert sorted(r["record_id"] for r in rows.collect()) == ["a", "b", "c, } {"]


def test_benchmark_references(spark):
    text = ["000010001\tHello There.", "", "\thello there", "000010002\tNo Form", "000010003\tX", "other", "000010001\tAgain", " again "]
    frame = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, pos int, value string")
    assert {r["utt_id"]: (r["display"], r["ref"]) for r in files.two_line_references(frame).collect()} == {"000010001": ("Again", "again"), "000010002": ("No Form", "no form"), "000010003": ("X", "x")}
    stamped = spark.createDataFrame([("s", t) for t in ("[1.5,2.5]\t12\tM\t你好", "[0,0.1]\t1\tM\tshort", "[0,5]\t0\tM\tspeaker", "[0,5]\t1\tM\t[ENS]", "junk")], "stem string, value string")
    assert [tuple(r) for r in files.stamped_references(stamped).collect()] == [("s_000001500", 1.5, 2.5, "你好")]


def test_audio_is_found_under_other_names(spark):
    records = spark.createDataFrame([("clip_mixed_mix_16", "dev", "mixed"), ("a", "eval", "en"), ("a", "eval", "zh")], "audio_id string, split string, language string")
    listing = spark.createDataFrame([("eval", "Mix", "clip_mixed_0016", "1"), ("dev", "Mix", "clip_mixed_0016", "0"), ("dev", "En", "a", "2")], "split string, folder string, stem string, path string")
    assert sorted((r["audio_id"], r["language"], r["audio_path"]) for r in files.resolve_audio(records, listing).collect()) == [("a", "en", "2"), ("clip_mixed_mix_16", "mixed", "0")]


def test_csv_numbers(spark, tmp_path):
    frame = spark.createDataFrame([("x", 1.5), ("y, \"z\"", None)], "a string, b double")
    sinks.write_csv(frame, str(tmp_path / "c"), order=["a"])
    rows = files.read_csv(spark, str(tmp_path / "c")).orderBy("a")
    assert [tuple(r) for r in rows.select("a", files.as_number(F.col("b")), files.as_number(F.col("b"), "int")).collect()] == [("x", 1.5, 1), ('y, "z"', 0.0, 0)]


def test_artifacts(tmp_path):
    assert sinks.artifact_dir(str(tmp_path), "pii", "r").endswith("pii/r")
    with pytest.raises(ValueError, match="stage"):
        sinks.artifact_dir(str(tmp_path), "other", "r")
    sinks.write_json(str(tmp_path / "x.json"), {"a": "你"})
    assert files.read_json(str(tmp_path / "x.json")) == {"a": "你"} and files.read_json(str(tmp_path / "none")) == {}
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(str(tmp_path / "bad.json")) == {}
    about = sinks.bundle(str(tmp_path / "z.zip"), [str(tmp_path / "x.json"), str(tmp_path / "gone")], root=str(tmp_path))
    assert (about["files"], about["missing"]) == (["x.json"], ["gone"])


def test_splits_of_an_exported_dataset(spark, tmp_path):
    from veilscribe.sources import files

    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for config, split, k in (("long_wav", "train", 1), ("long_wav", "dev", 2), ("short", "train", 3), ("data", "test", 4)):
        (tmp_path / "set" / config).mkdir(parents=True, exist_ok=True)
        rows.selectExpr(f"{k} AS k", "v").toPandas().to_parquet(tmp_path / "set" / config / f"{split}-00000-of-00001.parquet")
    (tmp_path / "set" / "README.md").write_text("x")
    where = str(tmp_path / "set")
    layout = files.dataset_layout(spark, where)
    assert {c: list(x) for c, x in layout.items()} == {"default": ["test"], "long_wav": ["dev", "train"], "short": ["train"]}
    read = lambda **of: [r["k"] for r in files.read_exported(spark, where, **of).collect()]
    assert read(split="train", subset="long_wav") == [1] and read(split="dev", subset="long_wav", config="short") == [2]
    assert read(split="train", subset="none", config="short") == [3] and read(split="test") == [4]
    with pytest.raises(ValueError, match="no split"):
        files.read_exported(spark, where, split="eval", config="short")
    assert files.dataset_layout(spark, str(tmp_path / "gone")) == {}
    (tmp_path / "lines.jsonl").write_text('{"k": 7}\n')
    assert files.read_exported(spark, str(tmp_path / "lines.jsonl")).first()["k"] == 7
