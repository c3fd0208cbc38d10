import csv
import glob
import json
import wave

import numpy as np
import pytest

from veilscribe.operators import recognition as R
from veilscribe.operators.detect import gazetteer
from veilscribe.operators.masking import read_wave, write_wave
from veilscribe.plans import cli, stages
from veilscribe.streaming import incremental


def rows_of(folder):
    return [json.loads(line) for name in sorted(glob.glob(f"{folder}/*.json")) for line in open(name, encoding="utf-8")]


def table_of(folder):
    (name,) = glob.glob(f"{folder}/*.csv")
    with open(name, encoding="utf-8") as f:
        return list(csv.DictReader(f))


def write_lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


WORDS = [{"word": "mail", "start": 0.0, "end": 1.0, "probability": 0.5}, {"word": "a@b.co", "start": 1.0, "end": 2.0, "probability": None}]


def test_whole_pipeline(spark, tmp_path):
    for name in ("a.wav", "quiet.wav"):
        (tmp_path / name).write_bytes(write_wave(np.full((4000, 1), 900, "<i2"), wave._wave_params(1, 2, 1000, 4000, "NONE", "")))
    manifest = write_lines(tmp_path / "manifest.jsonl", [{"item_id": "i1", "audio_path": "a.wav", "duration_sec": 4.0}, {"item_id": "i2", "audio_path": "quiet.wav", "duration_sec": 4.0}, {"item_id": "i3", "audio_path": "gone.wav"}])
    at = lambda n: str(tmp_path / n)
    engine = R.replay([{"audio_path": at("a.wav"), "text": "mail a@b.co", "start": 0.0, "end": 3.0, "words": WORDS, "language": "en"}, {"audio_path": at("gone.wav"), "text": "call 12345678", "start": 0.0, "end": 1.0}])
    done = stages.run_pipeline(spark, manifest, str(tmp_path), "r", engine)
    segments = {r["source_item_id"]: r for r in rows_of(f"{done['asr']}/segments.jsonl")}
    assert {k: (v["segment_id"], v["decode_mode"], v["end"]) for k, v in segments.items()} == {"i1": ("seg_000000", "single_pass", 3.0), "i2": ("seg_000001", "empty_segment", None), "i3": ("seg_000002", "single_pass", 1.0)}
    audit = {r["source_audio"].rpartition("/")[2]: r for r in rows_of(f"{done['masked']}/audit.jsonl")}
    assert {k: v["method"] for k, v in audit.items()} == {"a.wav": "time_aligned_silence_mask", "quiet.wav": "copy_no_detected_spans", "gone.wav": "source_missing"}
    assert audit["a.wav"]["time_intervals_sec"] == [{"start": 1.0, "end": 2.12}] and audit["a.wav"]["word_aligned_spans"] == 1
    samples, _ = read_wave(open(audit["a.wav"]["masked_audio"], "rb").read())
    assert not samples[1000:2120].any() and (samples[:1000] == 900).all() and (samples[2120:] == 900).all()
    assert {r["pii_type"]: int(r["count"]) for r in table_of(f"{done['eval']}/per_type.csv")} == {"EMAIL": 1, "PHONE": 1}
    assert done["bundle"]["missing"] == []
    # a second run finds nothing to do
    again = stages.run_asr(spark, {"run": {"run_id": "r"}, "data": {"source_type": "manifest", "manifest": {"path": manifest}}, "project_root": str(tmp_path)}, str(tmp_path), engine)
    assert len(rows_of(f"{again}/segments.jsonl")) == 3


def test_recognition_refines(spark):
    rows = [{"audio_path": "f", "text": "long", "start": 0.0, "end": 30.0}, {"audio_path": "m", "text": "你好 hi", "start": 1.0, "end": 4.0}, {"audio_path": "m", "text": "你好嗨", "start": 1.0, "end": 4.0, "language": "zh"}]
    inputs = spark.createDataFrame([("1", "f"), ("2", "m"), ("3", "bad"), ("4", "none")], "item_id string, audio_path string")
    found = R.transcribe(inputs, R.replay(rows), R.Policy(longest=12.0, overlap=1.0, mixed_redecode=True, allowed=("zh", "en"), fallback="zh"))
    got = sorted((r["source_item_id"], r["text"], r["start"], r["end"], r["decode_mode"]) for r in found.filter("error IS NULL").collect() if r["end"] is not None)
    assert got == [("1", "long", 0.0, 13.0, "single_pass"), ("1", "long", 11.0, 25.0, "single_pass"), ("1", "long", 23.0, 30.0, "single_pass"), ("2", "你好 hi", 1.0, 4.0, "mixed_redecode"), ("2", "你好嗨", 1.0, 4.0, "mixed_redecode"), ("2", "你好嗨", 1.0, 4.0, "single_pass")]
    others = {r["source_item_id"]: (r["decode_mode"], r["error"]) for r in found.collect() if r["end"] is None}
    assert others == {"3": (None, "cannot decode bad"), "4": ("empty_segment", None)}


def test_evaluations(spark, tmp_path):
    manifest = write_lines(tmp_path / "m.jsonl", [{"item_id": "a", "transcript": "one two three"}, {"item_id": "b", "transcript": "你好"}])
    (tmp_path / "asr").mkdir()
    write_lines(tmp_path / "asr" / "segments.jsonl", [{"segment_id": "s1", "source_item_id": "a", "text": "one two", "start": 0.0}, {"segment_id": "s1", "source_item_id": "a", "text": "again", "start": 1.0}])
    out = stages.run_asr_eval(spark, {"run": {"run_id": "e"}, "inputs": {"evaluations": [{"name": "t", "asr_dir": str(tmp_path / "asr"), "manifest_path": manifest}]}}, str(tmp_path))
    split = json.loads(open(f"{out}/summary.json").read())["splits"][0]
    assert split["wer"] == pytest.approx(3 / 5) and split["duplicate_segment_rows_removed"] == 1
    assert json.loads(open(f"{out}/protocol.json").read())["corpus_rate"] == "one_alignment"
    out = stages.run_asr_eval(spark, {"run": {"run_id": "s"}, "protocol": {"corpus_mode": "sum_edits"}, "inputs": {"evaluations": [{"name": "t", "asr_dir": str(tmp_path / "asr"), "manifest_path": manifest}]}}, str(tmp_path))
    assert json.loads(open(f"{out}/summary.json").read())["splits"][0]["wer"] == pytest.approx(3 / 5)
    data = write_lines(tmp_path / "bio.jsonl", [{"item_id": "x", "lang": "en", "tokens": ["Ann", "Lee", "ran"], "gold_tag_names": ["B-PER", "I-PER", "O"]}])
    config = {"run": {"run_id": "p"}, "protocol": {"beta": 2.0, "label_aliases": {"PERSON": "PER"}}, "inputs": {"evaluations": [{"name": "en", "data_path": data}]}}
    out = stages.run_pii_eval(spark, config, str(tmp_path), gazetteer({"Ann Lee": "PERSON", "ran": "LOC"}))
    overall = json.loads(open(f"{out}/summary.json").read())["overall"]
    assert (overall["tp"], overall["fp"], overall["fn"]) == (1, 1, 0)
    gold = write_lines(tmp_path / "gold.jsonl", [{"record_id": "g", "language": "en", "transcript": "mail a@b.co", "entities": [{"pii_type": "EMAIL", "text": "a@b.co", "start_char": 5, "end_char": 11}]}])
    out = stages.run_pii_eval_gold(spark, {"run": {"run_id": "g"}, "inputs": {"gold_path": gold}}, str(tmp_path))
    assert json.loads(open(f"{out}/summary.json").read())["overall"]["f1"] == 1.0


def test_command_line(spark, tmp_path):
    (tmp_path / "asr").mkdir()
    write_lines(tmp_path / "asr" / "segments.jsonl", [{"segment_id": "s", "audio_path": "a.wav", "text": "x@y.co", "language": "en"}])
    (tmp_path / "c.yaml").write_text(f"run:\n  run_id: c\n  input_asr_dir: {tmp_path / 'asr'}\n")
    out = cli.main(["pii", "--config", str(tmp_path / "c.yaml"), "--root", str(tmp_path)])
    assert [s["type"] for s in rows_of(f"{out}/spans.jsonl")[0]["spans"]] == ["EMAIL"]
    with pytest.raises(SystemExit):
        cli.main(["asr", "--config", str(tmp_path / "c.yaml")])


def test_streams_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    engine = R.replay([{"audio_path": "x", "text": "hi", "start": 0.0, "end": 1.0}])
    run = lambda: incremental.recognise_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), engine).awaitTermination(120)
    write_lines(tmp_path / "in" / "1.json", [{"item_id": "a", "audio_path": "x"}, {"item_id": "a", "audio_path": "x"}, {"item_id": "q", "audio_path": "bad"}])
    run()
    write_lines(tmp_path / "in" / "2.json", [{"item_id": "a", "audio_path": "x"}, {"item_id": "b", "audio_path": "x"}])
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["source_item_id"] for r in rows) == ["a", "b"] and len({r["segment_id"] for r in rows}) == 2
    assert [r["item_id"] for r in spark.read.parquet(str(tmp_path / "out_failed")).collect()] == ["q"]


def test_detection_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_lines(tmp_path / "in" / "1.json", [{"segment_id": "s", "text": "a@b.co", "arrived": "2024-01-01T00:00:00Z"}, {"segment_id": "s", "text": "a@b.co", "arrived": "2024-01-01T00:00:00Z"}])
    incremental.detect_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [s["type"] for s in row["spans"]] == ["EMAIL"]


def test_mask_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = lambda second, ms=0: f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.{ms:03d}Z"
    write_lines(tmp_path / "in" / "1.json", [{"source": "a", "at": at(1)}, {"source": "a", "at": at(1, 40)}, {"source": "a", "at": at(5)}, {"source": "b", "at": at(1)}])
    write_lines(tmp_path / "in" / "2.json", [{"source": "a", "at": at(600)}])
    rows = spark.readStream.schema("source string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = incremental.mask_sessions(rows, by="source").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["source"], r["n"]) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("channels", [1, 2])
def test_24_bit_audio_is_masked(channels):
    import wave

    import numpy as np

    from veilscribe.operators import masking
    from veilscribe.sources import audio

    samples = np.repeat(np.array([-(2**23), -1, 0, 1, 5, 2**23 - 1] * 100, np.int32)[:, None], channels, axis=1)
    data = masking.write_wave(samples, wave._wave_params(channels, 3, 100, len(samples), "NONE", ""))
    back, params = masking.read_wave(data)
    assert (back == samples).all() and params.sampwidth == 3
    for mode in ("silence", "beep"):
        masked, after = masking.read_wave(masking.mask_wave(data, [(1.0, 2.0)], masking.MaskOptions(mode=mode)))
        assert after == params and (masked[:100] == samples[:100]).all() and (masked[200:] == samples[200:]).all() and (masked[100:200] != samples[100:200]).any()
    assert abs(audio.decode(data)[0]).max() <= 1.0


def test_unmasked_audio_may_be_refused(spark, tmp_path):
    from veilscribe.operators import masking

    (tmp_path / "a.wav").write_bytes(b"no wave at all")
    audit = spark.createDataFrame([(str(tmp_path / "a.wav"), [(0.0, 1.0)])], "source_audio string, all_intervals array<struct<start: double, end: double>>")
    for how, method in (("copy", "fallback_copy_after_mask_error"), ("refuse", "refused_after_mask_error")):
        out = tmp_path / how
        done = masking.mask_files(audit, str(out), masking.MaskOptions.of({"on_error": how}), root=str(tmp_path)).first()
        assert done["method"] == method and (done["masked_audio"] is None) == (how == "refuse") and (out / "a.wav").exists() == (how == "copy")
