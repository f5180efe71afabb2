import json

import pytest
from pyspark.sql import functions as F

from voxloom.sources import files
from voxloom.streaming.importer import import_files


def test_payload_split_and_round_trip(spark, tmp_path):
    p = {"language": "uk", "duration": 9.0, "speakers": [{"id": "0", "embedding": [1.0]}, {"id": "1", "embedding": []}],
         "segments": [{"kind": "speech", "start": 0.0, "end": 1.0, "text": " a ", "words": [{"word": "a", "score": 0.5}, {"word": " "}], "speaker_id": " "}, {"kind": "sound", "label": "laugh", "start": 1.0, "end": 2.0}, {"kind": "speech", "start": 2.0, "end": 3.0, "text": "b", "language": "en"}]}
    (tmp_path / "p.json").write_text(json.dumps(p))
    r = files.read_payloads(spark, str(tmp_path / "p.json")).first()
    assert [(s.text, s.language, s.avg_logprob, s.speaker_id) for s in r.segments] == [("a", "uk", -0.5, None), ("b", "en", -0.5, None)]
    assert r.segments[0].words[0].probability == 0.5 and len(r.segments[0].words) == 1
    assert [e.label for e in r.sound_events] == ["laugh"] and [s.embedding for s in r.speakers] == [[1.0], None]


def test_transcript_defaults(spark, tmp_path):
    (tmp_path / "vid7.json").write_text(json.dumps({"segments": [{"id": 1, "text": "x", "speaker_id": ""}]}))
    r = files.read_transcripts(spark, str(tmp_path)).first()
    assert r.video_id == "vid7" and r.segments[0].compression_ratio == 1.0 and r.segments[0].speaker_id is None and r.speakers == []


def test_metadata(spark, tmp_path):
    d = spark.createDataFrame([("b.wav", 'say "x', "s"), ("a.wav", "t", "s|u")], "audio_file string, text string, speaker_name string")
    files.write_metadata(d, str(tmp_path / "m"))
    assert [tuple(r) for r in files.read_metadata(spark, str(tmp_path / "m")).collect()] == [("a.wav", "t", "s|u"), ("b.wav", 'say "x', "s")]
    (tmp_path / "bad.csv").write_text("x|y\n")
    with pytest.raises(ValueError, match="no header"):
        files.read_metadata(spark, str(tmp_path / "bad.csv"))


def test_videos_are_healed(spark, tmp_path):
    v = [("a", "", "2024-01-02"), ("a", "a.wav", "2024-01-01"), ("b", "b.wav", "2024-01-01"), ("b", "b2.wav", "2024-01-01")]
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"video_id": i, "audio_path": p, "downloaded_at": t}) + "\n" for i, p, t in v))
    assert sorted((r.video_id, r.audio_path) for r in files.read_videos(spark, str(tmp_path / "m.jsonl")).collect()) == [("a", "a.wav"), ("b", "b2.wav")]


def test_clips_tolerant(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"clip_id": "1"}\nnot json\n')
    assert [r.clip_id for r in files.read_clips(spark, str(tmp_path / "c.jsonl"), tolerant=True).select("clip_id").collect()] == ["1"]


def test_speaker_map(spark, tmp_path):
    files.write_speaker_map(spark.createDataFrame([("x", "s0"), ("y", "s0")], "name string, speaker string"), str(tmp_path / "m"), "s", 0.75)
    assert sorted(map(tuple, files.read_speaker_map(spark, str(tmp_path / "m")).collect())) == [("x", "s0"), ("y", "s0")]


def test_import_is_incremental(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("enough text here").alias("text"), F.lit(True).alias("has_audio"), F.when(F.col("id") % 2 == 0, "0.9").otherwise("x").alias("wer"), F.lit("5").alias("declared"), F.lit(5.0).alias("measured"))
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows(0, 10).write.parquet(src)
    schema = "id long, text string, has_audio boolean, wer string, declared string, measured double"
    assert import_files(spark, src, schema, out, ck).groupBy("accepted").count().collect()
    rows(10, 14).write.mode("append").parquet(src)
    got = import_files(spark, src, schema, out, ck)
    assert got.count() == 14 and got.where("accepted").count() == 7
    assert {r.reject_reason for r in got.where("not accepted").collect()} == {"wer"}


def test_catalog_and_manifests(spark, tmp_path):
    for name, wavs in (("ready", True), ("bare", False), ("combined", True)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata_train.csv").write_text("audio_file|text|speaker_name\na|b|c\n\n")
        if wavs:
            (tmp_path / name / "wavs").mkdir()
    assert [p.rsplit("/", 1)[-1] for p in files.list_datasets(spark, str(tmp_path), ("combined",))] == ["ready"]
    assert files.list_datasets(spark, str(tmp_path / "none")) == []
    assert files.count_metadata(spark, str(tmp_path / "ready" / "metadata_train.csv")) == 1
    schema = "stats struct<kept:int,sample_rates:map<string,int>>"
    (tmp_path / "m.json").write_text('{"stats": {"kept": 2, "sample_rates": {"16000": 2}}}')
    (tmp_path / "bad.json").write_text("{")
    whole = files.read_if_whole(spark, str(tmp_path / "m.json"), schema)
    assert whole.select(files.int_keys(F.col("stats.sample_rates"))).first()[0] == {16000: 2}
    assert files.read_if_whole(spark, str(tmp_path / "bad.json"), schema) is None and files.read_if_whole(spark, str(tmp_path / "no.json"), schema) is None


def test_speaker_folders(spark, tmp_path):
    d = spark.createDataFrame([("a", "wavs/1.wav", "text", b"RIFF"), ("a", "wavs/2.wav", None, b"x"), ("b", "3.wav", "t", None)], "speaker_name string, audio_file string, text string, content binary")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old.wav").write_text("")
    (tmp_path / "z").mkdir()
    assert sorted(map(tuple, files.write_speaker_folders(d, str(tmp_path)).collect())) == [("a", 2)]
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")) == ["1.lab", "1.wav", "2.lab", "2.wav"] and (tmp_path / "z").exists()
    assert (tmp_path / "a" / "1.lab").read_text() == "text" and (tmp_path / "a" / "1.wav").read_bytes() == b"RIFF"
    with pytest.raises(ValueError, match="nothing"):
        files.write_speaker_folders(d.where("false"), str(tmp_path))
    with pytest.raises(ValueError, match="folders"):
        files.write_speaker_folders(d.withColumn("speaker_name", F.lit("../x")), str(tmp_path))


def test_latest_step(spark):
    d = spark.createDataFrame([("x/step_000010.ckpt",), ("x/step_000200-v1.ckpt",), ("x/last.ckpt",), ("x/step_9.txt",)], "path string")
    assert files.latest_step(d).first()[0] == 200 and files.latest_step(d.where("false")).first()[0] == 0
