from pyspark.sql import functions as F

from voxloom.plans import build
from voxloom.sources import schemas


def seg(i, a, b, text, speaker=None, language="uk", words=(), lp=-0.2):
    return (i, a, b, text, lp, 0.0, 1.0, list(words), language, None, False, speaker)


def transcripts(spark, *rows):
    data = [(v, f"{v}.wav", "uk", 60.0, segs, None, None, None, [(e[0], e[1], e[2], 0.9, True) for e in events], []) for v, segs, events in rows]
    return spark.createDataFrame(data, schemas.TRANSCRIPT)


def test_clips(spark):
    t = transcripts(
        spark,
        ("v1", [seg(0, 0.0, 2.0, "перший текст тут", "SPEAKER_00"), seg(1, 2.1, 4.0, "другий текст тут", "SPEAKER_01"), seg(2, 4.1, 5.5, "третій текст", "SPEAKER_01"), seg(3, 6.0, 9.0, "під час сміху", "SPEAKER_01"), seg(4, 20.0, 22.0, "кот", "SPEAKER_01"), seg(5, 30.0, 32.0, "вывыхнутый плече", None)], [("laugh", 8.0, 8.5)]),
        ("v2", [seg(0, 0.0, 20.0, "довгий текст без слів тут", None)], []),
    )
    c = build.build_clips(t, "host")
    got = {r["clip_id"]: (r["text"], r["speaker_name"], r["reject_reason"]) for r in c.collect()}
    assert got == {
        "v1_0000": ("перший текст тут", "host__v1__SPEAKER_00", None), "v1_0001": ("другий текст тут третій текст", "host__v1__SPEAKER_01", None), "v1_0002": ("кот", "host__v1__SPEAKER_01", "text_length"),
        "v2_0000": ("довгий текст", "host__v2", None), "v2_0001": ("без слів тут", "host__v2", None),
    }
    stats = {r["reason"]: r["n"] for r in build.segment_stats(t, c).collect()}
    assert stats == {"junk": 1, "kept": 4, "text_length": 1}
    rows = build.export(c).collect()
    assert sorted(r["audio_file"] for r in rows) == [f"{k:06d}.wav" for k in range(1, 5)] and sum(r["is_eval"] for r in rows) == 1


def test_script_split_and_word_cut(spark):
    words = [("An", 0.0, 0.3, 0.9), ("injury", 0.3, 0.7, 0.9), ("–", 0.7, 0.8, 0.9), ("поранення,", 0.8, 1.5, 0.9), ("травма.", 1.5, 2.4, 0.9)]
    t = transcripts(spark, ("v", [seg(0, 0.0, 2.4, "An injury – поранення, травма.", words=words)], []))
    s = build.Settings(split_by_script=True, lengths=build.G.Lengths(min_seconds=0.1, min_chars=1, max_seconds=1.0))
    got = [(r["text"], r["start"], r["end"]) for r in build.build_clips(t, "b", s).orderBy("start").collect()]
    assert got == [("An injury", 0.0, 0.8), ("поранення,", 0.8, 1.5), ("травма.", 1.5, 2.4)]


def test_merge_and_stats(spark):
    a = spark.createDataFrame([("1.wav", "x", "s"), ("2.wav", "y", " ")], "audio_file string, text string, speaker_name string")
    m = build.merge_datasets([a, a.limit(1)], "d")
    assert sorted((r["audio_file"], r["speaker_name"]) for r in m.collect()) == [("000001.wav", "s"), ("000002.wav", "d"), ("000003.wav", "s")]
    stats = spark.createDataFrame([(1, {"uk": 1, "en": 2}), (2, {"uk": 3})], "segments_kept int, detected_languages map<string,int>")
    for c in ("rejected_non_target_language", "rejected_quality", "rejected_empty", "rejected_too_short", "rejected_alignment_failed", "marked_alignment_failed", "kept_speech_duration_sec"):
        stats = stats.withColumn(c, F.lit(1))
    r = build.merged_stats(stats).first()
    assert r["segments_kept"] == 3 and r["detected_languages"] == {"uk": 4, "en": 2} and r["rejected_quality"] == 2


def test_volumes_are_judged_where_loudness_is_not_normalised(spark):
    t = transcripts(spark, ("v1", [seg(0, 0.0, 2.0, "перший текст тут"), seg(1, 5.0, 7.0, "другий текст тут"), seg(2, 10.0, 12.0, "третій текст тут")], []))
    v = spark.createDataFrame([("v1_0000", -20.0, -3.0), ("v1_0001", -50.0, -3.0)], "clip_id string, mean_volume_db double, max_volume_db double")
    got = {r["clip_id"]: r["reject_reason"] for r in build.build_clips(t, "host", build.Settings(normalise_loudness=False), v).collect()}
    assert got == {"v1_0000": None, "v1_0001": "audio_quality", "v1_0002": "audio_quality"}
    loud = build.build_clips(t, "host", volumes=v).collect()
    assert all(r["reject_reason"] is None for r in loud) and {r["mean_volume_db"] for r in loud} == {-20.0, -50.0, None}


def test_payload_statistics_and_report(spark):
    import json

    from voxloom.operators import reports as R
    from voxloom.sources import files

    p = {"language": "uk", "segments": [{"kind": "speech", "start": 0.0, "end": 1.5, "text": "довгий текст", "avg_logprob": -1.5, "words": [{"word": "a", "probability": 0.5}, {"word": "b", "probability": 1.0}]},
                                        {"kind": "speech", "start": 2.0, "end": 3.0, "text": " ", "language": "en", "alignment_failed": True}, {"kind": "sound", "label": "x", "start": 0.0, "end": 9.0}]}
    d = spark.read.schema(schemas.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(p), json.dumps({"segments": []})]))
    t = build.payload_transcripts(files.split_payload(d))
    s = t.orderBy(F.desc("stats.segments_kept")).first()["stats"]
    assert (s["segments_kept"], s["marked_alignment_failed"], s["kept_speech_duration_sec"], s["detected_languages"]) == (2, 1, 2.5, {"uk": 1, "en": 1})
    r = R.transcript_report(t.withColumn("aligned_at", F.lit(None).cast("string"))).first()
    assert (r["transcripts"], r["aligned"], r["aligned_percent"], r["segments"], r["empty"], r["other_language"], r["low_logprob"], r["words"], r["mean_word_score"]) == (2, 0, 0.0, 2, 1, 1, 1, 2, 0.75)
    assert [tuple(x) for x in r["file_languages"]] == [("?", 1), ("uk", 1)] and [tuple(x) for x in r["region_languages"]] == [("en", 1), ("uk", 1)]
    assert R.transcript_report(t.where("false").withColumn("aligned_at", F.lit(""))).first()["aligned_percent"] == 0.0


def test_speaker_map_of_transcripts(spark):
    data = [("v1", [("S0", 5.0, 1, [1.0, 0.0]), ("S1", 1.0, 1, [0.0, 1.0])]), ("v2", [("S9", 2.0, 1, [0.99, 0.05])]), ("v3", [])]
    t = spark.createDataFrame(data, f"video_id string, speakers array<{schemas.SPEAKER}>")
    assert sorted(map(tuple, build.speaker_map(t, "host").collect())) == [("host__v1__S0", "host_s0"), ("host__v1__S1", "host_s1"), ("host__v2__S9", "host_s0")]
    bare = t.withColumn("speakers", F.transform("speakers", lambda s: s.withField("embedding", F.lit(None).cast("array<double>"))))
    assert len({r["speaker"] for r in build.speaker_map(bare, "host").collect()}) == 3


def test_command_line(spark, tmp_path, capsys):
    import json

    from voxloom.__main__ import main

    out = str(tmp_path)
    rows = [{"video_id": v, "source_audio": f"{v}.wav", "segments": [{"id": k, "start": 3.0 * k, "end": 3.0 * k + 2, "text": f"текст номер {k} тут", "speaker_id": "S0"} for k in range(30)], "speakers": [{"id": "S0", "speech_seconds": 9.0, "embedding": [1.0, 0.1]}]} for v in ("v1", "v2")]
    (tmp_path / "t").mkdir()
    for r in rows:
        (tmp_path / "t" / f"{r['video_id']}.json").write_text(json.dumps(r))
    main(["run", f"{out}/t", f"{out}/o", "--speaker", "host"])
    data = spark.read.text(f"{out}/o/dataset/metadata_train").count() + spark.read.text(f"{out}/o/dataset/metadata_eval").count() - 2
    assert data == 60 and "download: no part" in capsys.readouterr().out
    main(["run", f"{out}/t", f"{out}/o"])
    assert capsys.readouterr().out.count("stands already") == 3
    main(["remap", f"{out}/o/dataset/metadata_train", f"{out}/o/speakers", f"{out}/m"])
    main(["merge", f"{out}/all", f"{out}/m", f"{out}/o/dataset/metadata_eval"])
    assert spark.read.text(f"{out}/all/metadata_eval").count() == 1 + 3
    main(["stats", f"{out}/t", f"{out}/s"])
    main(["report", f"{out}/t", f"{out}/r"])
    assert spark.read.json(f"{out}/s").first()["n"] == 60 and spark.read.json(f"{out}/r").first()["segments"] == 60
    main(["init", f"{out}/i.json"])
    (tmp_path / "src.json").write_text(json.dumps([{"slug": "a", "enabled": False}]))
    main(["sources", f"{out}/src.json"])
    assert "a\t\toff" in capsys.readouterr().out and "segment" in json.loads((tmp_path / "i.json").read_text())
