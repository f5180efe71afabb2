"""python -m voxloom STEP ...: the main flows from the command line.

Settings come from environment variables (SEGMENT_*, QUALITY_*). A step of ``run`` whose
output stands already is skipped. Downloads and recognition are no part of it.
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .plans import build, catalog
from .sources import files

STEPS = {
    "sources": ["file"], "datasets": ["root", "--exclude"], "segment": ["transcripts", "out", "--speaker"], "stats": ["transcripts", "out"], "report": ["transcripts", "out", "--language"],
    "cluster": ["transcripts", "out", "--speaker", "--threshold"], "remap": ["metadata", "map", "out"], "export": ["clips", "out", "--map", "--min-clips", "--min-seconds"],
    "import": ["rows", "schema", "out", "checkpoint"], "merge": ["out", "inputs"], "run": ["transcripts", "out", "--speaker", "--threshold", "--steps"], "query": ["name", "tables"], "init": ["file"],
}
DEFAULTS = {"--speaker": "speaker", "--threshold": 0.65, "--min-clips": 0, "--min-seconds": 0.0, "--exclude": "", "--language": "uk", "--steps": "all"}


def settings() -> build.Settings:
    return build.Settings(config.from_env(build.G.Quality, "QUALITY"), config.from_env(build.G.Lengths, "SEGMENT"))


def segment(spark, a, out: str) -> None:
    clips = build.build_clips(files.read_transcripts(spark, a.transcripts), a.speaker, settings())
    files.write_json(clips.where("reject_reason is null").drop("reject_reason"), out, "video_id")


def cluster(spark, a, out: str) -> None:
    files.write_speaker_map(build.speaker_map(files.read_transcripts(spark, a.transcripts), a.speaker, a.threshold), out, a.speaker, a.threshold)


def splits(rows, out: str) -> None:
    for split, kept in (("train", "not is_eval"), ("eval", "is_eval")):
        files.write_metadata(rows.where(kept), f"{out}/metadata_{split}")


def export(spark, clips: str, mapping: str | None, out: str, a) -> None:
    names = files.read_speaker_map(spark, mapping) if mapping else None
    rows = build.export(files.read_clips(spark, clips), names, getattr(a, "min_clips", 0), getattr(a, "min_seconds", 0.0))
    splits(rows.withColumn("audio_file", F.concat(F.lit("wavs/"), "audio_file")), out)


def stands(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run(spark, a) -> None:
    asked = config.steps([s.strip() for s in a.steps.split(",")])
    made = {"segment": f"{a.out}/clips", "cluster": f"{a.out}/speakers", "export": f"{a.out}/dataset"}
    done = {s: stands(spark, f"{p}/metadata_eval" if s == "export" else p) for s, p in made.items()}
    for step in asked:
        if step not in made or done[step]:
            print(f"{step}: {'stands already' if step in made else 'no part of this library'}")
        elif step == "segment":
            segment(spark, a, made[step])
        elif step == "cluster":
            cluster(spark, a, made[step])
        else:
            export(spark, made["segment"], made["cluster"] if stands(spark, made["cluster"]) else None, made[step], a)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="voxloom")
    sub = p.add_subparsers(dest="step", required=True)
    for name, args in STEPS.items():
        s = sub.add_parser(name)
        for x in args:
            given = DEFAULTS.get(x)
            s.add_argument(x, **({"nargs": "+"} if x == "inputs" else {"default": given, "type": type(given) if given is not None else str} if x.startswith("--") else {}))
    a = p.parse_args(argv)
    if a.step == "init":
        with open(a.file, "w") as f:
            json.dump({"quality": dataclasses.asdict(build.G.Quality()), "segment": dataclasses.asdict(build.G.Lengths())}, f, indent=1)
        return
    if a.step == "sources":
        with open(a.file) as f:
            for r in config.sources(f.read()):
                print(r["slug"], r.get("kind", ""), "on" if str(r.get("enabled", True)).lower() in config.TRUE else "off", sep="\t")
        return
    spark = SparkSession.builder.appName("voxloom").getOrCreate()
    if a.step == "datasets":
        for d in files.list_datasets(spark, a.root, tuple(x for x in a.exclude.split(",") if x)):
            print(d, files.count_metadata(spark, f"{d}/metadata_train.csv"), sep="\t")
    elif a.step == "segment":
        segment(spark, a, a.out)
    elif a.step == "stats":
        t = files.read_transcripts(spark, a.transcripts)
        files.write_stats(build.segment_stats(t, build.build_clips(t, "speaker", settings()), settings()), a.out)
    elif a.step == "report":
        files.write_stats(build.R.transcript_report(files.read_transcripts(spark, a.transcripts), a.language), a.out)
    elif a.step == "cluster":
        cluster(spark, a, a.out)
    elif a.step == "remap":
        m = build.D.apply_map(files.read_metadata(spark, a.metadata), files.read_speaker_map(spark, a.map), "speaker_name")
        files.write_metadata(m.drop("changed"), a.out)
    elif a.step == "export":
        export(spark, a.clips, a.map, a.out, a)
    elif a.step == "import":
        from .streaming.importer import import_files

        print(import_files(spark, a.rows, a.schema, a.out, a.checkpoint).groupBy("accepted").count().collect())
    elif a.step == "merge":
        splits(build.merge_datasets([files.read_metadata(spark, x) for x in a.inputs]), a.out)
    elif a.step == "run":
        run(spark, a)
    else:
        catalog.QUERIES[a.name](spark, a.tables).show(50, truncate=80)


if __name__ == "__main__":
    main()
