"""Readers and writers for transcripts, manifests, metadata, lexicons, audio and logs.

All go through Spark's readers and writers, so any store that Spark reaches will do, and the
commit protocol replaces files as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, is_true, or_default, strip
from . import schemas as S

AUDIO = "*.{wav,mp3,m4a,flac,ogg,opus,webm}"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a video; missing fields get their defaults, the id falls back to the file's name."""
    d = spark.read.schema(S.TRANSCRIPT).option("multiLine", True).json(path).withColumn("video_id", F.coalesce("video_id", _stem(F.col("_metadata.file_path"))))
    fill = lambda s: F.struct(
        s["id"].alias("id"), F.coalesce(s["start"], F.lit(0.0)).alias("start"), F.coalesce(s["end"], F.lit(0.0)).alias("end"), F.coalesce(s["text"], F.lit("")).alias("text"),
        F.coalesce(s["avg_logprob"], F.lit(-0.5)).alias("avg_logprob"), F.coalesce(s["no_speech_prob"], F.lit(0.0)).alias("no_speech_prob"), F.coalesce(s["compression_ratio"], F.lit(1.0)).alias("compression_ratio"),
        F.coalesce(s["words"], F.array().cast(f"array<{S.WORD}>")).alias("words"), s["language"].alias("language"), s["language_probability"].alias("language_probability"),
        F.coalesce(s["alignment_failed"], F.lit(False)).alias("alignment_failed"), blank_to_null(s["speaker_id"]).alias("speaker_id"),
    )
    d = d.withColumn("segments", F.transform(F.coalesce("segments", F.array().cast(f"array<{S.SEGMENT}>")), fill))
    events = F.filter(F.coalesce("sound_events", F.array().cast(f"array<{S.EVENT}>")), lambda e: blank_to_null(e["label"]).isNotNull())
    return d.withColumn("sound_events", events).withColumn("speakers", F.coalesce("speakers", F.array().cast(f"array<{S.SPEAKER}>")))


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def read_clips(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Clip manifests as JSON lines; bad lines fail, or are dropped if tolerant."""
    d = spark.read.schema(S.CLIP + (", _bad string" if tolerant else "")).option("mode", "PERMISSIVE" if tolerant else "FAILFAST").option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.where("_bad is null").drop("_bad") if tolerant else d


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """Download manifest, healed: one row a video, an existing file first, then the newest, then the later line.

    Lines keep their place: the file's name, the block of the file that a task reads, the line in it.
    """
    from pyspark.sql import Window as W

    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    d = spark.read.schema(S.VIDEO).json(path).withColumn("_pos", place)
    order = [F.desc(F.coalesce(F.col("audio_path") != "", F.lit(False))), F.desc_nulls_last("downloaded_at"), F.desc("_pos")]
    return d.withColumn("_k", F.row_number().over(W.partitionBy("video_id").orderBy(*order))).where("_k = 1").drop("_k", "_pos")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Strict pipe-delimited metadata: the header must match, further pipes stay in the third field.

    Not read as CSV: quotes are ordinary characters here.
    """
    head = "|".join(S.METADATA)
    lines = spark.read.text(path)
    if not lines.where(F.col("value") == head).limit(1).count():
        raise ValueError(f"no header {head!r} in {path}")
    f = F.split("value", r"\|", 3)
    d = lines.where(F.col("value") != head).select(f.alias("f")).where(F.size("f") == 3)
    return d.select(*(F.col("f")[k].alias(n) for k, n in enumerate(S.METADATA)))


def read_metadata_csv(spark: SparkSession, path: str, speaker: str = "speaker") -> DataFrame:
    """Quote-aware metadata; rows without audio or text go, speakers have a default."""
    d = spark.read.csv(path, sep="|", header=True, quote='"', escape='"')
    d = d.select(strip(F.col("audio_file")).alias("audio_file"), strip(F.col("text")).alias("text"), or_default(F.col("speaker_name"), speaker).alias("speaker_name"))
    return d.where(blank_to_null(F.col("audio_file")).isNotNull() & blank_to_null(F.col("text")).isNotNull())


def write_metadata(df: DataFrame, path: str) -> None:
    """One pipe-delimited file with its header, in the order of the rows' files."""
    rows = df.select(F.concat_ws("|", *S.METADATA).alias("value"), F.col("audio_file").alias("o")).orderBy("o").coalesce(1).select("value")
    head = df.sparkSession.createDataFrame([("|".join(S.METADATA),)], "value string")
    head.unionAll(rows).coalesce(1).write.mode("overwrite").text(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser payloads, landed as JSON: one list split by kind into speech and sound."""
    d = spark.read.schema(S.PAYLOAD).option("multiLine", True).json(path)
    return split_payload(d)


def split_payload(d: DataFrame) -> DataFrame:
    word = lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), F.coalesce(w["probability"], w["score"], F.lit(0.0)).alias("probability"))
    speech = lambda s, i: F.struct(
        i.alias("id"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(strip(s["text"]), F.lit("")).alias("text"), F.coalesce(s["avg_logprob"], F.lit(-0.5)).alias("avg_logprob"),
        F.coalesce(s["no_speech_prob"], F.lit(0.0)).alias("no_speech_prob"), F.coalesce(s["compression_ratio"], F.lit(1.0)).alias("compression_ratio"),
        F.transform(F.filter(F.coalesce(s["words"], F.array().cast("array<struct<word:string,start:double,end:double,probability:double,score:double>>")), lambda w: blank_to_null(w["word"]).isNotNull()), word).alias("words"),
        F.coalesce(s["language"], F.col("language")).alias("language"), F.coalesce(s["alignment_failed"], F.lit(False)).alias("alignment_failed"), blank_to_null(s["speaker_id"]).alias("speaker_id"),
    )
    sound = lambda s: F.struct(blank_to_null(s["label"]).alias("label"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["score"], F.lit(0.0)).alias("score"), F.coalesce(s["prompt_relevant"], F.lit(False)).alias("prompt_relevant"))
    d = d.withColumn("sound_events", F.filter(F.transform(F.filter("segments", lambda s: s["kind"] == "sound"), sound), lambda e: e["label"].isNotNull()))
    d = d.withColumn("segments", F.transform(F.filter("segments", lambda s: F.coalesce(s["kind"], F.lit("speech")) != "sound"), speech))
    who = lambda p: F.struct(p["id"].alias("id"), p["speech_seconds"].alias("speech_seconds"), p["segment_count"].alias("segment_count"), F.when(F.size(p["embedding"]) > 0, p["embedding"]).alias("embedding"))
    return d.withColumn("speakers", F.transform("speakers", who))


def read_speaker_map(spark: SparkSession, path: str) -> DataFrame:
    """The mapping of a speaker map file as (name, new_name); blank ones go."""
    d = spark.read.schema("mapping map<string,string>").option("multiLine", True).json(path)
    return d.select(F.explode("mapping").alias("name", "new_name")).where(blank_to_null(F.col("name")).isNotNull() & blank_to_null(F.col("new_name")).isNotNull())


def write_speaker_map(assigned: DataFrame, path: str, base: str, threshold: float) -> None:
    """One JSON document with the mapping (name to speaker) and its counts."""
    m = assigned.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "speaker")))).alias("mapping"), F.count("*").alias("clustered_locals"))
    m.select(F.lit(base).alias("base_speaker"), F.lit(threshold).alias("threshold"), "clustered_locals", "mapping").coalesce(1).write.mode("overwrite").json(path)


def write_stats(df: DataFrame, path: str) -> None:
    """A report of one row, as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio files of a folder with ids from their names; contents are not read unless selected."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", AUDIO).load(path)
    return d.withColumn("video_id", _stem(F.col("path")))


def wav_durations(audio: DataFrame) -> DataFrame:
    """Adds seconds and sample_rate from WAV headers; nulls where unreadable."""
    import pandas as pd

    from ..functions.audio import wav_header

    @F.pandas_udf("struct<seconds:double,sample_rate:int>")
    def header(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav_header(c) for c in content], columns=["seconds", "sample_rate"]).astype({"sample_rate": "Int64"})

    return audio.withColumn("_h", header("content")).select("*", "_h.seconds", "_h.sample_rate").drop("_h")


def write_speaker_folders(df: DataFrame, path: str) -> DataFrame:
    """Rows (speaker_name, audio_file, text, content) as NAME.wav and NAME.lab in a folder a speaker.

    Folders of the speakers written are replaced, others stay; none at all is an error. Files
    are written by the tasks and moved to their names when whole. Speaker and clips of each.
    """
    import re
    import uuid

    import pandas as pd
    from pyarrow import fs as A

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(p).toString()
    speakers = [r[0] for r in df.select("speaker_name").distinct().collect()]  # a folder each
    if not speakers:
        raise ValueError("nothing to write")
    bad = [s for s in speakers if s is None or not s.strip(".") or re.search(r"[/\\\0]", s)]
    if bad:
        raise ValueError(f"names that cannot be folders: {bad}")
    for s in speakers:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, s), True)

    def run(frames):
        local = root.startswith("file:")
        store, base = (A.LocalFileSystem(), "/" + root[5:].lstrip("/")) if local else A.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", root))
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                stem = r.audio_file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                store.create_dir(f"{base}/{r.speaker_name}", recursive=True)
                for end, raw in ((".wav", r.content), (".lab", r.text.encode())):
                    part = f"{base}/{r.speaker_name}/{stem}{end}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part) as out:
                        out.write(raw)
                    store.move(part, f"{base}/{r.speaker_name}/{stem}{end}")
            yield pd.DataFrame({"speaker_name": pdf["speaker_name"], "n": 1})

    rows = df.where("content is not null").select("speaker_name", "audio_file", F.coalesce("text", F.lit("")).alias("text"), "content")
    done = rows.mapInPandas(run, "speaker_name string, n long").groupBy("speaker_name").agg(F.sum("n").alias("clips"))
    return spark.createDataFrame(done.collect(), done.schema)  # one row a folder; the files are written now


def read_lexicon(spark: SparkSession, path: str) -> dict[str, str]:
    """A stress lexicon: a file made by hand, read by the driver as a whole."""
    from ..functions.stress import lexicon

    return lexicon(r["value"] for r in spark.read.text(path).toLocalIterator())


def read_log(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """What a pattern finds in whole log files: path, position, match."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract_all("value", F.lit(pattern), F.lit(group)).alias("m"))
    return d.select("path", F.posexplode("m").alias("pos", "match"))


def newest(files: DataFrame) -> Column:
    """Of a binaryFile listing: the path changed last."""
    return F.max_by("path", "modificationTime")


def latest_step(files: DataFrame, pattern: str = r"step_(\d+)(?:-v\d+)?\.ckpt$") -> DataFrame:
    """Of a listing (path): the largest step that names tell, 0 for none."""
    step = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    return files.agg(F.coalesce(F.max(F.when(step != "", step.cast("long"))), F.lit(0)).alias("step"))


def read_rows(spark: SparkSession, path: str, stream: bool = False, schema: str | None = None) -> DataFrame:
    """Rows of a dataset as Parquet: a batch, or a stream of new files."""
    return spark.readStream.schema(schema).parquet(path) if stream else spark.read.parquet(path)


def with_columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds null columns for names that loosely typed rows lack."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def enabled(rows: DataFrame) -> DataFrame:
    return rows.where(is_true(F.col("enabled").cast("string")))


def list_datasets(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Folders under ``root``, sorted, that hold train metadata and audio; a merge's own output is excluded by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    child = lambda p, n: fs.exists(jvm.org.apache.hadoop.fs.Path(p, n))
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(p.toString() for p in found if p.getName() not in exclude and child(p, "metadata_train.csv") and child(p, "wavs"))


def count_metadata(spark: SparkSession, path: str) -> int:
    """Rows of a metadata file: its lines that are not blank, less the header."""
    return max(0, spark.read.text(path).where(F.trim("value") != "").count() - 1)


def read_if_whole(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A source's checkpoint manifest as JSON; None if it is missing or cannot be read."""
    from pyspark.errors import PySparkException

    try:
        d = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
        row = d.first()  # a manifest is one document
    except PySparkException:
        return None
    return d.drop("_bad") if row and row["_bad"] is None else None


def int_keys(c: Column) -> Column:
    """A map that JSON gave text keys, with the whole numbers they were."""
    return F.transform_keys(c, lambda k, _: k.cast("int"))
