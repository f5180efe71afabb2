"""Datasets of clips: union, numbering, splits, de-duplication, references, speakers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL in order: ``src_ord`` tells the input."""
    return reduce(DataFrame.unionByName, (p.withColumn("src_ord", F.lit(k)) for k, p in enumerate(parts)))


def ready_for_checkpoints(spark: SparkSession) -> None:
    """Names the folder for checkpoints that the cluster gives; a local one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="voxloom-")
        sc.setCheckpointDir(named)


def numbered(df: DataFrame, order: list[Column], name: str = "seq", chunk: Column | None = None) -> DataFrame:
    """Dense numbers from 1 over all rows.

    With ``chunk`` (an expression that ascends with the order, such as a partition key), rows
    are numbered within chunks and chunk totals are summed up, so only one row a chunk meets
    in one task. Without it, rows are dealt into ranges of the order, which are the chunks; the
    ranges are checkpointed, so that they stay as they are.
    """
    if chunk is None:
        ready_for_checkpoints(df.sparkSession)
        # the place in a range stands in the lower 33 bits, the range above them
        d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
        d = d.withColumn("_chunk", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m")
    else:
        d = df.withColumn("_chunk", chunk)
        d = d.withColumn("_r", F.row_number().over(W.partitionBy("_chunk").orderBy(*order)))
    totals = d.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = totals.select("_chunk", (F.sum("_n").over(W.orderBy("_chunk")) - F.col("_n")).alias("_before"))
    return d.join(before, "_chunk").withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_chunk", "_r", "_before")


def file_name(seq: Column, prefix: Column | None = None) -> Column:
    n = F.format_string("%06d", seq)
    return n if prefix is None else F.concat(prefix, F.lit("-"), n)


def eval_count(n: Column, share: float = 0.05) -> Column:
    """n above 1: a share, at least 1 and at most n - 1; otherwise none."""
    return F.when(n > 1, F.least(F.greatest(F.floor(n * F.lit(share)), F.lit(1)), n - 1)).otherwise(F.lit(0)).cast("long")


def split_eval(df: DataFrame, key: Column, share: float = 0.05, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Adds ``is_eval``: the first rows by a keyed hash of a key that tells rows apart.

    Sizes are exact, yet no group is put in order: the hash deals rows into bins, counts of bins
    say in which one the share ends, and only that bin's rows are ordered.
    """
    by = by or []
    d = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))).withColumn("_bin", F.substring("_h", 1, 3)).withColumn("_key", key)
    bins = d.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # 4096 bins a group at most
    bins = bins.withColumn("_all", F.sum("_n").over(w)).withColumn("_upto", F.sum("_n").over(w.orderBy("_bin")))
    need = eval_count(F.col("_all"), share) - (F.col("_upto") - F.col("_n"))
    last = bins.withColumn("_need", need).where((F.col("_need") > 0) & (F.col("_need") <= F.col("_n"))).select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bin").alias("_last"), "_need")
    same = lambda *more: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + list(more))
    inside = d.join(last, same(F.col("_bin") == F.col("_last"))).select(*(f"_by_{c}" for c in by), "_last", "_need", "_h", "_key")
    place = F.row_number().over(W.partitionBy(*(f"_by_{c}" for c in by), "_last").orderBy("_h", "_key"))
    ends = inside.withColumn("_k", place).where("_k = _need").select(*(f"_by_{c}" for c in by), "_last", F.struct("_h", "_key").alias("_end"))
    if by:
        d = d.join(ends, same(), "left")
    else:
        end = ends.select("_last", "_end._h", "_end._key").first()  # one row
        kind = d.schema["_key"].dataType
        d = d.withColumn("_last", F.lit(end[0] if end else None)).withColumn("_end", F.struct(F.lit(end[1]).alias("_h"), F.lit(end[2]).cast(kind).alias("_key")) if end else F.lit(None).cast(f"struct<_h:string,_key:{kind.simpleString()}>"))
    return d.withColumn("is_eval", F.coalesce(F.struct("_h", "_key") <= F.col("_end"), F.lit(False))).drop("_h", "_bin", "_key", "_last", "_end", *(f"_by_{c}" for c in by))


def dedupe_latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def prune_speakers(clips: DataFrame, min_clips: int = 100, min_seconds: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """(clips of speakers that reach both floors, totals of the dropped ones); two floors of 0 keep all."""
    totals = clips.groupBy("speaker_name").agg(F.count("*").alias("clips"), F.sum("duration").alias("seconds"))
    keep = (F.col("clips") >= min_clips) & (F.col("seconds") >= min_seconds) if min_clips > 0 or min_seconds > 0 else F.lit(True)
    return clips.join(totals.where(keep).select("speaker_name"), "speaker_name", "left_semi"), totals.where(~keep)


def mode(df: DataFrame, value: str, position: str) -> DataFrame:
    """The most frequent value, ties to the one seen first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(position).alias("_first")).orderBy(F.desc("n"), "_first").limit(1).drop("_first")


def rank_score(quality: Column, words: Column, logprob: Column, clamp: bool = False) -> Column:
    """Quality, else word score, else logprob + 1 (at least 0; at most 1 if clamped), else 0."""
    lp = F.greatest(F.lit(0.0), logprob + 1)
    return F.coalesce(quality, words, F.least(F.lit(1.0), lp) if clamp else lp, F.lit(0.0))


def reference_clips(clips: DataFrame, score: Column, target: float, by: str = "speaker_name", position: str = "clip_id") -> DataFrame:
    """The best clip of each speaker: score, closeness to the target length, word score, position."""
    order = [F.desc(score), F.abs(F.col("duration") - target), F.desc_nulls_last("avg_word_score"), F.col(position)]
    return clips.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("_k = 1").drop("_k")


def apply_map(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace names by a (name, new_name) table; names it lacks stay. ``changed`` tells which."""
    m = mapping.where("trim(name) <> '' and trim(new_name) <> ''").select(F.col("name").alias("_from"), F.col("new_name").alias("_to"))
    d = df.join(m, F.col(column) == F.col("_from"), "left")
    return d.withColumn("changed", F.coalesce(F.col("_to") != F.col(column), F.lit(False))).withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def require_same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key with which side has it."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    d = x.join(y, key, "full")
    return d.select(key, F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b").alias("side"))


def speaker_groups(clips: DataFrame, least: int = 2, by: str = "speaker_name") -> DataFrame:
    """Clips of speakers that have enough of them to be paired."""
    big = clips.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(by)
    return clips.join(big, by, "left_semi")


def partners(clips: DataFrame, seed: int = 42, by: str = "speaker_name", key: str = "clip_id") -> DataFrame:
    """Each clip with a partner of its speaker: the next one in a seeded order, the last one's is the first."""
    w = W.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key)
    d = clips.withColumn("partner", F.coalesce(F.lead(key).over(w), F.first(key).over(w.rowsBetween(W.unboundedPreceding, 0))))
    return d.where(F.col("partner") != F.col(key))


def with_audio(df: DataFrame, files: DataFrame, column: str = "audio_file", missing: str = "skip", basename: bool = False) -> DataFrame:
    """Rows whose audio is among the files (path) found: a semi-join on the path's end.

    ``path`` becomes the file's own. With ``basename`` a row whose path is not there may have any
    file of its name, the first by path. Missing audio is skipped, or an error.
    """
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    f = files.select(F.col("path").alias("_path"), tail(F.col("path")).alias("_name"))
    d = df.withColumn("_name", tail(F.col(column))).withColumn("_id", F.monotonically_increasing_id())
    whole = (F.col("_path") == F.col(column)) | F.col("_path").endswith(F.concat(F.lit("/"), F.col(column)))
    met = d.join(f, "_name", "left").withColumn("_rank", F.when(whole, 0).when(F.col("_path").isNotNull() & F.lit(basename), 1))
    best = met.groupBy("_id").agg(F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_path"))).alias("_b"))
    found = d.join(best, "_id").where("_b is not null").withColumn("path", F.col("_b._path")).drop("_id", "_b", "_name")
    if missing == "error":
        lost = best.where("_b is null").count()
        if lost:
            raise FileNotFoundError(f"{lost} audio files are missing")
    return found


def zip_texts(files: DataFrame, texts: DataFrame, default: str = "") -> DataFrame:
    """Reference audio (pos, path) with texts (pos, text) of the same place.

    One text serves all files; blank texts have the default; another count of texts is an error.
    """
    n, m = files.count(), texts.count()
    if m not in (0, 1, n):
        raise ValueError(f"{m} texts for {n} references")
    t = texts.select("pos", F.coalesce(F.when(F.trim("text") != "", F.trim("text")), F.lit(default)).alias("text"))
    if m == 1:
        only = t.first()["text"]
        return files.withColumn("text", F.lit(only))
    return files.join(t, "pos", "left").withColumn("text", F.coalesce("text", F.lit(default)))


def hub_reference(clips: DataFrame, target: float, files: DataFrame | None = None, first: int = 10, position: str = "clip_id") -> DataFrame:
    """The clip closest to the target length among the ``first`` closest whose audio is there."""
    near = clips.withColumn("_gap", F.abs(F.col("duration") - target)).orderBy("_gap", position).limit(first)
    near = near if files is None else with_audio(near, files)
    return near.orderBy("_gap", position).limit(1).drop("_gap")
