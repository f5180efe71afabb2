"""Transcripts to clips, clips to datasets, datasets to one: the library's main flows.

A flow is one lazy DataFrame until it is written. Segments are judged as rows; merging and
cutting, whose rules depend on what was built before, run over one video's segments.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets as D
from ..operators import gates as G
from ..operators import intervals as I
from ..operators import reports as R
from ..operators import speakers as P
from ..sources import schemas


@dataclass(frozen=True)
class Settings:
    quality: G.Quality = field(default_factory=G.Quality)
    lengths: G.Lengths = field(default_factory=G.Lengths)
    allowed: tuple[str, ...] = ("uk", "en")
    target_language: str | None = None
    split_by_script: bool = False
    merge_gap: float = 0.3
    normalise_loudness: bool = True


PARTS = f"video_id string, idx int, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, words array<{schemas.WORD}>, language string, speaker_id string"


def judged(transcripts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Every segment with its place and the first gate that it fails, up to the overlap with sound events."""
    d = transcripts.select("video_id", "source_audio", "aligned_at", "sound_events", F.posexplode("segments").alias("pos", "seg"))
    d = d.select("video_id", "source_audio", "aligned_at", "sound_events", "pos", "seg.*")
    reason = G.segment_reason(s.quality, s.lengths, F.lit(s.target_language).cast("string"), F.col("aligned_at").isNotNull())
    d = d.withColumn("reject_reason", reason)
    return d.withColumn("reject_reason", F.coalesce("reject_reason", F.when(I.overlaps_any(F.col("start"), F.col("end"), F.col("sound_events")), "junk")))


def _fold(s: Settings):
    most, n = s.lengths.max_seconds, s.lengths

    def joined(c: dict, r: dict) -> dict | None:
        text = f"{c['text']} {r['text']}".strip()
        same = all(c[k] == r[k] for k in ("speaker_id", "language"))
        if not same or r["start"] - c["end"] > s.merge_gap or r["end"] - c["start"] > most or len(text) > n.max_chars:
            return None
        worst = {"avg_logprob": min(c["avg_logprob"], r["avg_logprob"]), "no_speech_prob": max(c["no_speech_prob"], r["no_speech_prob"]), "compression_ratio": max(c["compression_ratio"], r["compression_ratio"])}
        return c | worst | {"end": r["end"], "text": text, "words": c["words"] + r["words"]}

    def cut(c: dict) -> list[dict]:
        if c["end"] - c["start"] <= most:
            return [c]
        if not c["words"]:
            w, mid = c["text"].split(), (c["start"] + c["end"]) / 2
            k = len(w) // 2
            texts = (" ".join(w[:k]), " ".join(w[k:])) if k else (c["text"], "")
            return [c | {"end": mid, "text": texts[0]}, c | {"start": mid, "text": texts[1]}]
        packs: list[list] = []
        for w in c["words"]:
            if packs and w["end"] - packs[-1][0]["start"] <= most:
                packs[-1].append(w)
            else:
                packs.append([w])
        return [c | {"start": p[0]["start"], "end": p[-1]["end"], "text": " ".join(w["word"] for w in p).strip(), "words": p} for p in packs]

    def run(pdf):
        import pandas as pd

        held: list[dict] = []
        for r in pdf.sort_values(["pos", "part"]).to_dict("records"):
            r["words"] = list(r["words"]) if r["words"] is not None else []
            m = joined(held[-1], r) if held else None
            if m:
                held[-1] = m
            else:
                held.append(r)
        out = [p for c in held for p in cut(c)]
        for k, p in enumerate(out):
            p["idx"] = k
        return pd.DataFrame(out, columns=[x.split()[0] for x in PARTS.split(", ")])

    return run


def _languages(d: DataFrame, s: Settings) -> DataFrame:
    """Segments with their language by letters; by runs of one script, where asked for."""
    whole = d.withColumn("part", F.lit(0)).withColumn("language", T.assign_clip_language(F.col("text"), F.col("language")))
    if not s.split_by_script:
        return whole
    from ..operators.sequence import _last

    kind = f"array<struct<script:string,words:array<{schemas.WORD}>>>"

    def fold(acc, w):
        script, c = T.word_script(w["word"]), _last(acc)
        add = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(c["script"].alias("script"), F.concat(c["words"], F.array(w)).alias("words"))))
        new = F.concat(acc, F.array(F.struct(script.alias("script"), F.array(w).alias("words"))))
        return F.when((F.size(acc) > 0) & (script.isNull() | (script == c["script"])), add).when(script.isNull(), acc).otherwise(new).cast(kind)

    d = d.withColumn("_runs", F.aggregate("words", F.array().cast(kind), fold))
    many = d.where(F.size("_runs") > 1).select("*", F.posexplode("_runs").alias("part", "_r"))
    text = T.strip(F.array_join(F.transform("_r.words", lambda w: w["word"]), " "))
    many = many.withColumn("text", text).withColumn("words", F.col("_r.words")).withColumn("start", F.element_at("words", 1)["start"]).withColumn("end", F.element_at("words", -1)["end"])
    many = many.withColumn("language", T.assign_clip_language(F.col("text"), F.col("language"))).drop("_r", "_runs")
    return whole.join(d.where(F.size("_runs") > 1).select("video_id", "pos"), ["video_id", "pos"], "left_anti").unionByName(many.select(*whole.columns))


def build_clips(transcripts: DataFrame, base: str, s: Settings = Settings(), volumes: DataFrame | None = None) -> DataFrame:
    """Clips with the 16 columns of the manifest and ``reject_reason``, null for those kept.

    ``volumes`` (clip_id, mean_volume_db, max_volume_db) are the measured levels; clips without
    one have none, and fail the volume gate unless loudness is normalised. Clip ids count the
    segments before the last gates, so ids of kept clips have holes.
    """
    d = _languages(judged(transcripts, s).where("reject_reason is null"), s).where(G.allowed_language(F.col("language"), list(s.allowed)))
    cols = ["video_id", "pos", "part", "start", "end", "text", "avg_logprob", "no_speech_prob", "compression_ratio", "words", "language", "speaker_id"]
    parts = d.select(*cols).groupBy("video_id").applyInPandas(_fold(s), PARTS)
    c = parts.join(transcripts.select("video_id", "source_audio"), "video_id").withColumn("text", T.clean_text(F.col("text")))
    seconds = F.col("end") - F.col("start")
    score, low = G.mean_score(F.col("words")), G.low_share(F.col("words"), s.quality.min_word_score)
    none = F.lit(None).cast("double")
    out = c.select(
        F.concat("video_id", F.lit("_"), F.format_string("%04d", "idx")).alias("clip_id"), "video_id", "start", "end", "text", seconds.alias("duration"), "source_audio",
        T.local_speaker(F.lit(base), F.col("video_id"), F.col("speaker_id")).alias("speaker_name"), score.alias("avg_word_score"), "avg_logprob", "no_speech_prob", "compression_ratio",
        low.alias("low_score_word_ratio"), none.alias("mean_volume_db"), none.alias("max_volume_db"), none.alias("quality_score"), G.length_reason(F.length("text"), seconds, s.lengths).alias("reject_reason"),
    )
    if volumes is not None:
        own = volumes.select("clip_id", F.col("mean_volume_db").alias("_mean"), F.col("max_volume_db").alias("_max"))
        out = out.join(own, "clip_id", "left").withColumn("mean_volume_db", F.col("_mean")).withColumn("max_volume_db", F.col("_max")).drop("_mean", "_max")
    loud = G.loud_enough(F.col("mean_volume_db"), F.col("max_volume_db"), s.quality, s.normalise_loudness)
    return out.withColumn("reject_reason", F.coalesce("reject_reason", F.when(~loud, "audio_quality")))


def segment_stats(transcripts: DataFrame, clips: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Segments and clips by the gate that rejected them, kept clips with their seconds."""
    early = judged(transcripts, s).where("reject_reason is not null").select("reject_reason", F.lit(0.0).alias("seconds"))
    late = clips.select("reject_reason", F.col("duration").alias("seconds"))
    return G.reject_report(early.unionByName(late))


def merged_stats(stats: DataFrame) -> DataFrame:
    """Transcript statistics of many files as one row: counters add up, language maps too."""
    counters = ["segments_kept", "rejected_non_target_language", "rejected_quality", "rejected_empty", "rejected_too_short", "rejected_alignment_failed", "marked_alignment_failed", "kept_speech_duration_sec"]
    sums = stats.agg(*(F.sum(c).alias(c) for c in counters))
    langs = stats.select(F.explode("detected_languages").alias("k", "v")).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    return sums.join(langs.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("detected_languages")), F.lit(True))


def export(clips: DataFrame, mapping: DataFrame | None = None, min_clips: int = 0, min_seconds: float = 0.0, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Kept clips as rows of a dataset: names mapped, small speakers pruned, files numbered, split."""
    c = clips.where("reject_reason is null") if "reject_reason" in clips.columns else clips
    if mapping is not None:
        c = D.apply_map(c, mapping, "speaker_name").drop("changed")
    c, _ = D.prune_speakers(c, min_clips, min_seconds)
    c = D.numbered(c, [F.col("clip_id")])
    return D.split_eval(c.withColumn("audio_file", F.concat(D.file_name(F.col("seq")), F.lit(".wav"))), F.col("clip_id"), share, seed)


def merge_datasets(parts: list[DataFrame], default_speaker: str = "speaker", share: float = 0.05, seed: int = 42) -> DataFrame:
    """Datasets (audio_file, text, speaker_name) as one: in order, numbered anew, split anew."""
    d = D.union_datasets(parts).withColumn("speaker_name", T.or_default(F.col("speaker_name"), default_speaker)).withColumnRenamed("audio_file", "source_file")
    d = D.numbered(d, [F.col("src_ord"), F.col("source_file")])
    return D.split_eval(d.withColumn("audio_file", F.concat(D.file_name(F.col("seq")), F.lit(".wav"))), F.col("seq"), share, seed)


def payload_transcripts(payloads: DataFrame) -> DataFrame:
    """Split recogniser payloads with the statistics of their speech: kept segments and seconds,
    marked alignment failures, how often each language was detected."""
    none = F.array().cast("array<string>")
    langs = F.filter(F.transform("segments", lambda x: x["language"]), lambda x: F.coalesce(x, F.lit("")) != "")
    seconds = F.aggregate("segments", F.lit(0.0), lambda t, x: t + x["end"] - x["start"])
    marked = F.size(F.filter("segments", lambda x: x["alignment_failed"]))
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.coalesce(langs, none))), lambda k: F.struct(k, F.size(F.filter(langs, lambda x: x == k)))))
    zero = lambda name: F.lit(0).alias(name)
    stats = F.struct(
        F.size("segments").alias("segments_kept"), zero("rejected_non_target_language"), zero("rejected_quality"), zero("rejected_empty"), zero("rejected_too_short"), zero("rejected_alignment_failed"),
        marked.alias("marked_alignment_failed"), seconds.alias("kept_speech_duration_sec"), counted.alias("detected_languages"),
    )
    return payloads.withColumn("stats", stats)


def speaker_map(transcripts: DataFrame, base: str, threshold: float = 0.65) -> DataFrame:
    """Transcripts to (name, speaker): speakers of all videos clustered by their voices.

    Where no speaker has an embedding, equal local names are one speaker.
    """
    d = transcripts.select("video_id", F.explode("speakers").alias("s")).where("s.id is not null")
    nodes = d.select(T.local_speaker(F.lit(base), F.col("video_id"), F.col("s.id")).alias("name"), F.col("s.embedding").alias("embedding"), F.coalesce("s.speech_seconds", F.lit(0.0)).alias("speech_seconds"))
    if nodes.where("size(embedding) > 0").isEmpty():
        return P.fallback_map(nodes.select("name").distinct(), base).select("name", "speaker")
    return P.cluster_speakers(nodes.dropDuplicates(["name"]), threshold, base).select("name", "speaker")
