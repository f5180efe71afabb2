"""Ordered-sequence operators as folds over a row's array.

Whether a segment joins the one before depends on what that one has become, so windows with
lag cannot express these; ``aggregate`` folds in array order, within one row. For videos of
thousands of segments use :func:`merge_grouped`, the same rule on grouped rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGED = "array<struct<id:bigint,start_ms:bigint,end_ms:bigint,text:string,speaker_id:string,language:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double,alignment_failed:boolean,n:int>>"


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


def merge_adjacent(segments: Column, gap_ms: int = 300, max_ms: int = 12_000, max_chars: int = 220) -> Column:
    """Greedy merge of neighbours of the same speaker and language, nulls equal.

    Metrics of a merged segment are the worst of its parts; ``n`` counts the parts.
    """
    first = F.transform(
        segments,
        lambda s: F.struct(*(s[k].alias(k) for k in ("id", "start_ms", "end_ms", "text", "speaker_id", "language", "avg_logprob", "no_speech_prob", "compression_ratio", "alignment_failed")), F.lit(1).alias("n")),
    ).cast(MERGED)

    def fold(acc: Column, s: Column) -> Column:
        c = _last(acc)
        fits = (
            (F.size(acc) > 0)
            & (s["start_ms"] - c["end_ms"] <= gap_ms)
            & (s["end_ms"] - c["start_ms"] <= max_ms)
            & (F.length(c["text"]) + 1 + F.length(s["text"]) <= max_chars)
            & c["speaker_id"].eqNullSafe(s["speaker_id"])
            & c["language"].eqNullSafe(s["language"])
        )
        joined = F.struct(
            c["id"].alias("id"), c["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), F.concat(c["text"], F.lit(" "), s["text"]).alias("text"),
            c["speaker_id"].alias("speaker_id"), c["language"].alias("language"), F.least(c["avg_logprob"], s["avg_logprob"]).alias("avg_logprob"),
            F.greatest(c["no_speech_prob"], s["no_speech_prob"]).alias("no_speech_prob"), F.greatest(c["compression_ratio"], s["compression_ratio"]).alias("compression_ratio"),
            (c["alignment_failed"] | s["alignment_failed"]).alias("alignment_failed"), (c["n"] + s["n"]).alias("n"),
        )
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s))).cast(MERGED)

    return F.aggregate(first, F.array().cast(MERGED), fold)


def merge_grouped(segments: DataFrame, key: str, order: list[str], gap_ms: int = 300, max_ms: int = 12_000, max_chars: int = 220) -> DataFrame:
    """The same merge on rows grouped by key, for keys of very many segments: linear in a key's rows."""

    def run(pdf):
        import pandas as pd

        out = []
        for r in pdf.sort_values(order).to_dict("records"):
            c = out[-1] if out else None
            same = lambda k: c[k] == r[k] or (c[k] is None and r[k] is None)  # noqa: B023,E731
            if c and r["start_ms"] - c["end_ms"] <= gap_ms and r["end_ms"] - c["start_ms"] <= max_ms and len(c["text"]) + 1 + len(r["text"]) <= max_chars and same("speaker_id") and same("language"):
                c |= {"end_ms": r["end_ms"], "text": f"{c['text']} {r['text']}", "n": c["n"] + 1, "avg_logprob": min(c["avg_logprob"], r["avg_logprob"]), "no_speech_prob": max(c["no_speech_prob"], r["no_speech_prob"]), "compression_ratio": max(c["compression_ratio"], r["compression_ratio"]), "alignment_failed": c["alignment_failed"] or r["alignment_failed"]}
            else:
                out.append({k: r[k] for k in cols} | {"n": 1})
        return pd.DataFrame(out, columns=[*cols, "n"])

    cols = [key, "id", "start_ms", "end_ms", "text", "speaker_id", "language", "avg_logprob", "no_speech_prob", "compression_ratio", "alignment_failed"]
    kinds = dict(segments.dtypes)
    return segments.select(*cols).groupBy(key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", n int")


RUNS = "array<struct<script:string,words:array<string>>>"


def script_runs(words: Column, script) -> Column:
    """Runs of words of one script; words of none join the open run, those before any are dropped."""

    def fold(acc: Column, w: Column) -> Column:
        s, c = script(w), _last(acc)
        add = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(c["script"].alias("script"), F.concat(c["words"], F.array(w)).alias("words"))))
        new = F.concat(acc, F.array(F.struct(s.alias("script"), F.array(w).alias("words"))))
        return F.when((F.size(acc) > 0) & (s.isNull() | (s == c["script"])), add).when(s.isNull(), acc).otherwise(new).cast(RUNS)

    return F.aggregate(words, F.array().cast(RUNS), fold)


PACKED = "array<struct<start:bigint,end:bigint,words:array<string>>>"


def pack_words(words: Column, max_length: int) -> Column:
    """Pack (word, start, end) in order; a pack closes before the word that would make it too long."""

    def fold(acc: Column, w: Column) -> Column:
        c = _last(acc)
        add = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(c["start"].alias("start"), w["end"].alias("end"), F.concat(c["words"], F.array(w["word"])).alias("words"))))
        new = F.concat(acc, F.array(F.struct(w["start"].alias("start"), w["end"].alias("end"), F.array(w["word"]).alias("words"))))
        return F.when((F.size(acc) > 0) & (w["end"] - c["start"] <= max_length), add).otherwise(new).cast(PACKED)

    return F.aggregate(words, F.array().cast(PACKED), fold)


def split_at_middle(start: Column, end: Column, halves: Column) -> Column:
    """Two parts of half the time each, with the halves of the text; no further splits."""
    mid = (start + end) / 2
    return F.array(
        F.struct(start.cast("double").alias("start"), mid.cast("double").alias("end"), halves[0].alias("text")),
        F.struct(mid.cast("double").alias("start"), end.cast("double").alias("end"), halves[1].alias("text")),
    )
