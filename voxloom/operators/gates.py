"""Quality gates: one reason column per cascade, the first failing gate wins.

The reason is one CASE expression, so kept rows, reject counters and reports come from
the same column, and Catalyst cannot reorder the gates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Quality:
    min_logprob: float = -1.0
    max_no_speech: float = 0.6
    max_compression: float = 2.4
    check_compression: bool = True
    min_word_score: float = 0.5
    max_low_share: float = 0.35
    require_words: bool = True
    min_mean_db: float = -40.0
    max_mean_db: float = -8.0
    max_peak_db: float = -1.0


@dataclass(frozen=True)
class Lengths:
    min_seconds: float = 1.5
    max_seconds: float = 12.0
    min_speech_seconds: float = 0.5
    min_chars: int = 10
    max_chars: int = 220


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The name of the first gate whose condition holds, null if none does."""
    out = None
    for failed, name in gates:
        failed = F.coalesce(failed, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def poor_transcript(q: Quality = Quality()) -> Column:
    """Boundary values pass."""
    c = (F.col("avg_logprob") < q.min_logprob) | (F.col("no_speech_prob") > q.max_no_speech)
    return c | (F.col("compression_ratio") > q.max_compression) if q.check_compression else c


def not_aligned(aligned: Column) -> Column:
    """Flagged, or an aligned file's segment with text but no words."""
    return F.col("alignment_failed") | (aligned & (F.coalesce(F.size("words"), F.lit(0)) == 0))


def other_language(target: Column) -> Column:
    """Only known languages can differ."""
    return F.col("language").isNotNull() & target.isNotNull() & (F.col("language") != target)


def mean_score(words: Column) -> Column:
    """The mean probability of the words; null without words."""
    return F.when(F.size(words) > 0, F.aggregate(words, F.lit(0.0), lambda s, w: s + w["probability"]) / F.size(words))


def low_share(words: Column, below: float) -> Column:
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w["probability"] < below)) / F.size(words))


def poor_words(words: Column, q: Quality = Quality(), required: Column | None = None) -> Column:
    """Missing words fail only where alignment is required."""
    none = F.coalesce(F.size(words), F.lit(0)) == 0
    poor = (mean_score(words) < q.min_word_score) | (low_share(words, q.min_word_score) > q.max_low_share)
    return F.when(none, required if required is not None else F.lit(False)).otherwise(poor)


def segment_reason(q: Quality = Quality(), n: Lengths = Lengths(), target: Column | None = None, aligned: Column | None = None) -> Column:
    """empty, quality, alignment_failed, language, too_short, word_quality, in this order."""
    target, aligned = target if target is not None else F.lit(None).cast("string"), aligned if aligned is not None else F.lit(False)
    return first_reason(
        (F.coalesce(F.trim("text"), F.lit("")) == "", "empty"),
        (poor_transcript(q), "quality"),
        (not_aligned(aligned), "alignment_failed"),
        (other_language(target), "language"),
        (F.col("end") - F.col("start") < n.min_speech_seconds, "too_short"),
        (poor_words(F.col("words"), q, aligned & F.lit(q.require_words)), "word_quality"),
    )


def allowed_language(language: Column, allowed: list[str]) -> Column:
    """An empty list lets all through; a null language is never on a list."""
    names = [a.strip().lower() for a in allowed if a.strip()]
    return F.coalesce(F.lower(F.trim(language)).isin(names), F.lit(False)) if names else F.lit(True)


def length_reason(chars: Column, seconds: Column, n: Lengths = Lengths()) -> Column:
    """Text length first, then duration; bounds are allowed values."""
    return first_reason((~chars.between(n.min_chars, n.max_chars), "text_length"), (~seconds.between(n.min_seconds, n.max_seconds), "duration"))


def loud_enough(mean_db: Column, peak_db: Column, q: Quality = Quality(), normalised: bool = True) -> Column:
    """Passes where loudness is normalised anyway; unknown levels fail."""
    if normalised:
        return F.lit(True)
    return F.coalesce(mean_db.between(q.min_mean_db, q.max_mean_db) & (peak_db <= q.max_peak_db), F.lit(False))


def import_reason(text: Column, has_audio: Column, wer: Column, declared: Column, measured: Column, max_wer: float, n: Lengths = Lengths()) -> Column:
    """wer, text, audio, duration as declared, duration as measured; non-numbers are not tested."""
    number = lambda c: F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    w, d = number(wer), number(declared)
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return first_reason(
        (w > max_wer, "wer"),
        (blank | ~F.length(text).between(n.min_chars, n.max_chars), "text"),
        (~has_audio, "audio"),
        ((d > 0) & ~d.between(n.min_seconds, n.max_seconds), "duration"),
        (measured.isNull() | ~measured.between(n.min_seconds, n.max_seconds), "measured"),
    )


def video_fits(seconds: Column, least: float = 60.0, most: float | None = None) -> Column:
    """A missing duration counts as 0."""
    s = F.coalesce(seconds, F.lit(0.0))
    return (s >= least) & (s <= most) if most is not None else s >= least


def reject_report(df: DataFrame, reason: str = "reject_reason", seconds: str = "seconds") -> DataFrame:
    """Rows and seconds by reason, 'kept' for those without."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"))
