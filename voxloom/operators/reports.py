"""Corpus reports: percentiles, tallies, histograms, audits, drifts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .datasets import ready_for_checkpoints


def nearest_rank(df: DataFrame, value: str, percents: list[float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at the half-even rounded rank p / 100 * (n - 1); 0 for no values at all."""
    part = W.partitionBy(*by) if by else W.partitionBy()
    d = df.select(*(by or []), F.col(value).alias("v")).where("v is not null")
    # equal values fold first, so a rank is found in the table of different values
    counts = d.groupBy(*(by or []), "v").agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(part.orderBy("v"))).withColumn("total", F.sum("n").over(part))
    wanted = F.explode(F.array(*map(F.lit, map(float, percents)))).alias("percent")
    w = counts.select("*", wanted).withColumn("rank", F.rint(F.col("percent") / 100 * (F.col("total") - 1)) + 1)
    found = w.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(*(by or []), "percent", F.col("v").alias("value"))
    if by:
        return found
    every = df.sparkSession.createDataFrame([(float(p),) for p in percents], "percent double")
    return every.join(found, "percent", "left").select("percent", F.coalesce("value", F.lit(0.0)).alias("value"))


def spread(value: str) -> list[Column]:
    """Count, mean, median, min and max of a column."""
    v = F.col(value)
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high")]


def totals(seconds: Column) -> list[Column]:
    """Clips, seconds and hours; 0 for no rows."""
    s = F.coalesce(F.sum(seconds), F.lit(0)).cast("double")
    return [F.count("*").alias("clips"), F.round(s, 2).alias("seconds"), F.round(s / 3600, 2).alias("hours")]


def top_share(df: DataFrame, value: str, n: int = 12) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def extremes(df: DataFrame, value: str, n: int, highest: bool, position: list[str]) -> DataFrame:
    return df.orderBy(F.desc(value) if highest else F.asc(value), *position).limit(n)


def source_probe(rows: DataFrame, rate: str, seconds: str, text: str, order: str, n: int = 20, samples: int = 3) -> DataFrame:
    """What the first rows of a source look like: one row."""
    head = rows.orderBy(order).limit(n)
    texts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), 1, samples), lambda x: x[text])
    return head.agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_seconds"), F.count_distinct(rate).alias("rates"), F.array_join(texts, " / ").alias("texts"))


def drift(base: DataFrame, tuned: DataFrame, keys: list[str], group: str) -> DataFrame:
    """By group: how far values moved. Both sides: keys, group, i (position), x."""
    b = base.select(*keys, group, "i", F.col("x").alias("b"))
    j = b.join(tuned.select(*keys, "i", F.col("x").alias("t")), [*keys, "i"])
    d = F.col("t") - F.col("b")
    out = j.groupBy(group).agg(F.sum(d * d).alias("d2"), F.sum(F.col("b") * F.col("b")).alias("b2"), F.max(F.abs(d)).alias("max_abs"), F.count("*").alias("params"), F.count_if(d != 0).alias("changed"))
    return out.withColumn("rel_l2", F.when(F.col("b2") > 0, F.sqrt(F.col("d2") / F.col("b2"))).otherwise(0.0))


#: Strings of fewer than EXACT bytes go by a hash of all their bytes. Longer ones go by the least gram of the
#: largest of GRAMS whose windows (of as many grams as a gram has bytes) they hold at least once.
EXACT, GRAMS = 31, (16, 32, 64, 128)
#: Two words of 8 bytes hold the whole of a string of so many bytes.
WORDS = 16
#: The filter has slices of 2 ** SLICE bits for SLICE_KEYS keys each, of which there are 2 ** MOST_SLICES at most: 32 MB.
SLICE, SLICE_KEYS, MOST_SLICES = 16, 4096, 12
#: So many bytes of text are hashed at once.
AT_ONCE = 1 << 19


def _mixed(x, salt: int = 0):
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _pieces(texts):
    """An Arrow array of strings as (first, bytes, starts, ends), AT_ONCE bytes at a time or one string."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + AT_ONCE, "right")) - 1)
        yield i, raw[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]
        i = j


def _kind(n):
    """By their bytes, how strings are found: by all n bytes, or by the least gram of so many bytes."""
    n = np.asarray(n)
    return np.where(n < EXACT, n, EXACT + np.searchsorted(2 * np.array(GRAMS) - 1, n, "right") - 1)


def _shifted(x, n: int):
    return np.concatenate([x[n:], np.zeros(min(n, len(x)), np.uint64)])


def _words(raw):
    """The 8 bytes that start at each place, and past the last one; those past the end count as 0."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(9, np.uint8)]), strides=(1,)).copy()


def _both_words(words, k: int):
    """What tells a string of k bytes, up to WORDS, from all others of its length."""
    return (words & np.uint64((1 << 8 * k) - 1), np.zeros(len(words), np.uint64)) if k < 8 else (words, _shifted(words, k - 8))


def _grams(words, kinds):
    """By kind, a hash of the bytes that start at each place."""
    for k in sorted(k for k in kinds if k <= WORDS):
        a, b = _both_words(words, k)
        yield k, _mixed(a * np.uint64(0xD6E8FEB86659FD93) + b, k)
    if max(kinds, default=0) <= WORDS:
        return
    h = _mixed(words * np.uint64(0xD6E8FEB86659FD93) + _shifted(words, 8), EXACT)  # of 16 bytes
    twice = h * np.uint64(0xD6E8FEB86659FD93)
    for k in sorted(k for k in kinds if WORDS < k < EXACT):
        yield k, _mixed(twice + _shifted(h, k - 16), k)
    for k in range(EXACT, max(kinds) + 1):
        if k > EXACT:
            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + _shifted(h, GRAMS[k - EXACT - 1]), k)
        if k in kinds:
            yield k, h


def _part_keys(texts):
    """Of each string, the key by which any string that holds it is found."""
    out = np.zeros(len(texts), np.uint64)
    for first, raw, start, end in _pieces(texts):
        kinds = _kind(end - start)
        for k, h in _grams(_words(raw), set(kinds.tolist())):
            of = np.flatnonzero(kinds == k)
            last = start[of] + 1 if k < EXACT else end[of] - GRAMS[k - EXACT] + 1
            out[first + of] = np.minimum.reduceat(h, np.stack([start[of], last], 1).ravel())[::2]
    return out.view(np.int64)


def _found(words, end, of, kinds: list[int], bits):
    """By kind: the places and keys of all parts that strings can hold, as far as the filter lets them through."""
    for k, h in _grams(words, kinds):
        span, new = k, slice(None)
        if k >= EXACT:
            n, span, reach = GRAMS[k - EXACT], 2 * GRAMS[k - EXACT] - 1, 1
            while reach < n:  # the least of a window of n
                h = np.minimum(h, np.concatenate([h[reach:], np.full(min(reach, len(h)), np.uint64(2**64 - 1))]))
                reach *= 2
            new = np.flatnonzero(np.concatenate([[True], (h[1 : len(of)] != h[: len(of) - 1]) | (of[1:] != of[:-1])]))
        at = np.arange(len(of))[new]
        at = at[_passes(h[at], bits)]
        at = at[at + span <= end[of[at]]]
        yield k, at, h[at]


def _whole_keys(texts, kinds: list[int], bits):
    """(strings, keys) without repeats, some strings at a time."""
    for first, raw, start, end in _pieces(texts):
        of = np.repeat(np.arange(len(start)), end - start)
        got = [(of[at], keys) for _, at, keys in _found(_words(raw), end, of, kinds, bits)]
        if len(raw) and got:
            own, keys = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((keys, own))
            own, keys = own[order], keys[order]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])])[: len(own)]
            yield own[new] + first, keys[new].view(np.int64)


def _whole_words(texts, rank, kinds: list[int], bits):
    """(strings, kinds, words, second words): of each part of up to WORDS bytes the string of the least rank that can hold it."""
    for first, raw, start, end in _pieces(texts):
        of, words = np.repeat(np.arange(len(start)), end - start), _words(raw)
        for k, at, _ in _found(words, end, of, kinds, bits) if len(raw) else ():
            a, b = (x[at] for x in _both_words(words, k))
            own = of[at] + first
            order = np.lexsort((rank[own], b, a))
            a, b, own = a[order], b[order], own[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
            yield own[new], np.full(int(new.sum()), k, np.int32), a[new].view(np.int64), b[new].view(np.int64)


def _probes(keys):
    """Three places in the slice; the slice itself is told by the bits above them."""
    return [(keys >> np.uint64(n)) & np.uint64((1 << SLICE) - 1) for n in (0, SLICE, 2 * SLICE)]


def _passes(keys, bits):
    slices = keys >> np.uint64(64 - (len(bits) >> SLICE - 3).bit_length() + 1)
    ok = np.ones(len(keys), bool)
    for p in _probes(keys):
        ok &= (bits[(slices << np.uint64(SLICE - 3)) + (p >> np.uint64(3))] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _filter(keys: DataFrame, n: int):
    """Bits that tell most strangers from the n keys: made slice by slice, 2 bytes a key or 32 MB at most."""
    power = min(MOST_SLICES, max(1, (n // SLICE_KEYS).bit_length()))

    def filled(group, table):
        import pyarrow as pa

        own = np.zeros(1 << SLICE, bool)
        for p in _probes(table["_key"].to_numpy().view(np.uint64)):
            own[p] = True
        return pa.table({"slice": [group[0].as_py()], "bits": [np.packbits(own, bitorder="little").tobytes()]}, pa.schema([("slice", pa.int64()), ("bits", pa.binary())]))

    out = np.zeros(1 << power + SLICE - 3, np.uint8)
    at = F.shiftrightunsigned("_key", 64 - power)
    for r in keys.select("_key", at.alias("_slice")).groupBy("_slice").applyInArrow(filled, "slice long, bits binary").toLocalIterator():
        out[r.slice << SLICE - 3 : r.slice + 1 << SLICE - 3] = np.frombuffer(r.bits, np.uint8)
    return out


def _keyed(p: DataFrame, part: str):
    """p with _key and _kind; the kinds there are; the filter of the keys."""
    lengths = F.octet_length(part)
    kind = lengths
    for k, g in enumerate(GRAMS):
        kind = F.when(lengths >= 2 * g - 1, EXACT + k).otherwise(kind)

    @F.arrow_udf("long")
    def part_key(texts):
        import pyarrow as pa

        return pa.array(_part_keys(texts))

    p = p.withColumn("_key", part_key(F.col(part))).withColumn("_kind", kind)
    n, kinds = p.agg(F.count("*"), F.collect_set("_kind")).first()
    return p, sorted(kinds), p.sparkSession.sparkContext.broadcast(_filter(p, n))


def _held(p: DataFrame, w: DataFrame, part: str, whole: str, keyed=None, above: int = 0) -> DataFrame:
    """Rows of p and w whose strings, each of them different and none of them empty, lie in one
    another; of parts of more than ``above`` bytes only."""
    p, kinds, bits = keyed or _keyed(p, part)
    kinds = [k for k in kinds if k > above]

    def whole_keys(batches):
        import pyarrow as pa

        for b in batches:
            for of, keys in _whole_keys(b.column("_text"), kinds, bits.value):
                yield pa.RecordBatch.from_arrays([b.column("_one").take(pa.array(of)), b.column("_two").take(pa.array(of)), pa.array(keys)], ["_one", "_two", "_key"])

    # keys travel with a whole's hashes instead of its text, which is joined once there are candidates;
    # nothing here is broadcast by its size, as Spark cannot tell how many keys a text makes
    w = w.withColumn("_one", F.xxhash64(whole)).withColumn("_two", F.xxhash64(F.lit(1), whole))
    keys = w.select("_one", "_two", F.col(whole).alias("_text")).mapInArrow(whole_keys, "_one long, _two long, _key long")
    met = p.where(F.col("_kind") > above).drop("_kind").join(keys.hint("merge"), "_key").drop("_key").join(w.hint("merge"), ["_one", "_two"])
    return met.where(F.col(whole).contains(F.col(part))).drop("_one", "_two")


def _first_holding(p: DataFrame, w: DataFrame, part: str, whole: str, first: str) -> DataFrame:
    """(part, first): the least ``first`` of the rows of w that hold a part, maybe more than once.

    Parts of up to WORDS bytes, which very many wholes can hold, are told by these bytes and never
    listed with all that hold them: the least is taken of each batch, each task and then of all.
    """
    p, kinds, bits = keyed = _keyed(p, part)
    short = [k for k in kinds if k <= WORDS]

    def whole_words(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            rank = np.empty(len(b), np.int64)
            rank[pc.sort_indices(b.column("_first")).to_numpy()] = np.arange(len(b))
            for of, *words in _whole_words(b.column("_text"), rank, short, bits.value):
                yield pa.RecordBatch.from_arrays([b.column("_first").take(pa.array(of)), *map(pa.array, words)], ["_first", "_kind", "_a", "_b"])

    @F.arrow_udf("struct<a: long, b: long>")
    def own_words(texts):
        import pyarrow as pa

        raw = [t.encode()[:WORDS] for t in texts.to_pylist()]
        a = np.array([int.from_bytes(t[:8], "little") for t in raw], np.uint64).view(np.int64)
        b = np.array([int.from_bytes(t[-8:] if len(t) >= 8 else b"", "little") for t in raw], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    kind = w.schema[first].dataType.simpleString()
    least = w.select(F.col(first).alias("_first"), F.col(whole).alias("_text")).mapInArrow(whole_words, f"_first {kind}, _kind int, _a long, _b long").groupBy("_kind", "_a", "_b").agg(F.min("_first").alias(first))
    s = p.where(F.col("_kind") <= WORDS).select(part, "_kind", own_words(F.col(part)).alias("_w")).select(part, "_kind", F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"))
    return s.join(least.hint("merge"), ["_kind", "_a", "_b"]).select(part, first).unionByName(_held(p, w, part, whole, keyed, WORDS).select(part, first))


def held_within(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """Different strings of ``parts`` with those of ``wholes`` that hold them, by an equi-join.

    The least gram of a part is the least of one of its windows, and of the same window in
    whatever holds the part; so a whole sends the least gram of every window, and a part its
    own least. Grams are a quarter of a part, up to 128 bytes. Parts too short for a
    window go by all their bytes. A filter of all parts' keys leaves out what no part has
    before it is sent. ``contains`` decides.
    """
    return _held(parts.where(F.length(part) > 0).select(part).distinct(), wholes.where(F.length(whole) > 0).select(whole).distinct(), part, whole).select(part, whole)


def match_quotes(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """Each quote (qid, quote) with the segment (sid, text) of the same text, the last one; else
    the first segment that holds it or is held by it. Empty texts match as equals only. The
    different texts of both sides are checkpointed, as they are read several times."""
    ready_for_checkpoints(quotes.sparkSession)
    sids = segments.where("text is not null").groupBy("text").agg(F.max("sid").alias("last"), F.min("sid").alias("first")).checkpoint()
    found = quotes.where("quote is not null").join(sids.hint("merge"), F.col("quote") == F.col("text"), "left").select("qid", "quote", "last", F.col("text").isNotNull().alias("same")).checkpoint()
    rest = found.where("not same").select("qid", "quote")
    q, s = rest.where("quote <> ''").select("quote").distinct(), sids.where("text <> ''").select("text", "first")
    met = _first_holding(q, s, "quote", "text", "first").unionByName(_held(s, q, "text", "quote").select("quote", "first"))
    near = met.groupBy("quote").agg(F.min("first").alias("sid"))
    exact = found.where("same").select("qid", "quote", F.col("last").alias("sid"), F.lit("exact").alias("how"))
    return exact.unionByName(rest.join(near.hint("merge"), "quote").select("qid", "quote", "sid", F.lit("part").alias("how")))


def audit(segments: DataFrame) -> DataFrame:
    """What the alignment of a corpus lost: one row over segments (video_id, start, end, text, words,
    aligned, alignment_failed)."""
    seconds = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    bare = F.col("alignment_failed") | (F.col("aligned") & (F.trim("text") != "") & (F.coalesce(F.size("words"), F.lit(0)) == 0))
    return segments.agg(
        F.count("*").alias("segments"), F.count_distinct("video_id").alias("files"), F.count_if("aligned").alias("aligned"), F.count_if(bare).alias("dropped"),
        F.round(F.sum(seconds), 3).alias("seconds"), F.round(F.sum(F.when(bare, seconds).otherwise(0.0)), 3).alias("dropped_seconds"),
    )


def _counted(label: str, name: str) -> Column:
    """'label n', null for none, so that concat_ws leaves it out."""
    return F.when(F.col(name) > 0, F.concat(F.lit(f"{label} "), F.col(name).cast("string")))


def _minutes(name: str) -> Column:
    return F.format_string("speech %.1f min", F.col(name) / 60)


def transcript_report(transcripts: DataFrame, target: str = "uk", short: int = 10) -> DataFrame:
    """A corpus of transcripts with their statistics as one row: how many are aligned, hours, histograms
    of the files' and the regions' languages, sums of counters, tallies and spreads of the segments.

    Texts are judged trimmed; segments of another language are those whose language is known.
    """
    counters = ["segments_kept", "rejected_quality", "rejected_non_target_language", "rejected_empty", "rejected_too_short"]
    number = lambda c: F.coalesce(F.sum(f"stats.{c}"), F.lit(0))
    files = transcripts.agg(
        F.count("*").alias("transcripts"), F.count_if(F.col("aligned_at") != "").alias("aligned"),
        F.round(F.coalesce(F.sum("stats.kept_speech_duration_sec"), F.lit(0.0)) / 3600, 2).alias("hours"), *(number(c).alias(c) for c in counters),
    ).withColumn("aligned_percent", F.round(F.when(F.col("transcripts") > 0, F.col("aligned") / F.col("transcripts") * 100).otherwise(0.0), 1))
    histogram = lambda d, name: d.groupBy("k").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "k"))).alias("x")).select(F.transform("x", lambda e: F.struct(e["k"].alias("language"), (-e["o"]).alias("n"))).alias(name))
    of_files = histogram(transcripts.select(F.coalesce("language", F.lit("?")).alias("k"), F.lit(1).alias("n")), "file_languages")
    of_regions = histogram(transcripts.select(F.explode("stats.detected_languages").alias("k", "n")), "region_languages")
    s = transcripts.select(F.explode("segments").alias("s")).select("s.*")
    text = F.trim(F.coalesce("text", F.lit("")))
    segments = s.agg(
        F.count("*").alias("segments"), F.count_if(text == "").alias("empty"), F.count_if((text != "") & (F.length(text) < short)).alias("short"), F.count_if(F.col("language") != target).alias("other_language"),
        F.count_if(F.col("avg_logprob") < -1.0).alias("low_logprob"), F.count_if(F.col("no_speech_prob") > 0.6).alias("no_speech"), F.count_if(F.col("compression_ratio") > 2.4).alias("compressed"),
        *(F.struct(F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in ("avg_logprob", "no_speech_prob", "compression_ratio")),
    )
    scores = s.select(F.explode("words").alias("w")).agg(F.count("w.probability").alias("words"), F.avg("w.probability").alias("mean_word_score"))
    out = files
    for one in (of_files, of_regions, segments, scores):  # each is one row
        out = out.join(F.broadcast(one), F.lit(True))
    return out


def transcript_summary(target: str) -> Column:
    """One line over the counters of a transcript's statistics."""
    rejects = ["rejected_non_target_language", "rejected_quality", "rejected_empty", "rejected_too_short", "rejected_alignment_failed"]
    total = sum((F.col(r) for r in rejects), F.lit(0))
    others = F.array_sort(F.map_entries(F.map_filter("detected_languages", lambda k, _: k != target)))
    bits = F.array_join(F.transform(others, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
    return F.concat_ws(
        " | ", F.format_string("kept %d segments", "segments_kept"), F.concat(F.lit("rejected "), total.cast("string")), F.when(bits != "", F.concat(F.lit(f"non-{target} regions kept ("), bits, F.lit(")"))),
        _counted("quality", "rejected_quality"), _counted("empty", "rejected_empty"), _counted("too short", "rejected_too_short"), _counted("align marked", "marked_alignment_failed"), _minutes("kept_speech_duration_sec"),
    )


#: How the reasons are called in a summary, in its order.
REASONS = {"empty": "empty", "quality": "quality", "language": "language", "too_short": "too short", "text_length": "text", "duration": "duration", "word_quality": "words", "audio_quality": "audio", "alignment_failed": "align failed", "junk": "junk"}


def segment_summary(report: DataFrame) -> DataFrame:
    """One line over a reject report (reason, n, seconds)."""
    n = lambda reason: F.coalesce(F.sum(F.when(F.col("reason") == reason, F.col("n"))), F.lit(0))
    kept = F.coalesce(F.sum(F.when(F.col("reason") == "kept", F.col("seconds"))), F.lit(0.0))
    rejected = sum((n(r) for r in REASONS), F.lit(0))
    parts = F.concat_ws(", ", *(F.concat(F.lit(f"{label} "), n(r).cast("string")) for r, label in REASONS.items()))
    return report.agg(F.concat(F.lit("kept "), n("kept").cast("string"), F.lit(" clips | rejected "), rejected.cast("string"), F.lit(" ("), parts, F.lit(") | "), F.format_string("speech %.1f min", kept / 60)).alias("summary"))
