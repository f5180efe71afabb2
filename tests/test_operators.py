import math
import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import datasets as D
from voxloom.operators import gates as G
from voxloom.operators import intervals as I
from voxloom.operators import reports as R
from voxloom.operators import sequence as S
from voxloom.operators import speakers as P


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_gate_order_and_boundaries(spark):
    d = spark.createDataFrame(
        [(1, " ", -2.0, 0.0, 1.0), (2, "x", -1.0, 0.6, 2.4), (3, "x", -1.01, 0.0, 1.0), (4, "x", 0.0, 0.61, 1.0), (5, "x", 0.0, 0.0, 2.41)],
        "id int, text string, avg_logprob double, no_speech_prob double, compression_ratio double",
    ).select("*", F.lit(False).alias("alignment_failed"), F.lit("uk").alias("language"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.array().cast("array<struct<word:string,probability:double>>").alias("words"))
    assert rows(d.select("id", F.coalesce(G.segment_reason(), F.lit("kept")))) == [(1, "empty"), (2, "kept"), (3, "quality"), (4, "quality"), (5, "quality")]


def test_overlap_forms_agree(spark):
    s = spark.createDataFrame([(1, 1.0, 3.0), (1, 4.0, 6.0), (2, 0.0, 9.0), (3, 0.0, 1.0)], "video_id int, start double, end double")
    e = spark.createDataFrame([(1, 1.2, 2.8), (1, 3.0, 4.0), (2, 8.9, 20.0)], "video_id int, start double, end double")
    want = [(1, 4.0, 6.0), (3, 0.0, 1.0)]
    assert rows(I.without_overlaps(s, e)) == want
    assert rows(I.without_overlaps(s, e, bucket=2.5)) == want


def test_overlap_forms_agree_on_open_and_repeated_spans(spark):
    rng = random.Random(5)
    span = lambda: (rng.randrange(6), *((a, a + rng.randrange(-5, 60)) if rng.random() < 0.9 else (a, None) if rng.random() < 0.5 else (None, a) for a in [rng.randrange(2000)]).__next__())
    kind = "video_id int, start long, end long"
    s = spark.createDataFrame(pool := [span() for _ in range(300)] * 2 + [(None, 1, 2)], kind).repartition(7)
    e = spark.createDataFrame([span() for _ in range(40) if _ % 4] + [(5, 1990, 10**15)], kind)
    closed = spark.createDataFrame([x for x in pool if None not in x], kind)
    key = lambda d: sorted(map(str, map(tuple, d.collect())))
    for part in (s, closed):
        want = key(I.without_overlaps(part, e))
        assert 0 < len(want) < part.count() and key(I.without_overlaps(part, e, bucket=25)) == want


def test_merge_respects_speaker_and_nulls(spark):
    cols = "video_id int, id long, start_ms long, end_ms long, text string, speaker_id string, language string, avg_logprob double, no_speech_prob double, compression_ratio double, alignment_failed boolean"
    seg = [(1, 0, 0, 1000, "a", None, "uk", -0.1, 0.1, 1.0, False), (1, 1, 1100, 2000, "b", None, "uk", -0.4, 0.2, 1.0, True), (1, 2, 2100, 3000, "c", "s", "uk", 0.0, 0.0, 1.0, False), (1, 3, 3301, 4000, "d", "s", "uk", 0.0, 0.0, 1.0, False)]
    d = spark.createDataFrame(seg, cols)
    names = [c.split()[0] for c in cols.split(", ")][1:]
    a = d.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("s")).select(F.explode(S.merge_adjacent(F.col("s"))).alias("m"))
    want = [(0, 0, 2000, "a b", 2), (2, 2100, 3000, "c", 1), (3, 3301, 4000, "d", 1)]
    assert rows(a.select("m.id", "m.start_ms", "m.end_ms", "m.text", "m.n")) == want
    assert rows(S.merge_grouped(d, "video_id", ["id"]).select("id", "start_ms", "end_ms", "text", "n")) == want


def test_pack_keeps_a_long_word(spark):
    d = spark.createDataFrame([([("a", 0, 5), ("long", 5, 50), ("b", 50, 52)],)], "w array<struct<word:string,start:bigint,end:bigint>>")
    assert [tuple(r) for r in d.select(F.explode(S.pack_words(F.col("w"), 10)).alias("p")).select("p.start", "p.end").collect()] == [(0, 5), (5, 50), (50, 52)]


@pytest.mark.parametrize("n,k", [(0, 0), (1, 0), (2, 1), (19, 1), (20, 1), (21, 1), (39, 1), (40, 2)])
def test_eval_sizes(spark, n, k):
    assert spark.range(1).select(D.eval_count(F.lit(n))).first()[0] == k


def test_prune_and_map(spark):
    c = spark.createDataFrame([("big", 5.05)] * 100 + [("mid", 4.0)] * 50 + [("tiny", 2.0)] * 2, "speaker_name string, duration double")
    kept, gone = D.prune_speakers(c)
    assert kept.count() == 100 and rows(gone) == [("mid", 50, 200.0), ("tiny", 2, 4.0)]
    assert D.prune_speakers(c, 0, 0)[0].count() == 152


def test_clusters(spark):
    n = spark.createDataFrame([("v1", [1.0, 0.0, 0.0], 5.0), ("v2", [0.99, 0.01, 0.0], 6.0), ("v3", [0.0, 1.0, 0.0], 9.0)], "name string, embedding array<double>, speech_seconds double")
    got = P.cluster_speakers(n, 0.9, "host")
    assert rows(got.select("name", "speaker")) == [("v1", "host_s0"), ("v2", "host_s0"), ("v3", "host_s1")]
    assert tuple(P.cluster_counts(got).first()) == (2, 1, 3, 2)


def test_fallback(spark):
    n = spark.createDataFrame([("host__v1__spk_0",), ("host__v2__spk_0",), ("host__v2__spk_1",)], "name string")
    assert rows(P.fallback_map(n, "host").select("name", "speaker")) == [("host__v1__spk_0", "host_s0"), ("host__v2__spk_0", "host_s0"), ("host__v2__spk_1", "host_s1")]


def test_nearest_rank_half_even(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert [r[1] for r in R.nearest_rank(d, "v", [50]).collect()] == [3.0]  # rank 1.5 rounds to 2


def test_quotes(spark):
    s = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "sid int, text string")
    q = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "none")], "qid int, quote string")
    assert rows(R.match_quotes(q, s).select("qid", "sid", "how")) == [(1, 2, "exact"), (2, 1, "part")]


def test_summaries(spark):
    r = spark.createDataFrame([("kept", 3, 90.0), ("junk", 2, 1.0), ("quality", 1, 1.0)], "reason string, n long, seconds double")
    assert R.segment_summary(r).first()[0] == "kept 3 clips | rejected 3 (empty 0, quality 1, language 0, too short 0, text 0, duration 0, words 0, audio 0, align failed 0, junk 2) | speech 1.5 min"
    t = spark.createDataFrame([(5, 0, 2, 0, 0, 0, 1, {"uk": 3, "ru": 1, "en": 2}, 120.0)], "segments_kept int, rejected_non_target_language int, rejected_quality int, rejected_empty int, rejected_too_short int, rejected_alignment_failed int, marked_alignment_failed int, detected_languages map<string,int>, kept_speech_duration_sec double")
    assert t.select(R.transcript_summary("uk")).first()[0] == "kept 5 segments | rejected 2 | non-uk regions kept (en:2, ru:1) | quality 2 | align marked 1 | speech 2.0 min"


def test_partners(spark):
    c = spark.createDataFrame([(k, "a") for k in range(5)] + [(9, "b")], "clip_id long, speaker_name string")
    assert D.speaker_groups(c).count() == 5
    got = dict((r["clip_id"], r["partner"]) for r in D.partners(c).collect())
    assert sorted(got) == sorted(got.values()) == [0, 1, 2, 3, 4] and all(k != v for k, v in got.items())


def test_similar_pairs_against_plain_cosines(spark):
    r = random.Random(1)
    nodes = [(f"n{k}", [r.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [("null", None), ("zero", [0.0] * 4), ("short", [1.0, 2.0]), ("short2", [1.0, 2.1]), ("n3", [9.0, 0.0, 0.0, 0.0])]
    got = P.similar_pairs(spark.createDataFrame(nodes, "name string, embedding array<float>"), 0.6, block=16).collect()
    want = []
    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if x and y and len(x) == len(y) and any(x) and any(y) and a != b:
                c = sum(p * q for p, q in zip(x, y)) / math.dist(x, [0] * len(x)) / math.dist(y, [0] * len(y))
                if c > 0.6:
                    want.append((*sorted((a, b)), round(c, 5)))
    assert sorted((x.a, x.b, round(x.similarity, 5)) for x in got) == sorted(want) and ("short", "short2") in {x[:2] for x in want}
    assert P.similar_pairs(spark.createDataFrame([], "name long, embedding array<float>"), 0.5).count() == 0


def test_cosines_near_the_threshold_are_taken_in_doubles():
    import numpy as np

    x = np.random.default_rng(8).normal(size=(1500, 6))
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    u[7] = np.nan
    exact = np.einsum("ik,jk->ij", u, u)
    t = float(exact[20, 1400])  # itself not above
    want = {(i, j) for i, j in zip(*np.nonzero(exact > t + 1e-15)) if i < j}
    for cosines in (True, False):
        got = [(i, j) for p, q, _ in P._above(u, u, t, True, cosines) for i, j in zip(p.tolist(), q.tolist())]
        assert len(got) == len(set(got)) and want <= set(got) and all(exact[x] > t - 1e-15 for x in got)


def test_links_connect_what_pairs_connect(spark):
    r = random.Random(6)
    nodes = [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(240)]
    d = spark.createDataFrame(nodes, "name long, embedding array<float>").repartition(3)
    pairs, links = P.similar_pairs(d, 0.88, block=60), P.similar_links(d, 0.88, block=60)
    roots = lambda e: rows(P.clusters(e, d))
    want = roots(pairs)
    assert 5 < len({x for _, x in want}) < 200 and roots(links) == want
    dense = P.similar_links(d, -0.5, block=60)
    meetings, held = 10, 2 * 80  # a block has about 60 nodes
    assert dense.count() <= meetings * held < P.similar_pairs(d, -0.5, block=60).count() / 10


def test_splits_are_exact_without_a_global_order(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), (F.col("id") % 4).cast("string"))).alias("g"))
    plain = D.split_eval(d, F.col("id"))
    assert plain.where("is_eval").count() == 250 and plain.count() == 5000 and plain.columns == ["id", "g", "is_eval"]
    want = sorted(range(5000), key=lambda k: (__import__("hashlib").md5(f"42-{k}".encode()).hexdigest(), k))[:250]
    assert sorted(r.id for r in plain.where("is_eval").collect()) == sorted(want)
    per = {r.g: (r.n, r.e) for r in D.split_eval(d, F.col("id"), 0.1, by=["g"]).groupBy("g").agg(F.count("*").alias("n"), F.count_if("is_eval").alias("e")).collect()}
    assert all(e == n // 10 for n, e in per.values()) and len(per) == 5
    assert D.split_eval(d.where("id < 1"), F.col("id")).where("is_eval").count() == 0 and D.split_eval(d.where("false"), F.col("id")).count() == 0


def test_numbers_over_ranges(spark):
    d = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("k"), F.lit("x").alias("_chunk2")).repartition(5)
    got = D.numbered(d, [F.desc("k")]).collect()
    assert [r.seq for r in sorted(got, key=lambda r: -r.k)] == list(range(1, 3001))
    assert D.numbered(d.where("false"), [F.col("k")]).count() == 0


def test_held_within_against_brute_force(spark):
    r = random.Random(2)
    wholes = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 120))) for _ in range(80)] + [None, ""]
    parts = [w[a : a + n] for w in wholes if w for n in (1, 2, 3, 4, 7, 14, 15, 16, 40) for a in [r.randrange(len(w))]] + ["zzz", "q" * 30, None, ""]
    got = R.held_within(spark.createDataFrame([(p,) for p in parts], "p string"), spark.createDataFrame([(w,) for w in wholes], "w string"), "p", "w").collect()
    want = {(p, w) for p in parts for w in wholes if p and w is not None and p in w}
    assert {(x.p, x.w) for x in got} == want and len(got) == len(want)


def test_quotes_in_many_turns_against_brute_force(spark):
    r = random.Random(4)
    make = lambda n: "".join(r.choice(["an", "the ", "é", "or", " ", "ed. ", "\0", "x"]) for _ in range(n))
    turns = [(k, make(r.choice([1, 2, 5, 30, 300]))) for k in range(250)] + [(900, None)]
    pieces = [t[a : a + n] for _, t in turns[:120] if t for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 29, 30, 31, 32, 62, 63, 130, 260, 500) for a in [r.randrange(len(t))]]
    quotes = list(enumerate(pieces + [make(r.randrange(1, 40)) for _ in range(200)] + [t + "!" for _, t in turns[:80]]))
    want = []
    for k, q in quotes:
        same = [s for s, t in turns if t == q]
        part = [s for s, t in turns if t and (q in t or t in q)]
        want += [(k, max(same), "exact")] if same else [(k, min(part), "part")] if part and q else []
    s, q = spark.createDataFrame(turns, "sid long, text string").repartition(3), spark.createDataFrame(quotes, "qid long, quote string")
    found = R.match_quotes(q, s)
    assert rows(found.select("qid", "sid", "how")) == sorted(want)


def test_quotes_broadcast_no_keys(spark):
    """However small the files that texts come from."""
    t = spark.range(50).select(F.col("id").alias("sid"), F.concat(F.lit("turn number "), "id").alias("text"))
    plan = R.match_quotes(t.select(F.col("sid").alias("qid"), F.substring("text", 3, 12).alias("quote")), t)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan


def test_percentiles_of_nothing_are_zero(spark):
    d = spark.createDataFrame([(None,)], "v double")
    assert rows(R.nearest_rank(d, "v", [5, 50])) == [(5.0, 0.0), (50.0, 0.0)]


def test_audio_must_exist(spark):
    d = spark.createDataFrame([("wavs/a.wav", 1), ("wavs/b.wav", 2), ("old/c.wav", 3)], "audio_file string, k int")
    f = spark.createDataFrame([("file:/x/wavs/a.wav",), ("file:/x/other/b.wav",), ("file:/x/wavs/c.wav",)], "path string")
    assert rows(D.with_audio(d, f).select("k", "path")) == [(1, "file:/x/wavs/a.wav")]
    assert [k for k, _ in rows(D.with_audio(d, f, basename=True).select("k", "path"))] == [1, 2, 3]
    with pytest.raises(FileNotFoundError, match="2 audio files"):
        D.with_audio(d, f, missing="error")
    clips = spark.createDataFrame([("1", 9.0, "wavs/a.wav"), ("2", 8.1, "wavs/b.wav"), ("3", 2.0, "wavs/c.wav")], "clip_id string, duration double, audio_file string")
    assert D.hub_reference(clips, 8.0, f).first().clip_id == "1" and D.hub_reference(clips, 8.0).first().clip_id == "2" and D.hub_reference(clips, 8.0, f, first=1).count() == 0


def test_texts_of_references(spark):
    f = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, path string")
    t = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, text string")
    assert rows(D.zip_texts(f, t(" one", " "), "d")) == [(0, "a", "one"), (1, "b", "d")]
    assert rows(D.zip_texts(f, t("one"), "d")) == [(0, "a", "one"), (1, "b", "one")] and rows(D.zip_texts(f, t(), "d"))[0] == (0, "a", "d")
    with pytest.raises(ValueError, match="3 texts for 2"):
        D.zip_texts(f, t("a", "b", "c"))


def test_totals(spark):
    d = spark.createDataFrame([(1800.004,), (1800.0,)], "s double")
    assert tuple(d.agg(*R.totals(F.col("s"))).first()) == (2, 3600.0, 1.0) and tuple(d.where("false").agg(*R.totals(F.col("s"))).first()) == (0, 0.0, 0.0)
