"""Named queries over the driver's tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets as D
from ..operators import gates as G
from ..operators import intervals as I
from ..operators import reports as R
from ..operators import sequence as S
from ..operators import speakers as P
from . import proxies as X

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes)


def _seconds():
    return [(F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end")]
_GATE_SQL = """CASE WHEN trim(text) = '' THEN 'empty' WHEN avg_logprob < -1.0 OR no_speech_prob > 0.6 OR compression_ratio > 2.4 THEN 'quality'
  WHEN end_ms - start_ms < 500 THEN 'too_short' END"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.segments(spark, sf_dir).select("*", *_seconds(), F.array().cast("array<struct<word:string,probability:double>>").alias("words"))
    return s.withColumn("reject_reason", G.segment_reason())


@query(_with(X.SEGMENTS_SQL) + f" SELECT video_id, id, {_GATE_SQL} AS reject_reason FROM seg")
def segment_gate_cascade(spark, sf_dir):
    return gated(spark, sf_dir).select("video_id", "id", "reject_reason")


@query(_with(X.SEGMENTS_SQL) + f" SELECT coalesce({_GATE_SQL}, 'kept') AS reason, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS ms FROM seg GROUP BY 1")
def segment_reject_report(spark, sf_dir):
    return G.reject_report(gated(spark, sf_dir).withColumn("ms", F.col("end_ms") - F.col("start_ms")), seconds="ms").withColumnRenamed("seconds", "ms")


def accepted_clips(spark, sf_dir):
    return gated(spark, sf_dir).where("reject_reason is null").select("video_id", "id", "start_ms", "end_ms", T.clean_text(F.col("text")).alias("text"), "speaker_id")


_ANTI = _with(X.SEGMENTS_SQL, X.EVENTS_SQL) + " SELECT video_id, id FROM seg s WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.video_id = s.video_id AND least(s.end_ms, e.end_ms) > greatest(s.start_ms, e.start_ms))"


def _spans(d):
    return d.withColumnRenamed("start_ms", "start").withColumnRenamed("end_ms", "end")


@query(_ANTI)
def junk_interval_anti(spark, sf_dir):
    return I.without_overlaps(_spans(X.segments(spark, sf_dir)), _spans(X.sound_events(spark, sf_dir))).select("video_id", "id")


@query(_ANTI)
def junk_interval_bucketed(spark, sf_dir):
    return I.without_overlaps(_spans(X.segments(spark, sf_dir)), _spans(X.sound_events(spark, sf_dir)), bucket=10_000).select("video_id", "id")


@query(_ANTI)
def junk_interval_nested(spark, sf_dir):
    nested = _spans(X.sound_events(spark, sf_dir)).groupBy("video_id").agg(F.collect_list(F.struct("start", "end")).alias("events"))
    s = X.segments(spark, sf_dir).join(nested, "video_id", "left")
    return s.where(~I.overlaps_any(F.col("start_ms"), F.col("end_ms"), F.col("events"))).select("video_id", "id")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def allowed_language(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").where(G.allowed_language(F.col("lang"), [" EN", "fr"])).select("doc_id", "lang")


@query(_with(X.SEGMENTS_SQL) + " SELECT video_id, id, CASE WHEN length(text) < 10 OR length(text) > 220 THEN 'text_length' WHEN end_ms - start_ms < 1500 OR end_ms - start_ms > 12000 THEN 'duration' END AS reason FROM seg")
def clip_length_gates(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    return s.select("video_id", "id", G.length_reason(F.length("text"), F.col("end_ms") - F.col("start_ms"), G.Lengths(min_seconds=1500, max_seconds=12000)).alias("reason"))


_MERGE_SQL = _with(
    X.SEGMENTS_SQL,
    f"kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id) AS rn FROM (SELECT * FROM seg WHERE ({_GATE_SQL}) IS NULL))",
    """fold AS (
  SELECT video_id, rn, id AS first, start_ms, end_ms, text, speaker_id, avg_logprob, no_speech_prob, 1 AS n FROM kept WHERE rn = 1
  UNION ALL
  SELECT k.video_id, k.rn, CASE WHEN ok THEN f.first ELSE k.id END, CASE WHEN ok THEN f.start_ms ELSE k.start_ms END, k.end_ms,
         CASE WHEN ok THEN f.text || ' ' || k.text ELSE k.text END, k.speaker_id, CASE WHEN ok THEN least(f.avg_logprob, k.avg_logprob) ELSE k.avg_logprob END,
         CASE WHEN ok THEN greatest(f.no_speech_prob, k.no_speech_prob) ELSE k.no_speech_prob END, CASE WHEN ok THEN f.n + 1 ELSE 1 END
  FROM (SELECT f.*, k AS k, k.start_ms - f.end_ms <= 300 AND k.end_ms - f.start_ms <= 12000 AND length(f.text) + 1 + length(k.text) <= 220
                            AND f.speaker_id IS NOT DISTINCT FROM k.speaker_id AS ok FROM fold f JOIN kept k ON k.video_id = f.video_id AND k.rn = f.rn + 1) f)""",
) + " SELECT video_id, first AS id, max_by(start_ms, n) AS start_ms, max_by(end_ms, n) AS end_ms, max_by(text, n) AS text, max_by(avg_logprob, n)::DOUBLE AS avg_logprob, max_by(no_speech_prob, n)::DOUBLE AS no_speech_prob, max(n)::INT AS n FROM fold GROUP BY video_id, first"


def _kept(spark, sf_dir):
    return gated(spark, sf_dir).where("reject_reason is null")


@query(_MERGE_SQL)
def greedy_segment_merge(spark, sf_dir):
    cols = ["id", "start_ms", "end_ms", "text", "speaker_id", "language", "avg_logprob", "no_speech_prob", "compression_ratio", "alignment_failed"]
    per = _kept(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("s"))
    m = per.select("video_id", F.explode(S.merge_adjacent(F.col("s"))).alias("m"))
    return m.select("video_id", "m.id", "m.start_ms", "m.end_ms", "m.text", "m.avg_logprob", "m.no_speech_prob", "m.n")


@query(_MERGE_SQL)
def greedy_merge_grouped(spark, sf_dir):
    return S.merge_grouped(_kept(spark, sf_dir), "video_id", ["id"]).select("video_id", "id", "start_ms", "end_ms", "text", "avg_logprob", "no_speech_prob", "n")


@query(
    r"""WITH RECURSIVE w AS (
  SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
t AS (SELECT *, sum(60 * (length(word) + 1)) OVER (PARTITION BY conv_id, turn ORDER BY i)::BIGINT AS e, 60 * length(word) AS d FROM w),
p AS (
  SELECT conv_id, turn, i, e - 60 - d AS s, e - 60 AS e, 1 AS pack FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.i, CASE WHEN t.e - 60 - p.s <= 12000 THEN p.s ELSE t.e - 60 - t.d END, t.e - 60, CASE WHEN t.e - 60 - p.s <= 12000 THEN p.pack ELSE p.pack + 1 END
  FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn AND t.i = p.i + 1)
SELECT conv_id, turn, pack::BIGINT AS pack, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n_words FROM p GROUP BY 1, 2, 3"""
)
def split_long_segments(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    words = F.split("text", " ", -1)
    # word times by cumulative characters; posexplode and a window keep this linear in a turn's words
    d = c.select("conv_id", "turn", F.posexplode(words).alias("i", "word")).withColumn("e", F.sum(60 * (F.length("word") + 1)).over(W.partitionBy("conv_id", "turn").orderBy("i")).cast("long") - 60)
    a = d.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word", "e"))), lambda x: F.struct(x["word"].alias("word"), (x["e"] - 60 * F.length(x["word"])).alias("start"), x["e"].alias("end"))).alias("w"))
    p = a.select("conv_id", "turn", F.posexplode(S.pack_words(F.col("w"), 12_000)).alias("k", "p"))
    return p.select("conv_id", "turn", (F.col("k") + 1).cast("long").alias("pack"), F.col("p.start").alias("start_ms"), F.col("p.end").alias("end_ms"), F.size("p.words").cast("long").alias("n_words"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, text, length(text) * 60 AS ms, regexp_split_to_array(trim(text), '\s+') AS w FROM conversations),
h AS (SELECT *, len(w) // 2 AS k FROM w)
SELECT conv_id, turn, 0::INT AS part, 0::DOUBLE AS start, ms / 2.0::DOUBLE AS "end", array_to_string(w[1:k], ' ') AS text FROM h WHERE len(w) >= 2
UNION ALL SELECT conv_id, turn, 1, ms / 2.0, ms, array_to_string(w[k + 1:], ' ') FROM h WHERE len(w) >= 2"""
)
def midpoint_split(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations").withColumn("ms", F.length("text") * 60).withColumn("h", T.halves(F.col("text")))
    d = c.where("h[1] <> ''").select("conv_id", "turn", F.posexplode(S.split_at_middle(F.lit(0), F.col("ms"), F.col("h"))).alias("part", "p"))
    return d.select("conv_id", "turn", "part", "p.start", "p.end", "p.text")


@query(r"""SELECT doc_id, trim(regexp_replace(replace(trim(regexp_replace(replace(text, '|', ' '), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '...', '.'), '[^\p{L}\p{N}_\s\x{400}-\x{4FF}.,!?;:\-—''"()«»]', '', 'g')) AS text FROM documents""")
def clean_text_pipe(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.clean_field(F.col("text")).alias("text"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END), ''), lang) AS text FROM documents")
def pick_text(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.first_text(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source")), F.col("lang")).alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '\*[^*]+\*', ' ', 'g'), '\[[^\[\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_nonspeech(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.strip_nonspeech(F.col("html")).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[aeiouyAEIOUY]+'))::INT AS n FROM documents")
def syllables(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.count_syllables(F.col("text")).alias("n"))


@query(r"SELECT conv_id, turn, 'chan__' || conv_id || '__' || role AS speaker FROM conversations")
def speaker_names(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.local_speaker(F.lit("chan"), F.col("conv_id").cast("string"), F.col("role")).alias("speaker"))


@query(r"SELECT s_suppkey, lower(trim(regexp_replace(trim(s_name), '[^a-zA-Z0-9_-]+', '-', 'g'), '-')) AS slug FROM supplier")
def slugify(spark, sf_dir):
    return X.table(spark, sf_dir, "supplier").select("s_suppkey", T.slugify(F.col("s_name")).alias("slug"))


@query("""SELECT d.doc_id, CASE WHEN quality = 0 THEN 'wer' WHEN length(text) < 10 OR length(text) > 2200 OR trim(text) = '' THEN 'text' WHEN d.doc_id % 11 = 0 THEN 'audio'
  WHEN n_chars > 0 AND (n_chars * 60 < 1500 OR n_chars * 60 > 120000) THEN 'duration' WHEN n_chars * 61 < 1500 OR n_chars * 61 > 120000 THEN 'measured' END AS reason
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def import_gate_cascade(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id", "left")
    wer = F.when(F.col("quality") == 1, "0.1").when(F.col("quality") == 0, "0.5")
    n = G.Lengths(min_seconds=1500, max_seconds=120_000, min_chars=10, max_chars=2200)
    return d.select("doc_id", G.import_reason(F.col("text"), F.col("doc_id") % 11 != 0, wer, (F.col("n_chars") * 60).cast("string"), F.col("n_chars") * 61, 0.3, n).alias("reason"))


@query("SELECT count(*) AS n, avg(ms)::DOUBLE AS mean_ms, count(DISTINCT lang) AS rates, string_agg(source, ' / ' ORDER BY doc_id) FILTER (k <= 3) AS texts FROM (SELECT *, n_chars * 60 AS ms, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE k <= 20")
def source_probe(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") * 60).alias("ms"))
    return R.source_probe(d, "lang", "ms", "source", "doc_id").withColumnRenamed("mean_seconds", "mean_ms")


_UNION_SQL = "SELECT lang, doc_id, row_number() OVER (ORDER BY lang, doc_id) AS seq, lpad((row_number() OVER (ORDER BY lang, doc_id))::VARCHAR, 6, '0') AS file FROM documents"


@query(_UNION_SQL)
def union_datasets(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    # every language is a part; the null one, the last in SQL, has a key too
    part = F.coalesce(F.concat(F.lit("0"), F.col("lang")), F.lit("1"))
    n = D.numbered(d.select("lang", "doc_id"), [F.col("doc_id").asc_nulls_last()], chunk=part)
    return n.select("lang", "doc_id", "seq", D.file_name(F.col("seq")).alias("file"))


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id, k <= CASE WHEN n > 1 THEN least(greatest(floor(n * 0.05), 1), n - 1) ELSE 0 END AS is_eval FROM r""")
def eval_split(spark, sf_dir):
    return D.split_eval(X.table(spark, sf_dir, "documents").select("lang", "doc_id"), F.col("doc_id"), by=["lang"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def dedupe_manifest(spark, sf_dir):
    return D.dedupe_latest(X.table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, sf_dir):
    return D.pending(X.table(spark, sf_dir, "documents").select("doc_id"), X.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT clip_id, CASE WHEN speaker_name IN ('src0', 'src1') THEN 'teacher' ELSE speaker_name END AS speaker_name, speaker_name IN ('src0', 'src1') AS changed FROM (SELECT doc_id AS clip_id, source AS speaker_name FROM documents)")
def speaker_map_apply(spark, sf_dir):
    m = spark.createDataFrame([("src0", "teacher"), ("src1", "teacher"), (" ", "nobody")], "name string, new_name string")
    return D.apply_map(X.clips(spark, sf_dir).select("clip_id", "speaker_name"), m, "speaker_name")


_PRUNE = X.CLIPS_SQL + ", t AS (SELECT speaker_name, count(*) AS clips, sum(ms)::BIGINT AS ms FROM clips GROUP BY 1), f AS (SELECT avg(clips) AS c, avg(ms) AS m FROM t)"


def _pruned(spark, sf_dir):
    c = X.clips(spark, sf_dir).withColumn("duration", F.col("ms"))
    mean = c.groupBy("speaker_name").agg(F.count("*").alias("n"), F.sum("ms").alias("ms")).agg(F.avg("n"), F.avg("ms")).first()
    return D.prune_speakers(c, mean[0], mean[1])


@query("WITH " + _PRUNE + " SELECT clip_id, speaker_name FROM clips WHERE speaker_name IN (SELECT speaker_name FROM t, f WHERE clips >= c AND t.ms >= m)")
def prune_speakers(spark, sf_dir):
    return _pruned(spark, sf_dir)[0].select("clip_id", "speaker_name")


@query("WITH " + _PRUNE + " SELECT speaker_name, clips, t.ms AS ms FROM t, f WHERE NOT (clips >= c AND t.ms >= m) ORDER BY t.ms, speaker_name LIMIT 12")
def dropped_speakers(spark, sf_dir):
    return _pruned(spark, sf_dir)[1].select("speaker_name", "clips", F.col("seconds").alias("ms")).orderBy("ms", "speaker_name").limit(12)


@query("SELECT source AS speaker_name, count(*) AS n FROM documents GROUP BY 1")
def speaker_histogram(spark, sf_dir):
    return X.clips(spark, sf_dir).groupBy("speaker_name").agg(F.count("*").alias("n"))


@query("SELECT source AS speaker_name, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 1")
def dominant_speaker(spark, sf_dir):
    return D.mode(X.clips(spark, sf_dir), "speaker_name", "clip_id")


@query("WITH " + X.CLIPS_SQL + " SELECT speaker_name, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker_name ORDER BY score DESC, abs(ms - 8000), clip_id) AS k FROM clips) WHERE k = 1")
def reference_clip(spark, sf_dir):
    c = X.clips(spark, sf_dir).withColumn("duration", F.col("ms")).withColumn("avg_word_score", F.lit(None).cast("double"))
    return D.reference_clips(c, D.rank_score(F.col("score"), F.col("avg_word_score"), F.lit(-1.0)), 8000).select("speaker_name", "clip_id")


@query("""WITH v AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT DISTINCT event_type, p::DOUBLE AS percent, v AS value FROM v, (SELECT unnest([5, 50, 90, 99]) AS p) WHERE k = round_even(p / 100.0 * (n - 1), 0)::BIGINT + 1""")
def nearest_rank_percentiles(spark, sf_dir):
    return R.nearest_rank(X.table(spark, sf_dir, "events"), "value", [5, 50, 90, 99], by=["event_type"])


@query("SELECT l_returnflag, count(*) AS n, median(l_quantity)::DOUBLE AS median, min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high FROM lineitem GROUP BY 1")
def corpus_spread(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*R.spread("l_quantity")).drop("mean")


@query(_with(X.SEGMENTS_SQL) + """ SELECT count(*) AS segments, count(DISTINCT video_id) AS files, sum(end_ms - start_ms)::BIGINT AS ms, count(*) FILTER (avg_logprob < -1.0) AS low_logprob,
  count(*) FILTER (no_speech_prob > 0.6) AS no_speech, count(*) FILTER (compression_ratio > 2.4) AS compressed, count(*) FILTER (length(text) < 10) AS short FROM seg""")
def corpus_quality_report(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    tally = lambda c, name: F.count_if(c).alias(name)
    return s.agg(F.count("*").alias("segments"), F.count_distinct("video_id").alias("files"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), tally(F.col("avg_logprob") < -1.0, "low_logprob"), tally(F.col("no_speech_prob") > 0.6, "no_speech"), tally(F.col("compression_ratio") > 2.4, "compressed"), tally(F.length("text") < 10, "short"))


@query(_with(X.SEGMENTS_SQL) + " SELECT video_id, id, avg_logprob::DOUBLE AS avg_logprob FROM seg ORDER BY avg_logprob, video_id, id LIMIT 5")
def worst_segments(spark, sf_dir):
    return R.extremes(X.segments(spark, sf_dir), "avg_logprob", 5, False, ["video_id", "id"]).select("video_id", "id", "avg_logprob")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 12")
def language_histogram(spark, sf_dir):
    return R.top_share(X.table(spark, sf_dir, "documents"), "lang")


_PAIRS_SQL = "p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


def _nodes(spark, sf_dir):
    return X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), "embedding", ((F.col("vec_id") * 97) % 1000 + 1).alias("speech_seconds"))


@query("WITH " + _PAIRS_SQL + " SELECT a, b, round(s, 6) AS similarity FROM p WHERE s > 0.4")
def embedding_similar_pairs(spark, sf_dir):
    return P.similar_pairs(_nodes(spark, sf_dir), 0.4).withColumn("similarity", F.round("similarity", 6))


@query(_with(_PAIRS_SQL, "e AS (SELECT a, b FROM p WHERE s > 0.4 UNION SELECT b, a FROM p WHERE s > 0.4 UNION SELECT vec_id, vec_id FROM embeddings)", "r AS (SELECT a AS n, b AS o FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.o = e.a)",
       "c AS (SELECT n AS name, min(o) AS root FROM r GROUP BY n)", "t AS (SELECT root, sum((name * 97) % 1000 + 1)::BIGINT AS speech, count(*) AS members FROM c GROUP BY root)",
       "k AS (SELECT *, (row_number() OVER (ORDER BY speech DESC, root) - 1)::INT AS rank FROM t)") + " SELECT name, c.root, rank, members, speech, 'speaker_s' || rank AS speaker FROM c JOIN k ON c.root = k.root")
def speaker_clusters(spark, sf_dir):
    return P.cluster_speakers(_nodes(spark, sf_dir), 0.4)


@query("""WITH n AS (SELECT DISTINCT 'chan__' || conv_id || '__' || role || (conv_id % 12) AS name FROM conversations), s AS (SELECT name, split_part(name, '__', 3) AS suffix FROM n),
k AS (SELECT suffix, row_number() OVER (ORDER BY regexp_replace(suffix, '[^0-9]', '', 'g')::BIGINT, suffix) - 1 AS rank FROM (SELECT DISTINCT suffix FROM s))
SELECT name, s.suffix, 'chan_s' || rank AS speaker FROM s JOIN k ON s.suffix = k.suffix""")
def fallback_clusters(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    n = c.select(F.concat(F.lit("chan__"), F.col("conv_id").cast("string"), F.lit("__"), F.col("role"), (F.col("conv_id") % 12).cast("string")).alias("name")).distinct()
    return P.fallback_map(n, "chan")


@query(_with(X.SEGMENTS_SQL) + """, q AS (SELECT item_id AS qid, text AS quote FROM benchmark UNION ALL SELECT 1000000 + video_id * 100000 + id, text FROM seg), s AS (SELECT conv_id * 1000 + turn AS sid, text FROM conversations),
x AS (SELECT qid, quote, max(sid) AS sid FROM q JOIN s ON quote = text GROUP BY 1, 2), y AS (SELECT qid, quote, min(sid) AS sid FROM q JOIN s ON contains(text, quote) OR contains(quote, text) WHERE text <> '' AND qid NOT IN (SELECT qid FROM x) GROUP BY 1, 2)
SELECT qid, sid, 'exact' AS how FROM x UNION ALL SELECT qid, sid, 'part' FROM y""")
def alignment_audit(spark, sf_dir):
    """Items and all sentences as quotes, whole turns as what may hold them."""
    c, s = X.table(spark, sf_dir, "conversations"), X.segments(spark, sf_dir)
    q = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote")).unionAll(s.select(F.lit(1000000) + F.col("video_id") * 100000 + F.col("id"), "text"))
    return R.match_quotes(q, c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sid"), "text")).select("qid", "sid", "how")


@query(_with(X.SEGMENTS_SQL) + """, a AS (SELECT *, (id * 31) % 7 = 0 AS failed, (video_id * 13) % 4 <> 0 AS aligned, id % 5 = 0 AS bare FROM seg)
SELECT count(*) AS segments, count(DISTINCT video_id) AS files, count(*) FILTER (aligned) AS aligned, count(*) FILTER (failed OR (aligned AND bare)) AS dropped,
  round(sum(end_ms - start_ms) / 1000.0, 3)::DOUBLE AS seconds, round(sum(CASE WHEN failed OR (aligned AND bare) THEN end_ms - start_ms ELSE 0 END) / 1000.0, 3)::DOUBLE AS dropped_seconds FROM a""")
def alignment_losses(spark, sf_dir):
    s = X.segments(spark, sf_dir).select("*", *_seconds()).withColumn("aligned", (F.col("video_id") * 13) % 4 != 0).withColumn("alignment_failed", (F.col("id") * 31) % 7 == 0)
    return R.audit(s.withColumn("words", F.when(F.col("id") % 5 != 0, F.array(F.lit("w")))))


def _thousandths(x):
    """Whole thousandths, by a product in the type of x: floats are multiplied as floats, as in SQL."""
    return F.floor(x * F.lit(1000).cast("float"))


@query("""WITH b AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), q AS (SELECT vec_id, label, i, floor(x * 1000) AS b, floor(x * 1000) + CASE WHEN i % 2 = 0 THEN vec_id % 5 ELSE 0 END AS t FROM b)
SELECT label, sum((t - b) * (t - b))::BIGINT AS d2, sum(b * b)::BIGINT AS b2, max(abs(t - b))::BIGINT AS max_abs, count(*) AS params, count(*) FILTER (t <> b) AS changed,
  round(CASE WHEN sum(b * b) > 0 THEN sqrt(sum((t - b) * (t - b)) / sum(b * b)) ELSE 0 END, 9)::DOUBLE AS rel_l2 FROM q GROUP BY label""")
def array_drift(spark, sf_dir):
    b = X.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select("vec_id", "label", "i", _thousandths(F.col("x")).alias("x"))
    t = b.select("vec_id", "i", (F.col("x") + F.when(F.col("i") % 2 == 1, F.col("vec_id") % 5).otherwise(0)).alias("x"))
    return R.drift(b, t, ["vec_id"], "label").withColumn("rel_l2", F.round("rel_l2", 9))


@query("""WITH b AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), q AS (SELECT vec_id, floor(x * 1000) AS b, floor(x * 1000) + CASE WHEN i % 2 = 0 THEN vec_id % 5 ELSE 0 END AS t FROM b)
SELECT vec_id, max(abs(t - b))::BIGINT AS max_abs, sum((t - b) * (t - b))::BIGINT AS d2 FROM q GROUP BY vec_id ORDER BY d2 DESC, vec_id LIMIT 20""")
def most_drifted(spark, sf_dir):
    """The tensors, one a vector, that moved most."""
    b = X.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", _thousandths(F.col("x")).alias("x"))
    t = b.select("vec_id", "i", (F.col("x") + F.when(F.col("i") % 2 == 1, F.col("vec_id") % 5).otherwise(0)).alias("x"))
    return R.extremes(R.drift(b.withColumn("tensor", F.col("vec_id")), t, ["vec_id"], "tensor"), "d2", 20, True, ["tensor"]).select(F.col("tensor").alias("vec_id"), "max_abs", "d2")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'only_b' WHEN l.doc_id IS NULL THEN 'only_a' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def key_set_diff(spark, sf_dir):
    return D.require_same_keys(X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT lang AS dataset, count(*) AS clips, sum(n_chars * 60)::BIGINT AS ms, count(DISTINCT source) AS speakers FROM documents GROUP BY 1")
def dataset_catalog(spark, sf_dir):
    return X.clips(spark, sf_dir).groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("clips"), F.sum("ms").alias("ms"), F.count_distinct("speaker_name").alias("speakers"))


@query("SELECT video_id, count(*) AS kept, sum(n)::BIGINT AS parts, sum(end_ms - start_ms)::BIGINT AS ms FROM (" + _MERGE_SQL + ") GROUP BY 1")
def transcript_stats(spark, sf_dir):
    m = greedy_segment_merge(spark, sf_dir)
    return m.groupBy("video_id").agg(F.count("*").alias("kept"), F.sum("n").alias("parts"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


from . import derived, literals  # noqa: E402

for more in (derived, literals):
    QUERIES.update(more.QUERIES)
    SQL.update(more.SQL)
