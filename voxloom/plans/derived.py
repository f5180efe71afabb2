"""Queries that drive gates and text functions over whole tables, by fixed integer rules.

The rules give the tables' rows what they lack (levels, word probabilities, flags, specs);
each has a twin in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates as G
from ..operators import reports as R
from . import proxies as X

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT event_id, coalesce(mean_db BETWEEN -40 AND -8 AND peak_db <= -1, false) AS passes FROM (
  SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN -(floor(value)::BIGINT % 60)::DOUBLE END AS mean_db, -((event_id * 37) % 40) / 10.0 AS peak_db FROM events)""")
def event_volume_gate(spark, sf_dir):
    """Levels by event; every eleventh was not measured."""
    mean, peak = F.when(F.col("event_id") % 11 != 0, -(F.floor("value").cast("long") % 60).cast("double")), -((F.col("event_id") * 37) % 40) / 10.0
    return X.table(spark, sf_dir, "events").select("event_id", G.loud_enough(mean, peak, normalised=False).alias("passes"))


#: Probabilities are whole 128ths, so sums are the same in any order.
_WORDS_SQL = X.SEGMENTS_SQL + """, w AS (SELECT video_id, id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM seg),
m AS (SELECT video_id, id, avg(((i * 37 + id * 11 + video_id * 3) % 128) / 128.0::DOUBLE) AS mean, count(*) FILTER ((i * 37 + id * 11 + video_id * 3) % 128 < 64) / count(*)::DOUBLE AS low FROM w GROUP BY 1, 2)"""


def _worded(spark, sf_dir):
    """Segments with the words of their text and a probability each; every fifth has none."""
    p = lambda i: ((i * 37 + F.col("id") * 11 + F.col("video_id") * 3) % 128) / 128.0
    words = F.transform(F.split("text", " ", -1), lambda w, i: F.struct(w.alias("word"), p(i).alias("probability")))
    s = X.segments(spark, sf_dir).withColumn("words", F.when(F.col("id") % 5 != 0, words))
    return s.withColumn("start", F.col("start_ms") / 1000.0).withColumn("end", F.col("end_ms") / 1000.0)


@query(f"WITH {_WORDS_SQL} SELECT m.video_id, m.id, CASE WHEN m.id % 5 <> 0 THEN mean END AS mean_score, CASE WHEN m.id % 5 <> 0 THEN low END AS low_share FROM m")
def segment_word_scores(spark, sf_dir):
    s = _worded(spark, sf_dir)
    return s.select("video_id", "id", G.mean_score(F.col("words")).alias("mean_score"), G.low_share(F.col("words"), 0.5).alias("low_share"))


@query(f"""WITH {_WORDS_SQL}, a AS (SELECT seg.*, mean, low, seg.video_id % 2 = 0 AS aligned, (seg.id * 31) % 17 = 0 AS failed, seg.id % 5 = 0 AS bare,
  CASE (seg.id + seg.video_id) % 4 WHEN 0 THEN 'en' WHEN 1 THEN NULL ELSE 'uk' END AS lang FROM seg JOIN m ON seg.video_id = m.video_id AND seg.id = m.id)
SELECT video_id, id, CASE WHEN trim(text) = '' THEN 'empty' WHEN avg_logprob < -1.0 OR no_speech_prob > 0.6 OR compression_ratio > 2.4 THEN 'quality'
  WHEN failed OR (aligned AND bare) THEN 'alignment_failed' WHEN lang <> 'uk' THEN 'language' WHEN end_ms - start_ms < 500 THEN 'too_short'
  WHEN NOT bare AND (mean < 0.5 OR low > 0.35) THEN 'word_quality' END AS reason FROM a""")
def segment_full_cascade(spark, sf_dir):
    """All six gates, with a target language and aligned videos."""
    k = (F.col("id") + F.col("video_id")) % 4
    s = _worded(spark, sf_dir).withColumn("alignment_failed", (F.col("id") * 31) % 17 == 0).withColumn("language", F.when(k == 0, "en").when(k != 1, "uk"))
    return s.select("video_id", "id", G.segment_reason(target=F.lit("uk"), aligned=F.col("video_id") % 2 == 0).alias("reason"))


@query(r"""WITH w AS (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents), n AS (SELECT len(regexp_extract_all(word, '[\x{400}-\x{4FF}]')) AS c, len(regexp_extract_all(word, '[A-Za-z]')) AS l FROM w)
SELECT CASE WHEN c = 0 AND l = 0 THEN 'none' WHEN c >= l THEN 'uk' ELSE 'en' END AS script, count(*) AS n FROM n GROUP BY 1""")
def document_word_scripts(spark, sf_dir):
    w = X.table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t-\r]+")).alias("word"))
    return w.groupBy(F.coalesce(T.word_script(F.col("word")), F.lit("none")).alias("script")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, CASE WHEN count(*) > 1 THEN string_agg('<|speaker:' || k || '|>' || text, chr(10) ORDER BY k) ELSE max(text) END AS reference
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) GROUP BY conv_id""")
def turn_reference_texts(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return c.select("conv_id", T.reference_text(F.col("texts")).alias("reference"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) BETWEEN 1 AND 2000 THEN octet_length(encode(text)) END::INT AS size FROM documents")
def decoded_sizes(spark, sf_dir):
    """Whole texts through base64 and back, if they are short enough."""
    return X.table(spark, sf_dir, "documents").select("doc_id", F.octet_length(T.decode_audio(F.base64(F.encode("text", "UTF-8")), 2000)).alias("size"))


@query("SELECT o_orderkey, lower(trim(flag)) IN ('1', 'true', 'yes', 'on') AS truth FROM (SELECT o_orderkey, ['Yes', '0', ' on ', 'off', 'TRUE', ''][o_orderkey % 6 + 1] AS flag FROM orders)")
def order_flags(spark, sf_dir):
    flags = F.array(*map(F.lit, ("Yes", "0", " on ", "off", "TRUE", "")))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.is_true(F.element_at(flags, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("truth"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN source || '/' || lang END AS repo_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 'cfg' || doc_id END AS config,
  CASE WHEN doc_id % 4 = 2 THEN 'test' WHEN doc_id % 4 < 3 THEN 'train' END AS split, CASE WHEN doc_id % 4 < 3 THEN 'who-' || lang END AS speaker FROM documents""")
def source_specs(spark, sf_dir):
    """Specs with and without configuration and split; every fourth lacks its speaker."""
    k, text = F.col("doc_id") % 4, lambda c: F.col(c).cast("string")
    repo = F.concat(F.lit(" "), text("source"), F.lit("/"), text("lang"))
    spec = F.concat(repo, F.when(k.isin(1, 2), F.concat(F.lit(":cfg"), text("doc_id"))).otherwise(""), F.when(k == 2, "@test").otherwise(""), F.when(k < 3, F.concat(F.lit("= Who "), text("lang"), F.lit("#40"))).otherwise(""))
    return X.table(spark, sf_dir, "documents").select("doc_id", T.parse_source(spec).alias("p")).select("doc_id", "p.repo_id", "p.config", "p.split", "p.speaker")


@query("WITH " + X.CLIPS_SQL + " SELECT count(*) AS clips, round(sum(ms), 2)::DOUBLE AS seconds, round(sum(ms) / 3600, 2)::DOUBLE AS hours FROM clips")
def clip_totals(spark, sf_dir):
    return X.clips(spark, sf_dir).agg(*R.totals(F.col("ms")))
