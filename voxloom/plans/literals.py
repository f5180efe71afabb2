"""Queries over fixed examples: the driver's tables hold no Cyrillic and no audio.

Each example is an input with the result it must have; the SQL gives the results as values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import chunks as C
from ..functions import numbers as N
from ..functions import stress as Z
from ..functions import text as T
from ..operators import gates as G
from ..operators import reports as R
from ..operators import sequence as S
from . import proxies as X

QUERIES: dict = {}
SQL: dict = {}


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return f"{x}::DOUBLE"
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def examples(columns: str, rows: list[tuple]):
    """Registers a query whose SQL is the table of its expected rows."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({columns})"
        return f

    return add


def _rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


NUMBERS = {
    "Чули про Сховище 81?": "Чули про Сховище вісімдесят один?", "Мені потрібно 2000 кришок.": "Мені потрібно дві тисячі кришок.", "рівно о 21:00": "рівно о двадцять перша нуль нуль",
    "35% алкоголю": "тридцять п'ять відсотків алкоголю", "Реактор №3": "Реактор номер три", "накази, X6?": "накази, X6?", "з 15-го числа": "з п'ятнадцятого числа", "2-х": "двох", "15-ти": "п'ятнадцяти",
    "10-15": "десять — п'ятнадцять", "22 жовтня 2077 року": "двадцять друге жовтня дві тисячі сімдесят сьомого року", "3 928 метрів": "три тисячі дев'ятсот двадцять вісім метрів", "70 на 30": "сімдесят на тридцять",
    "2,74%": "дві цілих сімдесят чотири відсотків", "1ша": "перша", "15th": "п'ятнадцятий", "без чисел": "без чисел", "2000-х": "дві тисячіих",
}


@examples("text, words", list(NUMBERS.items()))
def expand_numbers(spark, sf_dir):
    return _rows(spark, [(t,) for t in NUMBERS], "text string").withColumn("words", N.expand_numbers(F.col("text")))


@examples("id, rule, span", [(1, "countdown", "10..."), (1, "countdown", "9..."), (2, "deal_split", "70 на 30"), (3, "vault_id", "Сховище 81"), (3, "caps_amount", "250 кришок"), (4, "year_with_roku", "у 2077"), (5, "temperature", "45°"), (6, "year_bare_fallout", "1984"), (6, "bare_thousands_plus", "2078")])
def number_spans(spark, sf_dir):
    d = _rows(spark, [(1, "10... 9..."), (2, "70 на 30 і цуценя"), (3, "Сховище 81, 250 кришок"), (4, "сталося у 2077 році"), (5, "45°C"), (6, "1984 2078"), (7, "X")], "id int, text string")
    return d.select("id", F.explode(N.number_spans(F.col("text"))).alias("s")).select("id", "s.rule", F.col("s.text").alias("span"))


@examples("text, fixed", [("Памятаєте?", "Пам'ятаєте?"), ("зявилася", "з'явилася"), ("імя", "ім'я"), ("М’ЯСО", "М'ЯСО"), ("обєкт", "об'єкт"), ("слово", "слово")])
def apostrophe_fix(spark, sf_dir):
    return _rows(spark, [(t,) for t in ("Памятаєте?", "зявилася", "імя", "М’ЯСО", "обєкт", "слово")], "text string").withColumn("fixed", Z.repair(F.col("text")))


@examples("text, marked", [("Ральф і РАЛЬФ", "Ра́льф і РА́ЛЬФ"), ("мама", "ма́ма"), ("Ра́льф мама", "Ра́льф мама")])
def lexicon_join(spark, sf_dir):
    words = Z.lexicon(["# names", "Ра́льф", "мама\tма́ма", "без наголосу"])
    return _rows(spark, [("Ральф і РАЛЬФ",), ("мама",), ("Ра́льф мама",)], "text string").withColumn("marked", Z.mark(F.col("text"), words))


@examples("word, script", [("injury", "en"), ("поранення", "uk"), ("—", None), ("PTSD", "en"), ("xдвa", "uk")])
def word_scripts(spark, sf_dir):
    return _rows(spark, [(w,) for w in ("injury", "поранення", "—", "PTSD", "xдвa")], "word string").withColumn("script", T.word_script(F.col("word")))


@examples("text, tag, language", [("one's shoulder", "ru", "en"), ("вывыхнутый плече", "uk", "ru"), ("Армийско-английско", "ru", "ru"), ("синець, забій", "ru", "uk"), ("…", "UK ", "uk"), ("слово", None, "uk")])
def language_refine(spark, sf_dir):
    d = _rows(spark, [("one's shoulder", "ru"), ("вывыхнутый плече", "uk"), ("Армийско-английско", "ru"), ("синець, забій", "ru"), ("…", "UK "), ("слово", None)], "text string, tag string")
    return d.withColumn("language", T.assign_clip_language(F.col("text"), F.col("tag")))


@examples("k, script, text", [(0, "en", "An injury –"), (1, "uk", "поранення, травма.")])
def script_runs(spark, sf_dir):
    d = _rows(spark, [("An injury – поранення, травма.",)], "text string").select(F.posexplode(S.script_runs(F.split("text", " "), T.word_script)).alias("k", "r"))
    return d.select("k", "r.script", F.array_join("r.words", " ").alias("text"))


@examples("spec, repo_id, config, split, speaker", [("Anna/speech-uk:lada@test=lada", "Anna/speech-uk", "lada", "test", "lada"), ("a/b=Mykyta#40000", "a/b", None, "train", "mykyta"), ("a/b", None, None, None, None), ("=x", None, None, None, None), ("a/b=", None, None, None, None)])
def parse_source(spark, sf_dir):
    specs = ["Anna/speech-uk:lada@test=lada", "a/b=Mykyta#40000", "a/b", "=x", "a/b="]
    return _rows(spark, [(s,) for s in specs], "spec string").withColumn("p", T.parse_source(F.col("spec"))).select("spec", "p.repo_id", "p.config", "p.split", "p.speaker")


@examples("id, k, chunk", [(1, 0, "Перше речення. Друге речення."), (1, 1, "Третє."), (2, 0, "abcdefghij"), (2, 1, "klm")])
def chunk_literals(spark, sf_dir):
    d = _rows(spark, [(1, "Перше речення. Друге речення. Третє.", 32), (2, "abcdefghijklm", 10), (3, "  ", 10)], "id int, text string, n int")
    one = d.where("n = 32").select("id", F.posexplode(C.chunk_text(F.col("text"), 32)).alias("k", "chunk"))
    return one.unionAll(d.where("n = 10").select("id", F.posexplode(C.chunk_text(F.col("text"), 10)).alias("k", "chunk")))


def chunk_text(spark, sf_dir):
    """All documents in chunks of at most 200 characters."""
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(C.chunk_text(F.col("text"), 200)).alias("k", "chunk"))


QUERIES["chunk_text"] = chunk_text


@examples("texts, reference", [("перший|другий", "<|speaker:0|>перший\n<|speaker:1|>другий"), ("один", "один")])
def reference_text(spark, sf_dir):
    return _rows(spark, [("перший|другий",), ("один",)], "texts string").withColumn("reference", T.reference_text(F.split("texts", r"\|")))


@examples("id, words, alignment, reason", [(1, "0.9,0.8", "ok", None), (2, "0.9,0.1,0.1", "ok", "word_quality"), (3, "", "ok", "alignment_failed"), (4, "0.9", "failed", "alignment_failed")])
def word_quality_gates(spark, sf_dir):
    d = _rows(spark, [(1, "0.9,0.8", "ok"), (2, "0.9,0.1,0.1", "ok"), (3, "", "ok"), (4, "0.9", "failed")], "id int, words string, alignment string")
    scores = F.filter(F.split("words", ","), lambda x: x != "")
    s = d.withColumn("w", F.transform(scores, lambda x: F.struct(F.lit("w").alias("word"), x.cast("double").alias("probability"))))
    s = s.select("id", "alignment", F.col("words").alias("raw"), F.col("w").alias("words"), F.lit("text").alias("text"), F.lit(-0.5).alias("avg_logprob"), F.lit(0.0).alias("no_speech_prob"), F.lit(1.0).alias("compression_ratio"), (F.col("alignment") == "failed").alias("alignment_failed"), F.lit("uk").alias("language"), F.lit(0.0).alias("start"), F.lit(2.0).alias("end"))
    return s.select("id", F.col("raw").alias("words"), "alignment", G.segment_reason(target=F.lit("uk"), aligned=F.lit(True)).alias("reason"))


@examples("mean_db, peak_db, passes", [(-20.0, -3.0, "yes"), (-41.0, -3.0, "no"), (-8.0, -1.0, "yes"), (-20.0, -0.5, "no"), (None, -3.0, "no")])
def volume_gate(spark, sf_dir):
    d = _rows(spark, [(-20.0, -3.0), (-41.0, -3.0), (-8.0, -1.0), (-20.0, -0.5), (None, -3.0)], "mean_db double, peak_db double")
    return d.withColumn("passes", F.when(G.loud_enough(F.col("mean_db"), F.col("peak_db"), normalised=False), "yes").otherwise("no"))


@examples("flag, truth", [("Yes", 1), ("0", 0), (" on ", 1), ("off", 0), (None, 0)])
def flag_parse(spark, sf_dir):
    return _rows(spark, [("Yes",), ("0",), (" on ",), ("off",), (None,)], "flag string").withColumn("truth", T.is_true(F.col("flag")).cast("int"))


@examples("encoded, size", [("aGVsbG8=", 5), ("!!", None), ("", None), ("aGVsbG8gd29ybGQ=", None)])
def audio_decode(spark, sf_dir):
    d = _rows(spark, [("aGVsbG8=",), ("!!",), ("",), ("aGVsbG8gd29ybGQ=",)], "encoded string")
    return d.withColumn("size", F.octet_length(T.decode_audio(F.col("encoded"), 8)))


def _tones(spark) -> DataFrame:
    """Tones of one to four seconds, quieter from id to id, with a pause in the middle."""
    rate = 16_000
    rows = []
    for k in range(1, 5):
        x = (0.8 / k * np.sin(2 * math.pi * 220 * np.arange(rate * k) / rate)).astype(np.float32)
        x[len(x) // 2 : len(x) // 2 + rate // 5] = 0
        rows.append((k, x.tolist(), rate))
    return spark.createDataFrame(rows, "id int, samples array<float>, sample_rate int")


def audio_levels(spark, sf_dir):
    """Tones matched to one speech level: measured before and after."""
    @F.pandas_udf("double")
    def level(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([round(A.speech_rms(np.asarray(x, np.float32), int(k)), 2) for x, k in zip(s, r)])

    d = _tones(spark).withColumn("before", level("samples", "sample_rate"))
    d = A.over_clips(d, lambda x, r: A.match_level(x, r, 0.2, 0.9))
    return d.select("id", "before", level("samples", "sample_rate").alias("after"))


QUERIES["audio_levels"] = audio_levels
SQL["audio_levels"] = "SELECT id, before::DOUBLE AS before, after::DOUBLE AS after FROM (VALUES (1, 0.57, 0.2), (2, 0.28, 0.2), (3, 0.19, 0.2), (4, 0.14, 0.2)) AS t(id, before, after)"


def audio_slots(spark, sf_dir):
    """Tones fitted to the slot of a reference of three seconds."""
    reference = (0.5 * np.sin(2 * math.pi * 220 * np.arange(48_000) / 16_000)).astype(np.float32)
    d = A.over_clips(_tones(spark), lambda x, r: A.fit_slot(A.remaster(A.undo_fade(x, r), r), r, reference, 16_000, 9, 9))
    return d.select("id", F.size("samples").alias("n"))


QUERIES["audio_slots"] = audio_slots


def streaming_import(spark, sf_dir):
    """Documents through the import gates as a stream of files; one row a reason."""
    import uuid

    from ..streaming.importer import judged

    name = "import_" + uuid.uuid4().hex
    rows = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{sf_dir}/documents.parquet*")
    rows = rows.select("doc_id", "text", F.lit(True).alias("has_audio"), F.lit("0.1").alias("wer"), (F.col("n_chars") * 60).cast("string").alias("declared"), (F.col("n_chars") * 60).alias("measured"))
    n = G.Lengths(min_seconds=1500, max_seconds=120_000, min_chars=10, max_chars=2200)
    counts = judged(rows, n=n).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.table(name)
    spark.catalog.dropTempView(name)  # what the view named stays with the result
    return found


QUERIES["streaming_import"] = streaming_import
SQL["streaming_import"] = r"""WITH c AS (SELECT n_chars * 60 AS ms, trim(regexp_replace(replace(trim(regexp_replace(replace(text, '|', ' '), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '...', '.'), '[^\p{L}\p{N}_\s\x{400}-\x{4FF}.,!?;:\-—''"()«»]', '', 'g')) AS text FROM documents)
SELECT CASE WHEN coalesce(text, '') = '' OR length(text) NOT BETWEEN 10 AND 2200 THEN 'text' WHEN ms > 0 AND ms NOT BETWEEN 1500 AND 120000 THEN 'duration'
  WHEN ms IS NULL OR ms NOT BETWEEN 1500 AND 120000 THEN 'measured' ELSE 'kept' END AS reason, count(*) AS n FROM c GROUP BY 1"""


def top_clips(spark, sf_dir):
    return R.extremes(X.clips(spark, sf_dir), "score", 5, True, ["clip_id"]).select("clip_id", "score")


QUERIES["top_clips"] = top_clips
SQL["top_clips"] = "SELECT doc_id AS clip_id, ((doc_id * 37) % 100) / 100.0::DOUBLE AS score FROM documents ORDER BY score DESC, clip_id LIMIT 5"
