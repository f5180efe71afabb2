"""Language identification by nearest centroid.

A text is a vector of hashed byte 2- and 3-grams, (1 + log tf) * idf, normalised. Every
language has several centroids, found by spherical k-means over a bounded sample of its
labelled texts; a text gets the language of the centroid of highest cosine. The cosine
grows with the number of different grams in a text, so each language has a low quantile of
it for every half octave of that number, over texts that the centroids did not learn from
(half of the sample is held against centroids of the other half), whole and cut to
``CUTS`` bytes. A text whose cosine is under ``reject`` times the quantile of its language
and size is rejected: it lies farther away than nearly every text of its kind; the rest of
the way is left for the error of the quantile. The share of letters is held likewise.

The document frequencies behind the idf are counted over all labelled rows, map-side
first. Only the k-means sees a sample: about ``sample`` different texts a language, or all
it has, chosen by a hash of the text at a rate from the count of different texts.

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and is
rejected; with nothing to learn from, every text is. Grams without a letter do not count;
digits are alike. Sizes beyond those learned have the quantile of the nearest one; of fewer
than four texts a language, the texts themselves give it. Texts are read whole, in pieces, so
memory is bounded. Null labels are not learned from. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, schema_with, with_columns

DIM = 4096
PIECE = 1 << 20
CUTS = [2**k for k in range(3, 13)]
SIZES = 2 * 12 + 1  # half octaves up to DIM
UND = "und"


def _fold() -> np.ndarray:
    """Byte to byte: A-Z lower-cased, digits to 0, other ASCII non-letters to a space, the rest as is."""
    t = np.arange(256, dtype=np.uint32)
    for b in range(128):
        c = chr(b)
        t[b] = ord(c.lower()) if c.isalpha() else 48 if c.isdigit() else 32
    return t


FOLD = _fold()
ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])

ASCII_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def gram_counts(raw: np.ndarray) -> np.ndarray:
    """How often each hashed 2- and 3-gram of the text occurs."""
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(len(raw), 1), PIECE):
        v = FOLD[raw[max(0, at - 3) : at + PIECE]]
        v[1:][(v[:-1] == 0xC3) & (v[1:] >= 0x80) & (v[1:] < 0x9F)] += np.uint32(32)  # capitals with accents
        v = v[1:] if at else v  # the byte before the last grams of the piece before told its capitals only
        new = 0 if at == 0 else 1  # grams that the piece before has counted
        letter = (v != 32) & (v != 48)
        has2 = letter[:-1] | letter[1:]
        has3 = has2[:-1] | letter[2:]
        two = (v[:-1] << 8) | v[1:]
        three = (two[:-1] << 8) | v[2:]
        h2 = ((two[new:] + np.uint32(1)) * np.uint32(2654435761)) >> np.uint32(20)
        h3 = ((three + np.uint32(1 << 25)) * np.uint32(2246822519)) >> np.uint32(20)
        counts += np.bincount(h2[has2[new:]], minlength=DIM) + np.bincount(h3[has3], minlength=DIM)
    return counts


def has_letter(raw: np.ndarray) -> bool:
    if ASCII_LETTER[raw[:4096]].any() or ASCII_LETTER[raw].any():
        return True
    return any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def letter_share(raw: np.ndarray) -> float:
    """Of the bytes that are no white space, the share that letters take; non-ASCII bytes count as such."""
    return float((ASCII_LETTER[raw] | (raw > 127)).sum() / max((~ASCII_SPACE[raw]).sum(), 1))


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.empty((len(rows), DIM), np.float32)
    for i, raw in enumerate(rows):
        x[i] = gram_counts(raw)
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]  # of each centroid
    low: np.ndarray  # of each centroid and size, the low quantile of its language's cosines
    letters: np.ndarray  # of each centroid, the low quantile of its language's shares of letters


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, the next ones are drawn by distance.

    Centres that hold few texts, such as a lone string of digits, go: what lies near them
    is no text of the language.
    """
    rng = np.random.default_rng(8)
    c = [x.mean(axis=0)]
    c[0] = c[0] / max(np.linalg.norm(c[0]), 1e-12)
    while len(c) < min(k, len(x)):
        far = np.maximum(1 - (x @ np.array(c).T).max(axis=1).astype(np.float64), 1e-9)
        c.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(c, np.float32)
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (nearest == j).any():
                m = x[nearest == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    held = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    return c[held >= min(len(x) / (10 * k), held.max())]


def sizes(x: np.ndarray) -> np.ndarray:
    """The half octave of how many different grams each vector has."""
    return np.floor(2 * np.log2(np.maximum((x > 0).sum(axis=1), 1))).astype(int)


def _low(texts: list[np.ndarray], x: np.ndarray, idf: np.ndarray, k: int, q: float = 0.005, enough: int = 20) -> np.ndarray:
    """Of each size, the low quantile of the cosines of texts with centroids of other texts."""
    halves = [(x[::2], texts[1::2]), (x[1::2], texts[::2])] if len(texts) >= 4 else [(x, texts)]
    at, best = [], []
    for learn, held in halves:
        c = _k_means(learn, k)
        for n in [*CUTS, None]:
            part = [t[:n] for t in held if n is None or len(t) > n]
            if part:
                v = vectors(part, idf)
                at.append(sizes(v))
                best.append((v @ c.T).max(axis=1))
    at, best = np.concatenate(at), np.concatenate(best)
    count = np.bincount(at, minlength=SIZES)
    known = np.flatnonzero(count >= min(enough, count.max()))
    return np.interp(np.arange(SIZES), known, [np.quantile(best[at == b], q) for b in known])


def fit(labelled: DataFrame, k: int = 4, sample: int = 1000) -> Model:
    """Learn from (text, lang). ``sample`` bounds the texts a language that k-means sees."""
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def frequencies(batches):
        import pyarrow as pa

        df = np.zeros(DIM, np.int64)
        n: dict[str, int] = {}
        for b in batches:
            for raw in byte_rows(b.column("text")):
                df += gram_counts(raw) > 0
            for lang in b.column("lang").to_pylist():
                n[lang] = n.get(lang, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(DIM)] + ["lang:" + x for x in n]), pa.array(df.tolist() + list(n.values()))], ["key", "n"])

    counted = {r["key"]: r["n"] for r in rows.mapInArrow(frequencies, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    per_lang = {x[5:]: n for x, n in counted.items() if x.startswith("lang:")}
    total = sum(per_lang.values())
    df = np.array([counted.get(str(i), 0) for i in range(DIM)], np.float64)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1)
    if not total:
        return Model(idf, np.zeros((0, DIM), np.float32), (), np.zeros((0, SIZES), np.float32), np.zeros(0, np.float32))

    h = F.xxhash64(F.lit(8), "text")
    rate = rows.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n")).select("lang", F.least(F.lit(1.0), sample / F.col("n")).alias("rate"))
    drawn = rows.withColumn("h", h).join(F.broadcast(rate), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def cluster(pdf):
        import pandas as pd

        pdf = pdf.sort_values("h")
        texts = [np.frombuffer(t.encode(), np.uint8) for t in pdf["text"]]
        x = vectors(texts, idf)
        c = _k_means(x, k)
        low = _low(texts, x, idf, k).tolist()
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "c": [v.tolist() for v in c], "low": [low] * len(c), "letters": float(np.quantile([letter_share(t) for t in texts], 0.005))})

    found = sorted(drawn.groupBy("lang").applyInPandas(cluster, "lang string, k int, c array<float>, low array<float>, letters double").collect(), key=lambda r: (r["lang"], r["k"]))
    return Model(idf, np.array([r["c"] for r in found], np.float32).reshape(-1, DIM), tuple(r["lang"] for r in found), np.array([r["low"] for r in found], np.float32).reshape(-1, SIZES), np.array([r["letters"] for r in found], np.float32))


def predict(docs: DataFrame, model: Model, reject: float = 0.8) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected; only ``text`` is read for them."""
    schema = schema_with(docs, lang_pred="string", score="double", rejected="boolean")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = byte_rows(b.column("text"))
            lang, score, out = [UND] * len(rows), [0.0] * len(rows), [True] * len(rows)
            ok = [i for i, r in enumerate(rows) if r is not None and len(model.langs) and has_letter(r)]
            for at in range(0, len(ok), 256):
                part = ok[at : at + 256]
                x = vectors([rows[i] for i in part], model.idf)
                sims = x @ model.centroids.T
                best = sims.argmax(axis=1)
                bare = np.array([letter_share(rows[i]) for i in part]) < reject * model.letters[best]
                for i, j, s, least, few in zip(part, best.tolist(), sims.max(axis=1).tolist(), (reject * model.low[best, sizes(x)]).tolist(), bare.tolist()):
                    lang[i], score[i], out[i] = model.langs[j], min(1.0, max(0.0, s)), s < least or few
            yield with_columns(b, ["lang_pred", "score", "rejected"], [pa.array(lang), pa.array(score, pa.float64()), pa.array(out)])

    return docs.mapInArrow(run, schema)
