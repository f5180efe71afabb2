"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The test items are the indexed documents of an inverted index; every passage of every
training document is a query. A passage is ``PASSAGE`` words, starting every
``PASSAGE / 2`` words. Items are cut into pieces of at most ``PASSAGE / 2`` words, about
equally long, and each piece is indexed: a piece copied word for word lies in some passage
as a whole. Scores are BM25 divided by the piece's score of itself, so one threshold serves
items of all lengths. Words are runs of letters, digits and non-ASCII
bytes, A-Z lower-cased, kept as 64-bit hashes.

Retrieval is exact. Pieces are numbered, and posting lists cut, in at most ``BLOCKS`` runs
of pieces. For all passages of a batch at once, the sums of their terms' block maxima bound
the scores within each block, and blocks whose bound is under the threshold are skipped;
within the others WAND goes through the posting lists, with the block's maxima as the
bounds of its pivots. The item of every piece at or above the threshold is then held, as a
whole, against the passage, as many words on either side as the item has before and after
the piece, and half a passage more: the share of the question's word n-grams and of
the answer's words found there must be high. An item's answer is what follows "Answer:",
or its last sentence.

The index is cut into shards of about ``SHARD_TERMS`` postings. A shard is made in one task
and written as a file in the shared folder; nothing of the index comes to the driver. The
documents are read once: a worker keeps up to ``LOADED`` shards in memory, and where there
are more, it takes shard after shard over ``HELD`` bytes of text at a time. BM25's
statistics are those of all pieces.

Defined cases: null or empty texts and items match nothing; an item without two sentences
is question and answer at once; an item is a different (item_id, text): different texts of
one id, one text of several ids and texts without an id are matched each; rows without
doc_id are handled like others; an empty benchmark leaves all documents clean; texts are
read whole, about 60 bytes of memory a word; columns of any name pass through.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, drop_written, filesystem, new_path, replace_file, written
from .minhash import mixed, word_hashes

PASSAGE = 128
THRESHOLD = 0.5
K1, B = 1.2, 0.75
BLOCKS = 64
SHARD_TERMS = 500_000
LOADED, HELD = 2, 1 << 25
QUESTION, ANSWER, QUESTION_ALONE = 0.5, 0.5, 0.8
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def hashed(text: str | bytes) -> np.ndarray:
    raw = text.encode() if isinstance(text, str) else text
    return word_hashes(np.frombuffer(raw, np.uint8), _APART)[0]


def question_and_answer(text: str) -> tuple[str, str]:
    """The parts of an item; both are the whole item where it does not come in two."""
    import re

    m = re.search(r"(?i)\banswer\s*:", text)
    if m and text[: m.start()].strip() and text[m.end() :].strip():
        return text[: m.start()], text[m.end() :]
    ends = [x.end() for x in re.finditer(r"[.!?]+\s+|\n+", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, text)


def n_grams(w: np.ndarray, n: int) -> np.ndarray:
    if len(w) < n:
        return w[:0]
    g = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        g = mixed(g + w[i : len(w) - n + 1 + i])
    return g


@dataclass(frozen=True)
class Index:
    """Posting lists of one shard. Pieces are numbered from 0 in the order of ``items``."""

    items: list  # of each piece, the item's id
    rows: list[int]  # of each piece, the item
    around: list[tuple[int, int]]  # of each piece, the item's words before and after it
    terms: np.ndarray  # sorted hashes
    block: int  # pieces in a block
    greatest: np.ndarray  # of each term and block, the greatest weight
    postings: list  # of each term: pieces, weights
    parts: list  # of each piece's item: n, question n-grams, answer words


def pieces(n: int) -> list[int]:
    """Where the pieces of an item of n words start, and n."""
    k = max(1, -(-n // (PASSAGE // 2)))
    return [n * j // k for j in range(k + 1)]


def _tokens(batches):
    import pyarrow as pa

    names = ["item", "piece", "term", "tf", "n"]
    for b in batches:
        for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
            w = hashed(t or "")
            cuts = pieces(len(w))
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for j, (x, y) in enumerate(zip(cuts, cuts[1:])):
                u, n = np.unique(w[x:y], return_counts=True)
                for c, v in zip(cols, (np.full(len(u), i), np.full(len(u), j), u.view(np.int64), n, np.full(len(u), y - x))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names)


@dataclass(frozen=True)
class Shards:
    """The index's files."""

    folder: str
    numbers: list[int]

    def load(self, k: int) -> Index:
        fs, base = filesystem(self.folder)
        with fs.open_input_stream(f"{base}/index-{k:05d}", compression=None) as f:
            texts, rows, ids = pickle.loads(f.read())
        return _shard(texts, rows, ids)


def build(benchmark: DataFrame) -> Shards:
    """The shards of the index, each made in a task of its own."""
    folder = new_path(benchmark.sparkSession, "bm25-index")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").dropDuplicates()
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "bm25")
    tokens = written(items.select("item", "text").mapInArrow(_tokens, "item long, piece long, term long, tf long, n long"), "bm25")
    postings = tokens.count()
    if not postings:
        return Shards(folder, [])
    count, mean = tokens.groupBy("item", "piece").agg(F.max("n").alias("n")).agg(F.count("*"), F.avg("n")).first()
    df = tokens.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(mean)))
    weights = tokens.join(df, "term").select("item", "piece", "term", (idf * tf).alias("w"))
    shards = -(-postings // SHARD_TERMS)
    cut = lambda d: d.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")).groupBy("shard")

    def make(key, own, rows):
        import pandas as pd

        k, fs = int(key[0]), filesystem(folder)
        if not len(rows):  # items without a word
            return pd.DataFrame({"shard": [], "postings": []})
        texts = dict(zip(own["item"].tolist(), ([t] for t in own["text"])))
        ids = {i: None if x is None or x != x else int(x) for i, x in zip(own["item"].tolist(), own["item_id"])}
        columns = rows.sort_values(["item", "piece", "term"])
        raw = pickle.dumps((texts, {c: columns[c].to_numpy() for c in ("item", "piece", "term", "w")}, ids))
        replace_file(fs[0], f"{fs[1]}/index-{k:05d}", lambda out: out.write(raw))
        return pd.DataFrame({"shard": [k], "postings": [len(rows)]})

    # ids beyond a double's whole numbers would be changed in a pandas column with nulls
    own = items.select("item", "text", F.col("item_id").cast("string").alias("item_id"))
    made = written(cut(own).cogroup(cut(weights)).applyInPandas(make, "shard int, postings long"), "bm25")
    numbers = sorted(r["shard"] for r in made.select("shard").collect())  # a number for each SHARD_TERMS postings
    for t in (made, tokens, items):
        drop_written(t)
    return Shards(folder, numbers)


def _parts(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    q, a = question_and_answer(text)
    wq, wa = hashed(q), hashed(a)
    if not len(wq) or not len(wa):
        wq = wa = hashed(text)
    n = max(1, min(5, len(wq)))
    return n, np.unique(n_grams(wq, n)), np.unique(wa)


def _shard(texts: dict, rows: dict, ids: dict | None = None) -> Index:
    """The index of the postings in ``rows``: arrays item, piece, term, w. ids: of each item its id, where that is another."""
    of = list(zip(rows["item"].tolist(), rows["piece"].tolist()))
    keys = sorted(set(of))
    number = {i: k for k, i in enumerate(keys)}
    at = np.array([number[i] for i in of])
    term = np.asarray(rows["term"], np.int64).view(np.uint64)
    w = np.asarray(rows["w"], np.float64)
    own = np.bincount(at, w, len(keys))
    w = w / own[at]
    order = np.lexsort((at, term))
    at, term, w = at[order], term[order], w[order]
    terms, starts = np.unique(term, return_index=True)
    block = -(-len(keys) // BLOCKS)
    greatest = np.zeros((len(terms), -(-len(keys) // block)), np.float32)
    np.maximum.at(greatest, (np.repeat(np.arange(len(terms)), np.diff([*starts, len(term)])), at // block), w)
    postings = [(at[a:b].tolist(), w[a:b].tolist()) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(term)])]
    parts = {i: _parts("\n".join(texts[i])) for i in {i for i, _ in keys}}
    cuts = {i: pieces(len(hashed("\n".join(texts[i])))) for i in parts}
    around = [(cuts[i][j], cuts[i][-1] - cuts[i][j + 1]) for i, j in keys]
    return Index([ids[i] if ids else i for i, _ in keys], [i for i, _ in keys], around, terms, block, greatest, postings, [parts[i] for i, _ in keys])


def wand(index: Index, terms: list[int], threshold: float, block: int) -> list[tuple[int, float]]:
    """(piece, score) of the block's pieces at or above the threshold, for a passage of these terms."""
    eps = 1e-5
    done = (block + 1) * index.block
    most = index.greatest[:, block]
    cur = []
    for t in terms:
        if most[t] > 0:
            p = bisect_left(index.postings[t][0], block * index.block)
            cur.append([index.postings[t][0][p], p, t])
    found = []
    while True:
        cur.sort()
        total, pivot = 0.0, -1
        for k, (item, _, t) in enumerate(cur):
            if item >= done:
                break
            total += most[t]
            if total >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            return found
        target = cur[pivot][0]
        while pivot + 1 < len(cur) and cur[pivot + 1][0] == target:
            pivot += 1
        if cur[0][0] == target:
            score = sum(index.postings[t][1][p] for _, p, t in cur[: pivot + 1])
            if score >= threshold - eps:
                found.append((target, score))
            target += 1
        for c in cur[: pivot + 1]:
            items = index.postings[c[2]][0]
            p = c[1]
            while p < len(items) and items[p] < target:
                p += 1
            c[0], c[1] = (items[p] if p < len(items) else done), p


def _matches(index: Index, rows: list) -> list[list[tuple]]:
    """Of each text: (item, its id, score, question overlap, answer overlap) of verified items."""
    half = PASSAGE // 2
    out: list[list] = [[] for _ in rows]
    space = np.full(1, 32, np.uint8)
    parts = [p for r in rows for p in ((r, space) if r is not None else (space,))]
    sizes = np.array([(len(r) if r is not None else 0) + 1 for r in rows])
    w, starts = word_hashes(np.concatenate(parts), _APART)
    if not len(w):
        return out
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    counts = np.diff(cuts)
    blocks = -(-counts // half)
    first = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(rows)), counts)
    block = first[doc] + (np.arange(len(w)) - cuts[:-1][doc]) // half
    t = np.searchsorted(index.terms, w)
    t[t == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[t] == w)
    pairs = np.unique(block[known] * len(index.terms) + t[known])
    b, t1 = pairs // len(index.terms), pairs % len(index.terms)
    sums = np.zeros((int(blocks.sum()) + 1, index.greatest.shape[1]), np.float32)
    if len(b):
        heads = np.flatnonzero(np.diff(b, prepend=-1))
        sums[b[heads]] = np.add.reduceat(index.greatest[t1], heads, axis=0)
    of = np.repeat(np.arange(len(rows)), blocks)
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    bounds = sums[:-1] + sums[1:] * ~last[:, None]
    seen: dict = {}  # overlaps of an item from one place on: the pieces of a copy share them
    edges = np.searchsorted(b, np.arange(int(blocks.sum()) + 1))
    passages, held = np.nonzero(bounds >= THRESHOLD - 1e-5)
    each, heads = np.unique(passages, return_index=True)
    for p, ks in zip(each.tolist(), np.split(held, heads[1:])):
        d = int(of[p])
        terms = np.unique(t1[edges[p] : edges[p + 1 if last[p] else p + 2]])
        # terms of both halves count once
        ks = ks[index.greatest[terms[:, None], ks].sum(axis=0) >= THRESHOLD - 1e-5]
        hits = [h for k in ks.tolist() for h in wand(index, terms.tolist(), THRESHOLD, k)]
        if not hits:
            continue
        at = cuts[d] + (p - first[d]) * half
        for piece, score in hits:
            before, after = index.around[piece]
            key = d, index.rows[piece], (at - before - cuts[d]) // half
            if key not in seen:
                near = w[max(cuts[d], at - before - half) : min(cuts[d + 1], at + PASSAGE + after + half)]
                n, question, answer = index.parts[piece]
                seen[key] = float(np.isin(question, n_grams(near, n)).mean()), float(np.isin(answer, near).mean())
            q, a = seen[key]
            if (q >= QUESTION and a >= ANSWER) or q >= QUESTION_ALONE:
                out[d].append((index.rows[piece], index.items[piece], score, q, a))
    return out


def _pieces(batch, size: int = 1 << 21):
    """Slices of a batch of about ``size`` bytes of text."""
    rows = byte_rows(batch.column("text"))
    at = 0
    while at < len(rows):
        end, n = at, 0
        while end < len(rows) and (end == at or n < size):
            n += len(rows[end]) if rows[end] is not None else 0
            end += 1
        yield at, rows[at:end]
        at = end


def _searched(batches, shards: Shards):
    """Each batch with the matches of each of its rows, of all shards."""
    loaded: OrderedDict[int, Index] = OrderedDict()

    def index(k: int) -> Index:
        if k not in loaded:
            while len(loaded) >= LOADED:
                loaded.popitem(last=False)
            loaded[k] = shards.load(k)
        return loaded[k]

    def search(held):
        found = [[[] for _ in range(b.num_rows)] for b in held]
        for k in sorted(shards.numbers, key=lambda k: k not in loaded):
            for b, hits in zip(held, found):
                for at, rows in _pieces(b):
                    for i, h in enumerate(_matches(index(k), rows)):
                        hits[at + i] += h
        return zip(held, found)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("text").nbytes
        if len(shards.numbers) <= LOADED or size >= HELD:
            yield from search(held)
            held, size = [], 0
    yield from search(held)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) rows to doc_id, item_id, score, question_overlap, answer_overlap: one row per leak."""
    shards = build(benchmark)

    def run(batches):
        import pyarrow as pa

        for b, found in _searched(batches, shards):
            ids = b.column("doc_id").to_pylist()
            got = []
            for doc, hits in zip(ids, found):
                best: dict = {}
                for h in hits:
                    best[h[0]] = max(best.get(h[0], h), h, key=lambda x: x[2:])
                got += [(doc, *best[k][1:]) for k in sorted(best)]
            cols = list(zip(*got)) if got else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item; their columns stay as they are."""
    shards = build(benchmark)

    def run(batches):
        import pyarrow as pa

        for b, found in _searched(batches, shards):
            yield b.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
