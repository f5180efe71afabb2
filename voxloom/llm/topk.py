"""Exact top-k search by exhaustive term-at-a-time accumulation over sparse integer rows.

Candidates are cut into blocks of about ``BLOCK`` rows by a hash of the row; a block is
stored as an inverted index: for every term (dimension) the rows that hold it and their
weights. Queries are cut into blocks of about ``QUERY_BLOCK`` rows too. Blocks are files in
the shared folder, each written once; a task takes one query block and reads a share of the
candidate blocks one after the other, so neither side is shuffled, copied or broadcast for
the meeting, and a task holds one block of each. Where two blocks meet, the queries go
through their non-zero terms one by one, ``TILE`` queries at a time, and scatter weight
times posting weight into dense arrays of scores; the best k come from a partition
selection, exact at ties. A task keeps the best k of its share, so what it returns does not
grow with the candidates; the shares' results are merged.

Weights and scores are longs. Where the greatest products of two blocks could leave a
long's range, they are summed up as whole numbers of any size and then put to the nearest
long, so nothing wraps around.

Defined cases: vectors that are null, hold a null or a non-finite component, or have a null
id take no part; weights beyond a long are the nearest long; vectors of different lengths
are compared over the terms both hold; an empty vector scores 0; a row is never its own
candidate, but other rows of its id are; repeated query rows are queries each, repeated
candidates candidates each; ties go to the smaller id; empty tables give no rows; columns
other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import filesystem, new_path, partitions, remove, replace_file, written

BLOCK = 4096
QUERY_BLOCK = 4096
TILE = 16
#: Posting lists of at least this part of a block's rows are laid out over all of them.
DENSE = 8


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding) to (vec_id, w array<long>, row), w = floor(scale * x); unfit rows go.

    ``row`` tells rows apart; the table is written, so that it stays as it is.
    """
    w = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)))
    fit = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  nan is above all numbers
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fit)
    return written(rows.where(ok).select("vec_id", w.cast("array<long>").alias("w"), F.monotonically_increasing_id().alias("row")), "vectors")


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    for kind in (np.int16, np.int32):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _path(base: str, side: str, block: int) -> str:
    return f"{base}/{side}-{block:08d}.z"


def _postings(folder: str, side: str):
    """Writes one block as an inverted index: postings of all terms, in the order of terms."""

    def run(key, pdf):
        import io

        import pandas as pd
        import zstandard

        pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
        lengths = pdf["w"].str.len().to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["w"]])
        row = np.repeat(np.arange(len(pdf)), lengths)
        term = np.concatenate([np.arange(n) for n in lengths])
        held = flat != 0
        order = np.argsort(term[held], kind="stable")
        ends = np.cumsum(np.bincount(term[held])) if held.any() else np.zeros(0, np.int64)
        parts = {"ids": pdf["vec_id"].to_numpy(np.int64), "own": pdf["row"].to_numpy(np.int64), "ends": ends, "rows": _narrow(row[held][order]), "weights": _narrow(flat[held][order])}
        raw = io.BytesIO()
        np.savez(raw, **parts)
        fs, base = filesystem(folder)
        replace_file(fs, _path(base, side, int(key[0])), lambda out: out.write(zstandard.ZstdCompressor(level=1).compress(raw.getvalue())))
        return pd.DataFrame({"block": [int(key[0])], "n": [len(pdf)]})

    return run


def _load(fs, path: str):
    """A block's parts, or None: a hash may leave a block without rows."""
    import io

    import zstandard
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type == FileType.NotFound:
        return None
    with fs.open_input_stream(path, compression=None) as f, np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(f.read()))) as z:
        return tuple(z[p] for p in ("ids", "own", "ends", "rows", "weights"))


def index(rows: DataFrame, block: int, folder: str, side: str) -> int:
    """Writes blocks of about ``block`` rows each to the folder; how many there are."""
    n = rows.count()
    blocks = -(-n // block)
    cut = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks))).cast("int"))
    done = cut.groupBy("block").applyInPandas(_postings(folder, side), "block int, n long").agg(F.sum("n")).first()[0] or 0
    if done != n:
        raise RuntimeError(f"{done} of {n} rows are in blocks")
    return blocks


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids; ``ids`` ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > least)
        at = np.concatenate([at, np.flatnonzero(scores == least)[: k - len(at)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))]  # ~x falls as x grows and cannot overflow


def _greatest(weights: np.ndarray) -> int:
    return max(int(weights.max()), -int(weights.min())) if len(weights) else 0


def _scores(queries: list, postings: list, n: int, kind) -> np.ndarray:
    """Scores of a tile's queries with a block's n rows, term by term.

    queries: (term, rows of the tile, weights); postings: by term, rows (None: all) and weights.
    """
    scores = np.zeros((TILE, n), kind)
    part = np.empty((TILE, n), kind)
    for t, at, w in queries:
        if t >= len(postings):
            break
        rows, weights = postings[t]
        w = w[:, None]
        if rows is None and len(at) == TILE:
            np.multiply(w, weights, out=part)
            scores += part
        elif rows is None:
            scores[at] += w * weights
        elif len(rows):
            scores[at[:, None], rows] += w * weights
    return scores


def _tiles(q) -> list:
    """The postings of a query block by tiles of TILE queries: (term, rows of the tile, weights), by term."""
    ids, _, ends, rows, weights = q
    terms, tile = np.searchsorted(ends, np.arange(len(rows)), side="right"), rows // TILE
    out: list = [[] for _ in range(-(-len(ids) // TILE))]
    order = np.lexsort((rows, terms, tile))
    heads = np.flatnonzero((np.diff(terms[order], prepend=-1) != 0) | (np.diff(tile[order], prepend=-1) != 0))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
        at = order[a:b]
        own, w = rows[at] % TILE, weights[at]
        if len(at) * DENSE >= TILE:
            full = np.zeros(TILE, w.dtype)
            full[own] = w
            own, w = np.arange(TILE), full
        out[int(tile[at[0]])].append((int(terms[at[0]]), own, w))
    return out


def _meet(folder: str, blocks: int, parts: int, k: int):
    """Tasks: query block and part of the candidate blocks, by one number."""

    def run(frames):
        import pandas as pd

        fs, base = filesystem(folder)
        for number in (int(i) for pdf in frames for i in pdf["id"]):
            if (q := _load(fs, _path(base, "queries", number // parts))) is None:
                continue
            q_ids, q_own, _, _, q_weights = q
            tiles = _tiles(q)
            found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)  # scores and ids, best first
            least = np.full(len(tiles) * TILE, -(1 << 63), np.int64)  # the score to reach
            for block in range(number % parts, blocks, parts):
                if (c := _load(fs, _path(base, "rows", block))) is None:
                    continue
                ids, own, ends, rows, weights = c
                n = len(ids)
                top = _greatest(weights) * _greatest(q_weights) * max(len(ends), 1)
                kind = np.int32 if top < 1 << 31 else np.int64 if top < 1 << 63 else object
                postings = []
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    at, w = rows[a:b], weights[a:b].astype(kind)
                    if (b - a) * DENSE >= n:
                        full = np.zeros(n, kind)
                        full[at] = w
                        at, w = None, full
                    postings.append((at, w))
                by_own = np.argsort(own)
                place = np.minimum(np.searchsorted(own[by_own], q_own), n - 1)
                itself = np.where(own[by_own[place]] == q_own, by_own[place], -1)
                for i, tile in enumerate(tiles):
                    scores = _scores([(t, at, w.astype(kind)) for t, at, w in tile], postings, n, kind)
                    if kind is object:
                        scores = np.array([[min(max(x, -(1 << 63)), (1 << 63) - 1) for x in row] for row in scores], np.int64)
                    bounds = np.iinfo(scores.dtype)
                    first, last = i * TILE, min(len(q_ids), (i + 1) * TILE)
                    hit = scores >= np.clip(least[first : first + TILE], bounds.min, bounds.max).astype(scores.dtype)[:, None]
                    mine = itself[first:last]
                    hit[np.flatnonzero(mine >= 0), mine[mine >= 0]] = False
                    for r in np.flatnonzero(hit[: last - first].any(axis=1)).tolist():
                        at = np.flatnonzero(hit[r])
                        at = at[best(scores[r, at], ids[at], k)]
                        s, d = (np.concatenate(x) for x in zip(found[first + r], (scores[r, at].astype(np.int64), ids[at])))
                        order = np.lexsort((d, ~s))[:k]  # ~s falls as s grows and cannot overflow
                        found[first + r] = s[order], d[order]
                        if len(order) == k:
                            least[first + r] = s[order[-1]]
            n = [len(s) for s, _ in found]
            yield pd.DataFrame({"query_id": np.repeat(q_ids, n), "query_row": np.repeat(q_own, n), "vec_id": np.concatenate([d for _, d in found]), "score": np.concatenate([s for s, _ in found])})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, w, row) rows against (vec_id, w, row) rows: query_id, rank from 1, vec_id, score."""
    spark = queries.sparkSession
    folder = new_path(spark, "topk")
    q_blocks, blocks = index(queries, QUERY_BLOCK, folder, "queries"), index(candidates, BLOCK, folder, "rows")
    parts = max(1, min(blocks, -(-2 * partitions(spark) // max(1, q_blocks))))
    tasks = q_blocks * parts
    met = spark.range(0, tasks, 1, max(1, tasks)).mapInPandas(_meet(folder, blocks, parts, k), "query_id long, query_row long, vec_id long, score long")
    found = written(met, "topk-found")
    remove(spark, folder)
    rank = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
