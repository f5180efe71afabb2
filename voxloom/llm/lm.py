"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token of a text from ``WINDOW`` tokens on
either side of it; the sum of the conditional log-probabilities scores the text. Tokens are
words. The vocabulary has a place for each of the most frequent words of the whole corpus,
and it grows with the corpus: with the fourth root of the count of tokens, ``KNOWN`` words at
least. Other words fall into classes by a hash of their last ``SUFFIX`` bytes, a third as
many, so every token is predicted and a rare word still tells its language and form.

The network embeds the 2 * ``WINDOW`` neighbours, joins them in one hidden layer and
predicts in two steps, the class of the word and the word within its class; there are as many
classes as words in one, so a token costs two short softmaxes.

Every text is encoded once; ids are kept in a table in the shared folder. Training covers
every position of every document: it starts with the first ``WARM`` tokens of one shard, in
one task, then every shard goes on from there over its own tokens, and the results are
averaged, weighted by tokens, in two levels. Shards are made by a hash of (doc_id, text) and
read in the order of that hash, and their count comes from the count of tokens, so the model
does not depend on how the input is partitioned, but for the rounding of sums. Steps are
Adagrad's. One set of weights, which grows with the vocabulary, comes to the driver twice.

Defined cases: null and empty texts have no tokens, log-probability 0 and a null mean; texts
of any length are read whole, windows are made in pieces of ``PIECE`` tokens (a text's ids
take two to eight bytes a token); an empty corpus trains nothing and scores nothing;
repeated rows get results that are equal up to the rounding of single floats; columns of any
name pass through :func:`score`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, drop_written, partitions, schema_with, with_columns, written
from .minhash import eights, mixed, word_edges, word_hashes

WINDOW = 2
KNOWN = 1200
SUFFIX = 3
EMBED, HIDDEN = 8, 16
BATCH, RATE = 4096, 0.2
PIECE = 1 << 15
WARM = 1 << 20
SHARD = 1 << 20  # tokens; 16 for each weight, if these are more


def side_of(tokens: int) -> int:
    """How many classes there are, and places in each, for a corpus of so many tokens."""
    known = max(KNOWN, 11 * int(tokens**0.25))
    return -(-int(np.ceil((known * 4 / 3) ** 0.5)) // 8) * 8


_LEAST = np.float32(1e-37)


def _tally(cls: np.ndarray, side: int) -> list[int]:
    return np.searchsorted(cls, np.arange(side + 1)).tolist()


@dataclass
class Net:
    """Weights, and Adagrad's sums of squares of each."""

    side: int
    weights: list[np.ndarray]
    squares: list[np.ndarray]
    room: dict = field(default_factory=dict)

    @staticmethod
    def shapes(side: int) -> list[tuple[int, ...]]:
        """Embeddings; hidden layer and its bias; classes and bias; words of a class and bias."""
        return [(side * side, EMBED), (2 * WINDOW * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, side), (side,), (side, HIDDEN, side), (side, side)]

    @staticmethod
    def new(side: int, seed: int = 7) -> "Net":
        r = np.random.default_rng(seed)
        scales = [0.3, (2 * WINDOW * EMBED) ** -0.5, 0, 0.05, 0, 0.05, 0]
        shapes = Net.shapes(side)
        return Net(side, [(r.standard_normal(s) * k).astype(np.float32) for s, k in zip(shapes, scales)], [np.full(s, 1e-6, np.float32) for s in shapes])

    def start_at(self, tokens: np.ndarray) -> None:
        """The biases of word frequencies."""
        n = (np.bincount(tokens, minlength=self.side**2) + 0.5).reshape(self.side, self.side)
        self.weights[4][:] = np.log(n.sum(1) / n.sum())
        self.weights[6][:] = np.log(n / n.sum(1, keepdims=True))

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.weights + self.squares]).tobytes()

    @staticmethod
    def unpack(raw: bytes, side: int) -> "Net":
        flat, out, at = np.frombuffer(raw, np.float32), [], 0
        for s in Net.shapes(side) * 2:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s).copy())
            at += n
        return Net(side, out[:7], out[7:])

    def _hidden(self, around: np.ndarray):
        x = self.weights[0].take(around.ravel(), axis=0).reshape(len(around), -1)
        z = x @ self.weights[1]
        z += self.weights[2]
        scale = np.abs(z)
        scale += 1
        return x, z / scale, scale  # softsign

    def _rows(self, name: str, n: int, width: int) -> np.ndarray:
        """Room for n rows, kept from batch to batch: fresh memory costs more than the sums in it."""
        held = self.room.get(name)
        if held is None or held.shape[0] < n or held.shape[1] != width:
            held = self.room[name] = np.empty((max(n, BATCH), width), np.float32)
        return held[:n]

    def _raised(self, z: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """exp(z) in place, of logits z made of activations under one, w and b; rows are lowered first if they could overflow."""
        if float(np.abs(w).sum(axis=-2).max() + np.abs(b).max()) > 80:
            z -= z.max(axis=1, keepdims=True)
        return np.exp(z, out=z)

    def _classes(self, h: np.ndarray) -> np.ndarray:
        z = np.matmul(h, self.weights[3], out=self._rows("classes", len(h), self.side))
        z += self.weights[4]
        return self._raised(z, self.weights[3], self.weights[4])

    def _members(self, h: np.ndarray, cuts: list[int]) -> np.ndarray:
        z = self._rows("members", len(h), self.side)
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                np.matmul(h[a:b], self.weights[5][c], out=z[a:b])
                z[a:b] += self.weights[6][c]
        return self._raised(z, self.weights[5], self.weights[6])

    def _sorted(self, around: np.ndarray, token: np.ndarray):
        cls, member = np.divmod(token, self.side)
        cls = cls.astype(np.uint8 if self.side <= 256 else np.uint16)  # small types sort fast
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        return order, cls, member[order], around.take(order, axis=0), _tally(cls, self.side)

    def log_probs(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The log-probability of each token given its neighbours."""
        out, ones = np.empty(len(token)), np.ones(self.side, np.float32)
        for first in range(0, len(token), BATCH):
            order, cls, member, near, cuts = self._sorted(around[first : first + BATCH], token[first : first + BATCH])
            n, (_, h, _) = np.arange(len(order)), self._hidden(near)
            z = self._classes(h)
            p = z[n, cls] / (z @ ones)
            z = self._members(h, cuts)
            out[first + order] = np.log(np.maximum(p, _LEAST)) + np.log(np.maximum(z[n, member] / (z @ ones), _LEAST))
        return out

    def step(self, around: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One step of descent over a batch. Softmax rows are kept unscaled; what they meet is scaled instead."""
        emb, w1, _, wc, _, wm, _ = self.weights
        n, ones = np.arange(len(token)), np.ones(self.side, np.float32)
        _, cls, member, around, cuts = self._sorted(around, token)
        x, h, scale = self._hidden(around)

        z = self._classes(h)
        total = z @ ones
        z[n, cls] -= total
        one = (1 / total)[:, None]
        g_wc, g_bc = (h * one).T @ z, one[:, 0] @ z
        dh = z @ wc.T
        dh *= one

        z = self._members(h, cuts)
        total = z @ ones
        z[n, member] -= total
        one = (1 / total)[:, None]
        scaled, back = np.concatenate([h * one, one], axis=1), self._rows("back", len(h), HIDDEN)
        g = self._rows("g", self.side * (HIDDEN + 1), self.side).reshape(self.side, HIDDEN + 1, self.side)
        for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                np.matmul(z[a:b], wm[c].T, out=back[a:b])
                np.matmul(scaled[a:b].T, z[a:b], out=g[c])
            else:
                g[c] = 0
        back *= one
        dh += back

        dh /= scale
        dh /= scale
        dx = (dh @ w1.T).reshape(-1, EMBED)
        flat = around.ravel()
        flat = flat.astype(np.uint16) if self.side <= 256 else flat
        by = np.argsort(flat, kind="stable")
        ordered = flat[by]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        g_emb = np.add.reduceat(dx.take(by, axis=0), heads, axis=0)
        at = ordered[heads]
        squares = self.squares[0][at] + g_emb * g_emb
        self.squares[0][at] = squares
        emb[at] -= np.float32(rate) * g_emb / np.sqrt(squares)
        for w, s, d in zip(self.weights[1:], self.squares[1:], (x.T @ dh, dh.sum(0), g_wc, g_bc, g[:, :HIDDEN], g[:, HIDDEN])):
            s += d * d
            w -= np.float32(rate) * d / np.sqrt(s)


@dataclass(frozen=True)
class Words:
    """The known words' hashes, sorted, and the token of each."""

    hashes: np.ndarray
    tokens: np.ndarray
    side: int

    @property
    def kind(self) -> str:
        return "<u2" if self.side**2 <= 1 << 16 else "<u4"

    def of(self, raw: np.ndarray) -> np.ndarray:
        """The place of every word of the bytes. Class is the remainder of a token's number, so classes are of like weight."""
        return self.at(raw)[0]

    def at(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places, and where the words start."""
        starts, ends = edges = word_edges(raw)
        wide = eights(raw)
        h, _ = word_hashes(raw, edges=edges, wide=wide)
        known, size = self.side**2 * 3 // 4, np.minimum(ends - starts, SUFFIX)
        tail = wide[ends - size] & np.array([(1 << 8 * n) - 1 for n in range(SUFFIX + 1)], np.uint64)[size]
        token = known + (mixed(tail) % np.uint64(self.side**2 - 1 - known)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            token = np.where(self.hashes[at] == h, self.tokens[at], token)
        member, cls = np.divmod(token, self.side)
        return (cls * self.side + member).astype(self.kind), starts

    def texts(self, rows: list) -> list[np.ndarray]:
        """The places of the words of each text, given as bytes or None."""
        out = []
        for part, buf, cuts in together(rows):
            ids, starts = self.at(buf)
            ends = np.searchsorted(starts, cuts)
            out += [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return out


_SPACE = np.full(1, 32, np.uint8)


def together(rows: list, size: int = 1 << 19):
    """Texts in runs of about ``size`` bytes, as one buffer with a space between: rows, buffer, where each starts, and its end."""
    at = 0
    while at < len(rows):
        end, n = at, 0
        while end < len(rows) and (end == at or n < size):
            n += 1 + (len(rows[end]) if rows[end] is not None else 0)
            end += 1
        part = rows[at:end]
        sizes = np.array([1 + (len(r) if r is not None else 0) for r in part])
        yield part, np.concatenate([p for r in part for p in ((r, _SPACE) if r is not None else (_SPACE,))]), np.concatenate([[0], np.cumsum(sizes)])
        at = end


def vocabulary(docs: DataFrame) -> Words:
    """The most frequent words of all texts, ties to the smaller hash."""

    def count(batches):
        import pyarrow as pa

        held, weights, n = [], [], 0

        def merged():
            h, back = np.unique(np.concatenate(held), return_inverse=True)
            return h, np.bincount(back, np.concatenate(weights)).astype(np.int64)

        for b in batches:
            for _, buf, _ in together(byte_rows(b.column("text"))):
                h, c = np.unique(word_hashes(buf)[0], return_counts=True)
                held.append(h)
                weights.append(c)
                n += len(h)
                if n > 1 << 20:
                    h, c = merged()
                    held, weights, n = [h], [c], 0
                    if len(h) > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["word", "n"])
                        held, weights = [], []
        if held:
            h, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["word", "n"])

    counts = written(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    side = side_of(counts.agg(F.sum("n")).first()[0] or 0)
    top = counts.orderBy(F.desc("n"), "word").limit(side**2 * 3 // 4).collect()
    drop_written(counts)
    h = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Words(h[order], np.arange(len(h))[order], side)


def encoded(docs: DataFrame, words: Words) -> DataFrame:
    """(doc_id, text) to doc_id, h (of id and text), n, ids; written."""
    known = docs.sparkSession.sparkContext.broadcast(words)  # grows with the fourth root of the corpus

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = known.value.texts(byte_rows(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "h", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h"))
    return written(rows.mapInArrow(run, "doc_id long, h long, n long, ids binary"), "lm-ids")


def windows(rows, edge: int):
    """(number, ids) rows to pieces of about PIECE tokens: neighbours, tokens and numbers.

    Tokens of different rows do not meet: ``edge`` stands outside every text.
    """
    held, size = [], 0

    def piece():
        sizes = np.array([len(o) for _, _, o, _ in held])
        flat = np.concatenate([p for _, *parts in held for p in parts]).astype(np.int32)
        at = np.arange(sizes.sum()) + np.repeat(WINDOW * (2 * np.arange(len(held)) + 1), sizes)
        around = np.stack([flat[at + k] for k in range(-WINDOW, WINDOW + 1) if k], axis=1)
        return around, flat[at], np.repeat([i for i, *_ in held], sizes)

    out = np.full(WINDOW, edge)
    for i, ids in rows:
        for a in range(0, len(ids), PIECE):
            own = ids[a : a + PIECE]
            left, right = ids[max(0, a - WINDOW) : a], ids[a + PIECE : a + PIECE + WINDOW]
            held.append((i, np.concatenate([out[len(left) :], left]), own, np.concatenate([right, out[len(right) :]])))
            size += len(own)
            if size >= PIECE:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def _learn(net: Net, rows) -> int:
    """Steps over all positions of the rows, in pieces whose order is drawn; how many tokens."""
    total = 0
    for around, token, _ in windows(rows, net.side**2 - 1):
        order = np.random.default_rng(len(token)).permutation(len(token))
        around, token = around[order], token[order]
        for at in range(0, len(token), BATCH):
            net.step(around[at : at + BATCH], token[at : at + BATCH], RATE)
        total += len(token)
    return total


def _ids(batches, kind: str):
    for b in batches:
        for s, raw in zip(b.column("shard").to_pylist(), byte_rows(b.column("ids"))):
            yield s, raw.view(kind)


def train(ids: DataFrame, words: Words, warm: int = WARM) -> Net:
    """A network over all rows of :func:`encoded`."""
    spark, side, kind = ids.sparkSession, words.side, words.kind
    net = Net.new(side)
    weights = sum(p.size for p in net.weights)
    tokens = ids.agg(F.sum("n")).first()[0]
    if not tokens:
        return net
    shards = -(-tokens // max(SHARD, 16 * weights))
    cut = ids.where("n > 0").select(F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(shards)).cast("int").alias("shard"), "h", "ids")

    def first(batches):
        import pyarrow as pa

        own, rows, n = Net.new(side), [], 0
        for _, x in _ids(batches, kind):
            if n < warm:
                rows.append((0, x[: warm - n]))
                n += len(x)
        if rows:
            own.start_at(np.concatenate([x for _, x in rows]))
            _learn(own, rows)
        yield pa.RecordBatch.from_arrays([pa.array([own.pack()])], ["weights"])

    head = cut.where("shard = 0").coalesce(1).sortWithinPartitions("h", "ids").mapInArrow(first, "weights binary").first()
    start = spark.sparkContext.broadcast(head["weights"] if head else net.pack())

    def local(batches):
        import pyarrow as pa
        from itertools import groupby

        total, sums = 0, None
        for _, rows in groupby(_ids(batches, kind), lambda r: r[0]):
            own = Net.unpack(start.value, side)
            n = _learn(own, ((0, x) for _, x in rows))
            w = np.frombuffer(own.pack(), np.float32) * np.float64(n)
            total, sums = total + n, w if sums is None else sums + w
        if total:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total]), pa.array([(sums / total).astype(np.float32).tobytes()])], ["part", "n", "weights"])

    def average(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        n = pdf["n"].to_numpy(np.float64)
        w = sum(k * np.frombuffer(x, np.float32) for k, x in zip(n / n.sum(), pdf["weights"]))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n": [int(n.sum())], "weights": [w.astype(np.float32).tobytes()]})

    parts, schema = partitions(spark), "part int, n long, weights binary"
    nets = cut.repartition(parts, "shard").sortWithinPartitions("shard", "h", "ids").mapInArrow(local, schema)
    some = nets.groupBy((F.col("part") % max(1, int(parts**0.5))).alias("g")).applyInPandas(average, schema)
    last = some.groupBy(F.lit(0).alias("g")).applyInPandas(average, schema).first()
    return Net.unpack(last["weights"], side)


RESULTS = ["n_tokens", "log_prob", "mean_log_prob"]


def _scores(net: Net, rows: list) -> list:
    """Arrow arrays of the counts, sums and means of rows of ids."""
    import pyarrow as pa

    n, total = np.array([len(x) for x in rows], np.int64), np.zeros(len(rows))
    for around, token, of in windows(enumerate(rows), net.side**2 - 1):
        total += np.bincount(of, net.log_probs(around, token), len(rows))
    return [pa.array(n), pa.array(total), pa.array([float(s / k) if k else None for s, k in zip(total, n)], pa.float64())]


def score_encoded(ids: DataFrame, words: Words, net: Net) -> DataFrame:
    """Rows of :func:`encoded` to doc_id, n_tokens, log_prob (the sum) and mean_log_prob."""
    raw_net = ids.sparkSession.sparkContext.broadcast(net.pack())  # grows with the vocabulary
    side, kind = words.side, words.kind

    def run(batches):
        import pyarrow as pa

        own = Net.unpack(raw_net.value, side)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_scores(own, [x.view(kind) for x in byte_rows(b.column("ids"))])], ["doc_id", *RESULTS])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def score(docs: DataFrame, words: Words, net: Net) -> DataFrame:
    """``docs`` with n_tokens, log_prob and mean_log_prob; only ``text`` is read for them."""
    schema = schema_with(docs, n_tokens="long", log_prob="double", mean_log_prob="double")
    raw = docs.sparkSession.sparkContext.broadcast((words, net.pack()))

    def run(batches):
        words, packed = raw.value
        own = Net.unpack(packed, words.side)
        for b in batches:
            yield with_columns(b, RESULTS, _scores(own, words.texts(byte_rows(b.column("text")))))

    return docs.mapInArrow(run, schema)
