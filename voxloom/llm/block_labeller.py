"""Main-text extraction by a recurrent block labeller.

A page is read as the sequence of its leaf blocks. Each block is a vector: hashed elements
and names of its tag path, its innermost element, all its words (hashed), and its shape. A
bidirectional LSTM, in numpy, reads the sequence, so every block is labelled in the context
of the whole page. The labeller is trained on ``TRAIN`` labelled pages made by rule
(:mod:`html_pages`) with a fixed seed, so it is the same in every run.

Defined cases: null or empty html gives an empty text; pages of any length are read whole,
with memory in proportion to the blocks; null ids and urls stay null; an empty table gives
no rows; repeated rows get equal results; columns other than page_id, url and html are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import Block, blocks
from .html_pages import labelled

PATH, LEAF, WORDS, SHAPE = 256, 64, 512, 6
DIM = PATH + LEAF + WORDS + SHAPE
HIDDEN = 16
TRAIN, EPOCHS, BATCH = 1000, 9, 25


@lru_cache(1 << 16)
def _hash(s: str, n: int) -> int:
    return zlib.crc32(s.encode()) % n


@lru_cache(1 << 14)
def _path(path: tuple[str, ...]) -> tuple[np.ndarray, int]:
    parts = [x for e in path for x in e.split()]
    return np.unique([_hash(x, PATH) for x in parts]).astype(np.int64), _hash(path[-1] if path else "", LEAF)


def shapes(page: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    total = total or len(page)
    return np.array([(np.log1p(n := len(b.text)) / 6, b.linked / n, min(2.0, b.text.count(".") / (1 + n / 60)), b.text[-1] in ".!?:", (first + i) / total, 1) for i, b in enumerate(page)], np.float32).reshape(-1, SHAPE)


def word_places(b: Block) -> list[int]:
    """Of a whole block of any length, its hashed words."""
    return sorted({_hash(w, WORDS) for w in b.text.lower().split()})


def features(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), DIM), np.float32)
    for i, b in enumerate(page):
        at, leaf = _path(b.path)
        x[i, at] = 1
        x[i, PATH + leaf] = 1
        if places := word_places(b):
            x[i, PATH + LEAF + np.array(places)] = 1 / len(places)
    x[:, -SHAPE:] = shapes(page)
    return x


class Lstm:
    """One direction. The gates are input, forget, output and cell, in this order."""

    def __init__(self, rng, n_in: int, h: int):
        self.wx = (rng.standard_normal((n_in, 4 * h)) / np.sqrt(40)).astype(np.float32)
        self.wh = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
        self.b = np.zeros(4 * h, np.float32)
        self.b[h : 2 * h] = 1

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates: (time, batch, 4h), the projected inputs; mask: (time, batch, 1)."""
        T, B, h4 = gates.shape
        h = h4 // 4
        H, C = np.zeros((T + 1, B, h), np.float32), np.zeros((T + 1, B, h), np.float32)
        acts = np.empty((T, B, h4), np.float32) if keep else None
        for t in range(T):
            z = gates[t] + H[t] @ self.wh
            z[:, : 3 * h] = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            c = z[:, h : 2 * h] * C[t] + z[:, :h] * z[:, 3 * h :]
            C[t + 1] = np.where(mask[t], c, C[t])
            H[t + 1] = np.where(mask[t], z[:, 2 * h : 3 * h] * np.tanh(c), H[t])
            if keep:
                acts[t] = z
        return H, C, acts

    def backward(self, dH: np.ndarray, H, C, acts, mask):
        """dH: (time, batch, h), the loss by every output; the gradients by gates and wh."""
        T, B, h = dH.shape
        dz = np.zeros((T, B, 4 * h), np.float32)
        dh, dc = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
        for t in range(T - 1, -1, -1):
            m = mask[t]
            i, f, o, g = (acts[t][:, k * h : (k + 1) * h] for k in range(4))
            total = (dh + dH[t]) * m
            tc = np.tanh(C[t + 1])
            d = dc * m + total * o * (1 - tc * tc)
            dz[t] = np.concatenate([d * g * i * (1 - i), d * C[t] * f * (1 - f), total * tc * o * (1 - o), d * i * (1 - g * g)], axis=1) * m
            dh = np.where(m, dz[t] @ self.wh.T, dh + dH[t])
            dc = np.where(m, d * f, dc)
        dwh = np.einsum("tbh,tbk->hk", H[:-1], dz)
        return dz, dwh


class Labeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.f, self.r = Lstm(rng, DIM, HIDDEN), Lstm(rng, DIM, HIDDEN)
        self.wo = (rng.standard_normal((2 * HIDDEN, 1)) / 4).astype(np.float32)
        self.bo = np.zeros(1, np.float32)
        self.paths: dict = {}

    def parameters(self):
        return [self.f.wx, self.f.wh, self.f.b, self.r.wx, self.r.wh, self.r.b, self.wo, self.bo]

    def train(self, pages: list, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 5) -> "Labeller":
        rng = np.random.default_rng(seed)
        xs, ys = [features([b for b, _ in p]) for p in pages], [np.array([y for _, y in p], np.float32) for p in pages]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = np.argsort([len(x) + rng.random() * 6 for x in xs])
            groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
            for k in rng.permutation(len(groups)):
                for d in (self.f, self.r):
                    d.wx[PATH + LEAF : DIM - SHAPE] *= 0.99
                own = groups[k]
                T, B = max(len(xs[i]) for i in own), len(own)
                x, y, mask = np.zeros((T, B, DIM), np.float32), np.zeros((T, B, 1), np.float32), np.zeros((T, B, 1), bool)
                for j, i in enumerate(own):
                    x[: len(xs[i]), j], y[: len(xs[i]), j, 0], mask[: len(xs[i]), j] = xs[i], ys[i], True
                # names and words are dropped at random, so that context has to help
                x[..., : PATH + LEAF] *= rng.random(x[..., : PATH + LEAF].shape, np.float32) > 0.02
                x[..., PATH + LEAF : DIM - SHAPE] *= rng.random((T, B, 1), np.float32) > 0.5
                Hf, Cf, af = self.f.forward(x @ self.f.wx + self.f.b, mask, True)
                xr, mr = x[::-1], mask[::-1]
                Hr, Cr, ar = self.r.forward(xr @ self.r.wx + self.r.b, mr, True)
                both = np.concatenate([Hf[1:], Hr[1:][::-1]], axis=2)
                p = 1 / (1 + np.exp(-np.clip(both @ self.wo + self.bo, -30, 30)))
                d = (p - y) * mask / mask.sum()
                dboth = d @ self.wo.T
                dzf, dwhf = self.f.backward(dboth[..., :HIDDEN], Hf, Cf, af, mask)
                dzr, dwhr = self.r.backward(dboth[..., HIDDEN:][::-1], Hr, Cr, ar, mr)
                flat = lambda a: a.reshape(-1, a.shape[-1])
                grads = [flat(x).T @ flat(dzf), dwhf, flat(dzf).sum(0), flat(xr).T @ flat(dzr), dwhr, flat(dzr).sum(0), flat(both).T @ flat(d), flat(d).sum(0)]
                step += 1
                now = rate * (1 - epoch / epochs)
                for w, g, (m, v) in zip(self.parameters(), grads, moments):  # Adam
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self

    def project(self, page: list[Block]) -> list[np.ndarray]:
        """``features(page) @ wx + b`` for both directions, without the mostly empty features."""
        paths = []
        for b in page:
            if (g := self.paths.get(b.path)) is None:
                at, leaf = _path(b.path)
                g = np.array([d.wx[at].sum(0) + d.wx[PATH + leaf] + d.b for d in (self.f, self.r)])
                if len(self.paths) < 1 << 14:
                    self.paths[b.path] = g
            paths.append(g)
        rows, words = np.array(paths), [word_places(b) for b in page]
        of = np.repeat(np.arange(len(page)), [len(w) for w in words])
        flat = PATH + LEAF + np.array([w for ws in words for w in ws], np.int64)
        shape = shapes(page)
        out = []
        for k, d in enumerate((self.f, self.r)):
            g = rows[:, k] + shape @ d.wx[-SHAPE:]
            if len(flat):
                heads = np.flatnonzero(np.diff(of, prepend=-1))
                g[of[heads]] += np.add.reduceat(d.wx[flat], heads, axis=0) / np.diff([*heads, len(flat)])[:, None]
            out.append(g)
        return out

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of each page, whether each block is of the article."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end, T = at, 0
            while end < len(order) and (end == at or (end - at + 1) * len(pages[order[end]]) <= 1 << 14):
                T = len(pages[order[end]])
                end += 1
            own = order[at:end]
            gates = [np.zeros((T, len(own), 4 * HIDDEN), np.float32) for _ in range(2)]
            mask = np.zeros((T, len(own), 1), bool)
            for j, i in enumerate(own):
                for g, rows in zip(gates, self.project(pages[i])):
                    g[: len(rows), j] = rows
                mask[: len(pages[i]), j] = True
            Hf = self.f.forward(gates[0], mask)[0][1:]
            Hr = self.r.forward(gates[1][::-1], mask[::-1])[0][1:][::-1]
            z = Hf @ self.wo[:HIDDEN] + Hr @ self.wo[HIDDEN:] + self.bo
            for j, i in enumerate(own):
                out[i] = z[: len(pages[i]), j, 0] > 0
            at = end
        return out


_trained: list[Labeller] = []


def trained(spark: SparkSession | None = None) -> Labeller:
    """The labeller, trained once in a process; with a session, in one task of it."""
    if not _trained:
        own = Labeller()
        if spark is None:
            own.train(labelled(TRAIN))
        else:

            def run(_):
                import pandas as pd

                yield pd.DataFrame({"w": [p.tobytes() for p in Labeller().train(labelled(TRAIN)).parameters()]})

            one = spark.range(0, 1, 1, 1).mapInPandas(run, "w binary")
            for p, r in zip(own.parameters(), one.collect()):
                p[...] = np.frombuffer(r["w"], np.float32).reshape(p.shape)
        _trained.append(own)
    return _trained[0]


def main_texts(htmls: list, labeller: Labeller) -> list[str]:
    pages = [blocks(h) if h else [] for h in htmls]
    return ["\n".join(b.text for b, k in zip(p, keep) if k) for p, keep in zip(pages, labeller.labels(pages))]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page_id, url, text, n_chars."""
    labeller = trained(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = main_texts(part.column("html").to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
