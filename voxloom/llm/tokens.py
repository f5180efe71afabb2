"""Training-order materialisation of token ids in fixed-stride shards.

Every text becomes token ids plus one end mark, cut into sequences of ``stride`` ids, the
last one padded. Sequences are numbered 0 to N-1 in the order of (doc_id, hash of the text,
place in the text), and a keyed Feistel permutation with cycle-walking gives each number a
global slot in 0 to N-1: the order of training, without sorting by random numbers, and the
same however the input is partitioned. Slots are cut in ranges of ``per_shard``; each range
is written as one shard of ``per_shard`` records of ``stride`` ids, so a reader finds slot s
at record ``s % per_shard`` of shard ``s // per_shard`` and can resume anywhere. Ids take
two bytes, four where the vocabulary needs them; ``shards.json`` beside the shards says so.

Texts are tokenised once; packed ids (:func:`pack`) are kept in a table in the shared folder. The
numbers are found over (doc_id, hash, count) alone: rows are put in order by ranges, each
range is summed up, and the numbers of a task's documents go back to it as one small file,
so token ids move once, to their shards. A task packs what it has for a shard before the
shuffle; a shard is assembled in one task, whose memory is bounded by ``per_shard``. Shards
are renamed into place when whole, so tasks may run again. :func:`shards` returns when all
shards are written.

Runs of white space of ``LONG`` characters or more are encoded apart, as one piece less
their last character, which is how the split before the merges cuts them; so texts of any
length and make are encoded as a whole would be.

Defined cases: null and empty texts give no sequences; rows without an id come first;
repeated rows give sequences each, texts that share an id follow each other; an empty
table gives no shards; the last shard may be shorter; a very long text is tokenised and cut
in one task, about 30 bytes of memory a token; columns other than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, filesystem, new_path, partitions, qualified, remove, replace_file, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split before the merges of the rank files, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 1 << 14
STRIDE, PER_SHARD, KEY = 256, 1 << 16, 9
FRAME = 1 << 20
#: Codes of one byte, and of one or two bytes; see :func:`pack`.
ONE = 192
TWO = ONE + 56 * 256
THREE = TWO + 8 * 65536
_RUNS = re.compile(f"[{WHITE}]{{{LONG},}}")

_encoders: dict = {}


class Encoder:
    """A tokenizer of a rank file's content. ``end`` is the id after the last rank."""

    def __init__(self, raw: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.end = max(ranks.values()) + 1
        self.split = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    @property
    def kind(self) -> str:
        return kind_of(self.end)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text and the end mark."""
        out: list[int] = []
        at = 0
        for m in _RUNS.finditer(text) if len(text) >= LONG else ():
            stop = m.end() if m.end() == len(text) else m.end() - 1
            out += self.split.encode_ordinary(text[at : m.start()])
            out += self.whole.encode_ordinary(text[m.start() : stop])
            at = stop
        out += self.split.encode_ordinary(text[at:] if at else text)
        out.append(self.end)
        return np.array(out, self.kind)


def kind_of(end: int) -> str:
    """The type of ids whose largest is ``end``; the type's own largest value pads."""
    return "<u2" if end < 0xFFFF else "<u4"


def pad_of(kind: str) -> int:
    return int(np.iinfo(kind).max)


def pack(ids: np.ndarray, z) -> bytes:
    """Ids as their ranks by frequency, the most frequent in one byte, others in two or three,
    then compressed: a fifth smaller than the compressed ids. First bytes, second ones and the rest
    are apart. Ids of more than THREE kinds stay as they are."""
    counts = np.bincount(ids)
    known = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    if len(known) > THREE:
        return z.compress(np.array([len(ids), -1], "<i8").tobytes() + ids.tobytes())
    rank = np.empty(len(counts), np.int32)
    rank[known] = np.arange(len(known))
    r = rank[ids]
    two, three = r[(r >= ONE) & (r < TWO)] - ONE, r[r >= TWO] - TWO
    first = np.minimum(r, ONE).astype(np.uint8)
    first[(r >= ONE) & (r < TWO)] = ONE + (two >> 8)
    first[r >= TWO] = 248 + (three >> 16)
    parts = (np.array([len(ids), len(known)], "<i8"), known.astype(ids.dtype), first, (two & 255).astype(np.uint8), (three & 0xFFFF).astype("<u2"))
    return z.compress(b"".join(x.tobytes() for x in parts))


def unpack(raw: bytes, kind: str, unz) -> np.ndarray:
    """What :func:`pack` was given."""
    raw = unz.decompress(raw)
    n, kinds = np.frombuffer(raw, "<i8", 2).tolist()
    if kinds < 0:
        return np.frombuffer(raw, kind, n, 16)
    at = 16 + kinds * np.dtype(kind).itemsize
    known, first = np.frombuffer(raw, kind, kinds, 16), np.frombuffer(raw, np.uint8, n, at)
    r = first.astype(np.int32)
    two, three = (first >= ONE) & (first < 248), first >= 248
    at, n_two = at + n, int(np.count_nonzero(two))
    r[two] = ONE + ((r[two] - ONE) << 8) + np.frombuffer(raw, np.uint8, n_two, at)
    r[three] = TWO + ((r[three] - 248) << 16) + np.frombuffer(raw, "<u2", -1, at + n_two) if three.any() else 0
    return known[r]


def encoder(raw: bytes) -> Encoder:
    """Kept for the worker's later tasks."""
    k = zlib.crc32(raw)
    if k not in _encoders:
        _encoders[k] = Encoder(raw)
    return _encoders[k]


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 to n-1, at the given places."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 62, rounds)]

    def once(x):
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (over := out >= np.uint64(n)).any():  # walk the cycle back into the range
        out[over] = once(out[over])
    return out.astype(np.int64)


def tokenised(docs: DataFrame, raw: bytes) -> DataFrame:
    """(doc_id, text) to frames of documents: task, first, docs, hashes, sizes, ids (compressed).

    ``first`` numbers the frame's first document within its task.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(raw)  # a file of fixed size, about 1 MB

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        task, first = TaskContext.get().partitionId(), 0
        z, enc = zstandard.ZstdCompressor(level=9), encoder(ranks.value)
        names = ["task", "first", "docs", "hashes", "sizes", "ids"]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def frame(own, hashes, ids):
            nonlocal first
            row = [task, first, own, hashes, [len(x) for x in ids], pack(np.concatenate(ids), z)]
            first += len(own)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        own, hashes, ids, held = [], [], [], 0
        for b in batches:
            for doc, h, text in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), b.column("text")):
                if not (text := text.as_py()):
                    continue
                own.append(doc)
                hashes.append(h)
                ids.append(enc.ids(text))
                held += len(ids[-1])
                if held > FRAME:
                    yield frame(own, hashes, ids)
                    own, hashes, ids, held = [], [], [], 0
        if own:
            yield frame(own, hashes, ids)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return docs.mapInArrow(run, "task int, first long, docs array<long>, hashes array<long>, sizes array<long>, ids binary")


def _ordered(table: DataFrame, stride: int) -> DataFrame:
    """Of every document of the token table: part (a range of documents), the sequences before it in the part, and its own."""
    each = table.select("task", "first", F.posexplode(F.arrays_zip("docs", "hashes", "sizes")).alias("i", "d"))
    each = each.select("task", (F.col("first") + F.col("i")).alias("at"), F.col("d.docs").alias("doc"), F.col("d.hashes").alias("h"), F.ceil(F.col("d.sizes") / stride).cast("long").alias("n"))

    def count(frames):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for pdf in frames:
            upto = total + pdf["n"].cumsum()
            total = int(upto.iloc[-1]) if len(pdf) else total
            yield pdf.assign(part=part, before=upto - pdf["n"])[["task", "at", "part", "before", "n"]]

    order = ["doc", "h", "task", "at"]
    return each.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(count, "task int, at long, part int, before long, n long")


def _numbers_path(base: str, task: int) -> str:
    return f"{base}/task-{task:08d}.i8"


def _send_numbers(bases: dict, folder: str):
    """Writes the numbers of a task's documents, in its order, as one file."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("at")
        numbers = pdf["before"].to_numpy() + pdf["part"].map(bases).to_numpy(np.int64)
        fs, base = filesystem(folder)
        replace_file(fs, _numbers_path(base, int(key[0])), lambda out: out.write(numbers.astype("<i8").tobytes()))
        return pd.DataFrame({"task": [int(key[0])], "docs": [len(pdf)]})

    return run


def _packed(folder: str, total: int, stride: int, per_shard: int, key: int, kind: str):
    """Frames to one row a shard for each batch: slots, documents, places and ids of its sequences."""

    def run(frames):
        import pandas as pd
        import zstandard

        z, unz = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        fs, base = filesystem(folder)
        held, size, of, numbers = [], 0, None, None

        def flush():
            slots, docs, seqs, counts, blocks = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(slots)
            shard = slots[order] // per_shard
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            rows = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                at = order[a:b]
                rows.append((int(shard[a]), *(z.compress(np.ascontiguousarray(x[at]).tobytes()) for x in (slots, docs, seqs, counts)), pack(blocks[at][np.arange(stride) < counts[at][:, None]], z)))
            return pd.DataFrame(rows, columns=["shard", "slots", "docs", "seqs", "counts", "blocks"])

        for pdf in frames:
            for f in pdf.itertuples(index=False):
                if of != f.task:
                    with fs.open_input_stream(_numbers_path(base, f.task), compression=None) as source:
                        of, numbers = f.task, np.frombuffer(source.read(), "<i8")
                sizes = np.array(f.sizes, np.int64)
                n = -(-sizes // stride)
                ids = unpack(f.ids, kind, unz)
                seqs = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                counts = np.minimum(stride, np.repeat(sizes, n) - seqs * stride)
                blocks = np.full((len(seqs), stride), pad_of(kind), kind)
                blocks[np.arange(stride) < counts[:, None]] = ids
                slots = feistel(np.repeat(numbers[f.first : f.first + len(n)], n) + seqs, total, key)
                # a null id travels as the least long
                docs = np.array([-(1 << 63) if d is None or d != d else int(d) for d in f.docs], np.int64)
                held.append((slots, np.repeat(docs, n), seqs, counts, blocks))
                size += blocks.nbytes
                if size > 1 << 24:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _write(folder: str, total: int, stride: int, per_shard: int, kind: str):
    """All parts of one shard to its file and one row a sequence."""

    def run(key, parts):
        import pandas as pd
        import zstandard

        unz = zstandard.ZstdDecompressor()
        shard = int(key[0])
        size = min(per_shard, total - shard * per_shard)
        out = np.full((size, stride), pad_of(kind), kind)
        doc, seq, count = np.zeros(size, np.int64), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        load = lambda x, t: np.frombuffer(unz.decompress(x), t)
        for slots, docs, seqs, counts, blocks in zip(parts["slots"], parts["docs"], parts["seqs"], parts["counts"], parts["blocks"]):
            at = load(slots, np.int64) - shard * per_shard
            doc[at], seq[at], count[at] = load(docs, np.int64), load(seqs, np.int64), load(counts, np.int64)
            own = np.full((len(at), stride), pad_of(kind), kind)
            own[np.arange(stride) < count[at][:, None]] = unpack(blocks, kind, unz)
            out[at] = own
        if (count < 0).any():
            raise RuntimeError(f"shard {shard} lacks sequences")
        fs, base = filesystem(folder)
        replace_file(fs, f"{base}/shard-{shard:08d}.bin", lambda f: f.write(memoryview(out).cast("B")))
        k = np.arange(size)
        ids = pd.array(doc, dtype="Int64")
        ids[doc == -(1 << 63)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "seq": seq, "slot": k + shard * per_shard, "shard": shard, "offset": k * out.itemsize * stride, "n_tokens": count, "crc32": [zlib.crc32(x) for x in out]})

    return run


def shards(docs: DataFrame, folder: str | None = None, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the shards; one row a sequence: doc_id, seq, slot, shard, offset, n_tokens, crc32 (of its record)."""
    spark: SparkSession = docs.sparkSession
    folder = qualified(spark, folder) if folder else new_path(spark, "shards")
    with open(vocabulary, "rb") as f:
        raw = f.read()
    kind = encoder(raw).kind
    table = written(tokenised(docs, raw), "token-ids")
    ordered = written(_ordered(table, stride), "token-order")
    # one number a range of documents
    per_part = ordered.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for r in per_part:
        bases[r["part"]] = total
        total += r["n"]
    numbers = new_path(spark, "token-numbers")
    sent = written(ordered.groupBy("task").applyInPandas(_send_numbers(bases, numbers), "task int, docs long"), "token-sent")
    drop_written(ordered)
    drop_written(sent)

    packed = table.mapInPandas(_packed(numbers, total, stride, per_shard, key, kind), "shard long, slots binary, docs binary, seqs binary, counts binary, blocks binary")
    # a few shards a task, so that what a task reads does not grow
    packed = packed.repartition(max(partitions(spark), -(-total // (8 * per_shard))), "shard")
    out = written(packed.groupBy("shard").applyInPandas(_write(folder, total, stride, per_shard, kind), "doc_id long, seq int, slot long, shard long, offset long, n_tokens int, crc32 long"), "token-slots")
    fs, base = filesystem(folder)
    about = {"sequences": total, "stride": stride, "per_shard": per_shard, "type": kind, "pad": pad_of(kind), "end": encoder(raw).end}
    replace_file(fs, f"{base}/shards.json", lambda f: f.write(json.dumps(about).encode()))
    drop_written(table)
    remove(spark, numbers)
    return out


def read_shard(folder: str, shard: int, first: int = 0):
    """The records of a shard from record ``first`` on, as an array of ids, padding included."""
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/shards.json", compression=None) as f:
        about = json.loads(f.read())
    kind, stride = np.dtype(about["type"]), about["stride"]
    with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
        f.seek(first * kind.itemsize * stride)
        return np.frombuffer(f.read(), kind).reshape(-1, stride)
