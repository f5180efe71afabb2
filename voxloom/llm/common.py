"""What the training-data operators share: the shared folder, written tables, words.

Intermediate tables are written as Parquet in the folder that the cluster names in
``spark.checkpoint.dir``; it must be visible to the driver and to every executor. A
written table cuts the lineage, so a lost executor costs the current stage only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one of our own only where none is set (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("voxloom.shared.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="voxloom-")
            spark.conf.set("voxloom.shared.dir", named)
    return qualified(spark, named).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as the cluster's settings complete it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/voxloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxloom_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing will read it again."""
    remove(df.sparkSession, df._voxloom_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Hadoop's names of file systems that pyarrow calls otherwise.
_ARROW = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for files that Spark's writers cannot make.

    The path must name its file system (see :func:`qualified`): what no scheme tells could
    be another disk on every executor. Schemes that pyarrow lacks raise.
    """
    from pyarrow import fs

    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"the path names no file system: {uri}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if not rest.startswith("//"):
        raise ValueError(f"the path names no host or bucket: {uri}")
    return fs.FileSystem.from_uri(f"{_ARROW.get(scheme, scheme)}:{rest}")


def replace_file(fs, path: str, fill) -> None:
    """Write a file under a temporary name, then move it to its own: tasks may run again."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        fill(out)
    fs.move(part, path)


#: A key is hot if it takes this part of all rows or more; so at most this many keys are hot.
HOT = 1000


def join_skewed(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, one row a key, whose column ``n`` counts the key's rows in ``left``.

    Rows of hot keys, of which there are ``HOT`` at most, meet a broadcast and stay where
    they are; the others are shuffled by the key. ``how`` is inner or left.
    """
    is_hot = F.col(n) * HOT >= F.lit(total)
    hot = F.broadcast(right.where(is_hot))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(~is_hot), key, how)
    return left.join(hot, key).unionByName(rest)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; all other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    """The lower-cased (A-Z) words of a whole text; a null text has none."""
    return WORD_RE.findall(text.translate(_TO_LOWER) if not text.isascii() else text.lower()) if text else []


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions a repartition by key uses: what the session sets for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_rows(column) -> list:
    """The UTF-8 bytes of each value of an Arrow string or binary column, None for null; no copies."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    rows = [raw[a:b] for a, b in zip(at, at[1:])]
    if column.null_count:
        ok = column.is_valid().to_pylist()
        rows = [r if k else None for r, k in zip(rows, ok)]
    return rows


def with_columns(batch, names: list[str], arrays: list):
    """A record batch with the named columns added, or replaced where the name is there already."""
    import pyarrow as pa

    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in names]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + arrays, [n for n, _ in kept] + names)


def schema_with(df: DataFrame, **added: str):
    """The schema of ``df`` less the names added, then those added."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [f for f in df.schema.fields if f.name not in added]
    return StructType(kept + [StructField(k, _parse_datatype_string(v), True) for k, v in added.items()])


def apart(df: DataFrame, used: list[str]):
    """``df`` with every column but the ``used`` ones under a name nobody has, and a function
    that takes a frame with those columns back to all columns of ``df`` and those named more."""
    names = {c: c if c in used else f"_own{k}_{uuid.uuid4().hex[:8]}" for k, c in enumerate(df.columns)}
    own = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return own, lambda d, *more: d.select(*(F.col(n).alias(c) for c, n in names.items()), *more)
