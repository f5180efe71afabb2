"""WARC archives: writing, normalising of whole-file gzip streams, reading by offset.

``write`` puts records in archives of one gzip stream each, as crawlers' dumps often come.
``normalise`` inflates such a stream once, rewrites every record as a gzip member of its
own and writes a sidecar index of offsets beside the archive. ``read`` seeks each record
by the index. Payloads seen before are written as revisit records.

Normalising passes bytes through in pieces of bounded size and holds one record's header;
writing and reading hold one record's payload at a time. A payload that very many pages
share is not gathered: its pages learn of the first one by a broadcast of at most ``HOT``
digests. Archives are written under a temporary name and renamed, so a task that
runs again after an executor is lost replaces its archive by an equal one. Archives live
in the shared folder.

Defined cases: a null payload is empty; an empty table gives no archives and no rows;
payloads under ``LEAST`` bytes are never revisits; rows that repeat the first page_id of a
payload are responses too; null page ids are kept, but never referred to; columns other
than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from hashlib import sha256
from typing import BinaryIO, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, filesystem, join_skewed, new_path, qualified, replace_file, written

LEAST = 100
PIECE = 1 << 16
LEVEL_STREAM, LEVEL_MEMBER = 1, 6
GZIP = 31  # zlib's window bits for gzip
#: Fixed values of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) with payload, payload_bytes, payload_digest and refers_to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    d = pages.select("page_id", "url", payload.alias("payload"))
    d = d.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    seen = d.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    out = join_skewed(d, seen, "payload_digest", "n", pages.count(), "left")
    return out.drop("n").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, without compression."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
        payload = b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + payload + b"\r\n\r\n"


def header(block: bytes) -> dict[str, str]:
    """The fields of a record's header, names in lower case; bad versions raise."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class _Stream:
    """Bytes of a gzip file, inflated once, of one member or more."""

    def __init__(self, source: BinaryIO):
        self.source, self.z, self.rest, self.more = source, zlib.decompressobj(GZIP), b"", True

    def _fill(self) -> None:
        raw = (self.z.unused_data if self.z.eof else self.z.unconsumed_tail) or self.source.read(PIECE)
        if self.z.eof:
            if not raw:
                self.more = False
                return
            self.z = zlib.decompressobj(GZIP)
        elif not raw:
            raise EOFError("the gzip stream ends early")
        self.rest += self.z.decompress(raw, 16 * PIECE)

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with the mark; empty at the end."""
        while (at := self.rest.find(mark)) < 0:
            if not self.more:
                if self.rest.strip():
                    raise EOFError("the archive ends within a header")
                return b""
            self._fill()
        out, self.rest = self.rest[: at + len(mark)], self.rest[at + len(mark) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.rest:
                if not self.more:
                    raise EOFError("the archive ends within a block")
                self._fill()
            part, self.rest = self.rest[:n], self.rest[n:]
            n -= len(part)
            yield part


def normalise_stream(source: BinaryIO, sink: BinaryIO) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrite every record as a member of its own; (offset, length, header) of each."""
    stream, at = _Stream(source), 0
    while head := stream.until(b"\r\n\r\n"):
        head = head.lstrip(b"\r\n")
        fields = header(head)
        z = zlib.compressobj(LEVEL_MEMBER, zlib.DEFLATED, GZIP)
        start = at
        at += sink.write(z.compress(head))
        for piece in stream.pieces(int(fields["content-length"])):
            at += sink.write(z.compress(piece))
        for piece in stream.pieces(4):  # the two line ends after a block
            at += sink.write(z.compress(piece))
        at += sink.write(z.flush())
        yield start, at - start, fields


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write decided rows to archives under ``folder``, one gzip stream each; their names."""
    folder = qualified(rows.sparkSession, folder)

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        fs, base = filesystem(folder)
        name = f"raw-{TaskContext.get().partitionId():06d}.warc.gz"
        n = 0

        def fill(out):
            nonlocal n
            z = zlib.compressobj(LEVEL_STREAM, zlib.DEFLATED, GZIP)
            for pdf in frames:
                for r in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["payload_digest"], pdf["refers_to"]):
                    out.write(z.compress(record(*(None if x is None or x is pd.NA else x for x in r))))
                    n += 1
            out.write(z.flush())

        replace_file(fs, f"{base}/{name}", fill)
        yield pd.DataFrame({"archive": [name], "records": [n]})

    ids = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"))
    return ids.mapInPandas(run, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each named archive of ``folder``: archive, sidecar, records."""
    folder = qualified(archives.sparkSession, folder)

    def run(frames):
        import pandas as pd

        fs, base = filesystem(folder)
        for pdf in frames:
            for name in pdf["archive"]:
                own = name.replace("raw-", "records-")
                lines = []

                def fill(out, name=name, lines=lines):
                    lines.clear()
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                        for offset, length, fields in normalise_stream(source, out):
                            lines.append({"offset": offset, "length": length, "type": fields.get("warc-type"), "id": fields.get("warc-record-id")})

                replace_file(fs, f"{base}/{own}", fill)
                replace_file(fs, f"{base}/{own}.idx", lambda out, lines=lines: out.write("".join(json.dumps(x) + "\n" for x in lines).encode()))
                yield pd.DataFrame({"archive": [own], "sidecar": [own + ".idx"], "records": [len(lines)]})

    return archives.mapInPandas(run, "archive string, sidecar string, records long")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """All records of the named archives, found through their sidecars."""
    folder = qualified(archives.sparkSession, folder)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, block_digest string"

    def run(frames):
        import pandas as pd

        fs, base = filesystem(folder)
        number = lambda s: int(s[10:-1]) if s and s[10:-1] != "None" else None  # noqa: E731  <urn:page:N>
        for pdf in frames:
            for name, sidecar in zip(pdf["archive"], pdf["sidecar"]):
                with fs.open_input_stream(f"{base}/{sidecar}", compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    for e in index:
                        f.seek(e["offset"])
                        raw = zlib.decompress(f.read(e["length"]), GZIP)
                        at = raw.index(b"\r\n\r\n") + 4
                        h = header(raw[:at])
                        block = raw[at : at + int(h["content-length"])]
                        revisit = h["warc-type"] == "revisit"
                        digest = sha256(block).hexdigest()
                        if not revisit and f"sha256:{digest}" != h["warc-payload-digest"]:
                            raise ValueError(f"{name}: the payload of {h['warc-record-id']} does not match its digest")
                        rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), int(h["x-payload-length"]) if revisit else len(block), h["warc-payload-digest"][7:], digest))
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=cols, dtype=object)
                            rows = []
                yield pd.DataFrame(rows, columns=cols, dtype=object)

    cols = [c.split()[0] for c in schema.split(", ")]
    return archives.mapInPandas(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives and read every record back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    raw = written(write(decided(pages), folder), "warc-raw")
    n = max(1, raw.count())
    own = written(normalise(raw.repartition(n), folder), "warc-own")
    return read(own.repartition(n), folder)
