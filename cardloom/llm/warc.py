"""WARC archives as a Spark data source, and a page table written as WARC.

``spark.read.format("warc")`` plans one partition per stretch of records that
the writer's manifest lists (per file where there is no manifest), pushes
predicates on record type and headers into the scan, parses a record's headers
first, and steps over the payload of a record that the predicates reject or
whose payload columns the read schema leaves out. Plain and gzipped archives
are read and written alike. Written records are gzip members that state both
their lengths (the skip-length field of the WARC standard), so that what isn't
wanted isn't inflated; archives without that field are inflated throughout.

``df.write.format("warc").mode("append")`` writes the columns of
:data:`WRITE_SCHEMA`. A task's files count only once the job's manifest names
them, so a task that is run again, or twice, leaves no record behind twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from cardloom.llm.common import new_folder

READ_SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, "
    "payload_digest string, refers_to string, content_length long, payload_bytes long, "
    "digest_ok boolean, headers map<string,string>, payload binary"
)
WRITE_SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)
#: Columns that need a record's payload; all others come from its headers.
PAYLOAD_COLUMNS = {"payload", "digest_ok"}
#: Columns whose predicates are decided on the headers alone, and the header each comes from.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
#: Fixed by the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(value: str) -> str:
    """A value on one line: line ends are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _column(name: str, headers: dict[str, str]) -> str | None:
    value = headers.get(HEADER_OF[name])
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if name == "payload_digest" else value


def member(data: bytes) -> bytes:
    """A gzip member with the skip-length field: its own length and that of ``data``."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = len(body) + 32
    if max(size, len(data)) >= 1 << 32:  # too long for the field
        return gzip.compress(data, 1, mtime=0)
    number = lambda n, width=4: n.to_bytes(width, "little")
    extra = b"sl" + number(8, 2) + number(size) + number(len(data))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + number(len(extra), 2) + extra + body + number(zlib.crc32(data)) + number(len(data))


class Inflated:
    """A gzipped archive as plain bytes, inflated as far as they are read.

    ``skip`` steps over what is left of a member whose lengths are stated.
    ``raw`` stands at a member's start.
    """

    def __init__(self, raw: io.BufferedReader):
        self.raw, self.inflater, self.held, self.inflated = raw, None, b"", 0

    def _next(self) -> bool:
        self.start, self.given, self.rest, self.sizes = self.raw.tell(), 0, b"", None
        head = self.raw.read(12)
        if len(head) < 12:
            return False
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"not a gzip member: {head!r}")
        if head[3] & 4:
            extra = self.raw.read(int.from_bytes(head[10:12], "little"))
            at = extra.find(b"sl\x08\x00")
            if at >= 0:
                self.sizes = int.from_bytes(extra[at + 4 : at + 8], "little"), int.from_bytes(extra[at + 8 : at + 12], "little")
        self.raw.seek(self.start)
        self.inflater = zlib.decompressobj(16 + zlib.MAX_WBITS)
        return True

    def _more(self, most: int) -> bytes:
        """Up to ``most`` further bytes; none at the end."""
        while self.inflater is not None or self._next():
            data = self.rest or self.raw.read(1 << 14)
            out = self.inflater.decompress(data, most)
            self.rest = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.raw.seek(-len(self.inflater.unused_data), 1)
                self.inflater = None
            elif not data:
                raise EOFError("the archive ends within a gzip member")
            if out:
                self.given, self.inflated = self.given + len(out), self.inflated + len(out)
                return out
        return b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n and (more := self._more(n - len(self.held))):
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def readline(self, most: int = 1 << 30) -> bytes:
        while b"\n" not in self.held and len(self.held) < most and (more := self._more(1024)):
            self.held += more
        end = self.held.find(b"\n") + 1 or len(self.held)
        return self.read(min(end, most))

    def skip(self, n: int) -> None:
        n -= len(self.read(min(n, len(self.held))))
        while n and (self.inflater is not None or self._next()):
            left = self.sizes[1] - self.given if self.sizes else None
            if left is not None and n >= left:
                self.raw.seek(self.start + self.sizes[0])
                self.inflater, n = None, n - left
            else:
                n -= len(self._more(min(n, 1 << 16)))


class Plain(io.BufferedReader):
    def skip(self, n: int) -> None:
        self.seek(n, 1)


@dataclass
class Stretch(InputPartition):
    path: str
    offset: int = 0
    records: int | None = None  # None: to the file's end


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADER_OF and isinstance(f, EqualTo | In | StringStartsWith):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else f.value
                self.tests.append((name, "prefix" if isinstance(f, StringStartsWith) else "in", wanted))
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Stretch(root)]
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
        manifests = [p for p in found if re.search(r"/_manifest-[^/]*\.json$", p)]
        if not manifests:
            return [Stretch(p) for p in sorted(found) if p.endswith((".warc", ".warc.gz"))] or [Stretch("")]
        out = []
        for m in sorted(manifests):
            with fs.open_input_stream(m) as f:
                for entry in json.loads(f.read()):
                    out += [Stretch(f"{root}/{entry['file']}", at, n) for at, n in entry["stretches"]]
        return out or [Stretch("")]

    def _fits(self, headers: dict[str, str]) -> bool:
        for name, how, wanted in self.tests:
            value = _column(name, headers)
            if value is None or not (value.startswith(wanted) if how == "prefix" else value in wanted):
                return False
        return True

    def read(self, part: Stretch) -> Iterator[tuple]:
        if not part.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        want_payload = bool(PAYLOAD_COLUMNS & set(self.columns))
        want_http = want_payload or "payload_bytes" in self.columns
        with fs.open_input_file(part.path) as raw:
            raw.seek(part.offset)
            f = Inflated(io.BufferedReader(raw, 1 << 16)) if part.path.endswith(".gz") else Plain(raw, 1 << 20)
            n = 0
            while part.records is None or n < part.records:
                headers = read_headers(f)
                if headers is None:
                    return
                n += 1
                left = length = int(headers.get("content-length", 0))
                row = None
                if self._fits(headers):
                    row = {c: _column(c, headers) for c in HEADER_OF}
                    row |= {"content_length": length, "headers": headers, "payload_bytes": None, "payload": None, "digest_ok": None}
                    http = headers.get("content-type", "").startswith("application/http")
                    if want_http and http:
                        taken, size = read_http_head(f, left)
                        left -= taken
                        row["payload_bytes"] = left if size is None or row["record_type"] != "revisit" else size
                    elif not http:
                        row["payload_bytes"] = length
                    if want_payload and row["record_type"] != "revisit":
                        row["payload"] = f.read(left)
                        left = 0
                        row["digest_ok"] = row["payload_digest"] == base32_sha1(row["payload"])
                f.skip(left + 4)  # what is left of the block, and the two line ends after it
                if row is not None:
                    yield tuple(row[c] for c in self.columns)


def read_headers(f) -> dict[str, str] | None:
    """A record's headers by lower-case name; None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    headers = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def read_http_head(f, most: int) -> tuple[int, int | None]:
    """Bytes of the HTTP head and the Content-Length it states, reading ``most`` bytes at most."""
    taken, size = 0, None
    while taken < most:
        line = f.readline(most - taken)
        taken += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            size = int(value)
    return taken, size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, compress: bool, stretch_bytes: int, file_bytes: int):
        self.path, self.date, self.compress = path, date, compress
        self.stretch_bytes, self.file_bytes, self.job = stretch_bytes, file_bytes, uuid.uuid4().hex

    def write(self, batches) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        done, out, entry, at = Written(), None, None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or at >= self.file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{self.job}-{uuid.uuid4().hex}.warc" + ".gz" * self.compress
                        out, at, entry = fs.open_output_stream(f"{root}/{name}", compression=None), 0, {"file": name, "stretches": []}
                        done.files.append(entry)
                    if not entry["stretches"] or at - entry["stretches"][-1][0] >= self.stretch_bytes:
                        entry["stretches"].append([at, 0])
                    data = record(row, self.date)
                    data = member(data) if self.compress else data
                    out.write(data)
                    at += len(data)
                    entry["stretches"][-1][1] += 1
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{self.job}.json") as f:
            f.write(json.dumps([e for m in messages if m is not None for e in m.files]).encode())

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for e in m.files if m is not None else ():
                fs.delete_file(f"{root}/{e['file']}")


def record(row: dict, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [("WARC-Type", row["record_type"])]
    head += [("WARC-Record-ID", f"<{_header_value(row['record_id'])}>")] if row["record_id"] is not None else []
    head += [("WARC-Date", date)]
    head += [("WARC-Target-URI", _header_value(row["target_uri"]))] if row["target_uri"] is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{row['payload_digest'] or base32_sha1(payload)}")]
    head += [("WARC-Profile", REVISIT_PROFILE)] if revisit else []
    head += [("WARC-Refers-To", f"<{_header_value(row['refers_to'])}>")] if revisit and row["refers_to"] is not None else []
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    """Options: ``path``; for writing ``date``, ``compress``, ``stretch_bytes``, ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode('append')")
        o = self.options
        return WarcWriter(
            o["path"], o.get("date", "1970-01-01T00:00:00Z"), o.get("compress", "true") == "true",
            int(o.get("stretch_bytes", 16 << 20)), int(o.get("file_bytes", 256 << 20)),
        )


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The archives under ``path``; ``columns`` of :data:`READ_SCHEMA` that are wanted (all if None)."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(x.rsplit(" ", 1) for x in READ_SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) if columns else READ_SCHEMA
    return spark.read.format("warc").schema(schema).load(path)


def write_pages(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, id_prefix: str = "urn:page:", compress: bool = True,
) -> None:
    """Write a record per row of ``pages``; payloads met before become revisit records.

    Of the rows with equal payloads of at least ``min_revisit_bytes`` bytes,
    those with the smallest id are response records, the others revisit it.
    A null payload is empty. A null url writes no target URI, a null id no
    record id (such a row is a response only if all its equals have null ids).
    Repeated rows are records of their own; an empty table writes an empty
    manifest; other columns are not written.

    Payloads are shuffled once, by digest, as hash aggregation and join: a
    payload that a third of all pages share is split by the skew join.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = (
        rows.filter(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    again = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())
    out = rows.join(firsts, "sha", "left").select(
        F.concat(F.lit(id_prefix), F.col("id").cast("string")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        base32_hex(F.col("sha")).alias("payload_digest"),
        F.when(again, F.concat(F.lit(id_prefix), F.col("first").cast("string"))).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("compress", str(compress).lower()).save(path)


def base32_hex(sha):
    """Base32 of a SHA-1 that is given in hex: 5 hex digits make 4 characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def four(i):
        v = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("long")
        return [F.substring(alphabet, F.shiftright(v, s).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*(c for i in range(8) for c in four(i)))


def archive_pages(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to a new folder of archives and read the records' headers and checks back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and
    digest_ok (the stored payload has the stated digest; null for revisits).
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_pages(pages, path, id_col=id_col, **options)
    got = read_warc(spark, path, ["record_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "digest_ok"])
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1)
    to_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return got.select(
        to_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        to_id("refers_to").alias("refers_to"), "digest_ok",
    )
