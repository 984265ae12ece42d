"""WARC archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per archive file. Filters on record type and header columns are pushed to
the reader, which parses a record's header first and steps over an unwanted record: in plain files by its
length, in compressed ones by the skip length ("sl" field of the gzip member) where there is one. With the
option ``payload=false`` no payload is decoded at all. Every decoded payload is held against its digest.

Writing makes one gzip member per record and a new file each ``file_bytes`` bytes. A task writes under a
name of its own; only the commit gives files their final names, so tasks that are lost or repeated leave
nothing that a reader takes. Paths may be local or of any store that pyarrow.fs opens.

Defined results: a null payload is empty. A null id becomes the record id "null". Rows that repeat the
largest id of an equal payload are all responses. Control characters and blanks in a url are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from surfpop.llm.common import query, table
from surfpop.session import cut, work_root

#: Column of the source and the header it holds; fixed values.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """One gzip member that tells its own compressed and plain length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    """A response with its payload, or a revisit without one."""
    payload, kind = row["payload"] or b"", row["record_type"]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = status + (b"Content-Length: %d\r\n\r\n" % len(payload) + payload if kind == "response" else b"\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), row["target_uri"]))
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{row['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, file_bytes: int):
        self.path, self.date, self.file_bytes = path, date, file_bytes

    def write(self, batches):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        names, out = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f".{uuid.uuid4().hex}.tmp")
                    out = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
                out.write(member(record(row, self.date)))
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages):
        fs, root = _open(self.path)
        for n, name in enumerate(name for m in messages if m is not None for name in m.names):
            fs.move(f"{root}/{name}", f"{root}/part-{n:06d}.warc.gz")

    def abort(self, messages):
        fs, root = _open(self.path)
        for name in (name for m in messages if m is not None for name in m.names):
            fs.delete_file(f"{root}/{name}")


@dataclass
class File(InputPartition):
    path: str


class Records:
    """The records of one archive: ``next_header`` then either ``block`` or ``skip``."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at = source, size, 0

    def next_header(self) -> dict[str, str] | None:
        if self.at >= self.size:
            return None
        self.source.seek(self.at)
        lead = self.source.read(24)
        self.unzip, self.skip_to, self.fed = None, None, self.at
        if lead[:2] == b"\x1f\x8b":
            if len(lead) == 24 and lead[3] & 4 and lead[12:14] == b"sl":
                self.skip_to = self.at + struct.unpack("<I", lead[16:20])[0]
            self.unzip = zlib.decompressobj(31)
        self.source.seek(self.at)
        self.plain = b""
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError(f"A record header at byte {self.at} has no end.")
        head = self.plain[:end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"No record starts at byte {self.at}.")
        self.body = end + 4
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        self.length = int(headers["content-length"])
        return headers

    def _more(self) -> bool:
        if self.unzip is None:
            piece = self.source.read(1 << 16)
            self.plain += piece
            return bool(piece)
        if self.unzip.eof:
            return False
        piece = self.source.read(1 << 14)
        self.fed += len(piece)
        self.plain += self.unzip.decompress(piece)
        return bool(piece)

    def _end(self) -> None:
        if self.unzip is None:
            self.at += self.body + self.length + 4
        else:
            self.at = self.fed - len(self.unzip.unused_data)

    def block(self) -> bytes:
        parts, have = [self.plain], len(self.plain)
        want = self.body + self.length
        while have < want or (self.unzip is not None and not self.unzip.eof):
            self.plain = b""
            if not self._more():
                break
            parts.append(self.plain)
            have += len(self.plain)
        if have < want:
            raise ValueError(f"The record at byte {self.at} is cut off.")
        self._end()
        return b"".join(parts)[self.body:want]

    def skip(self) -> None:
        if self.skip_to is not None:
            self.at = self.skip_to
            return
        while self.unzip is not None and not self.unzip.eof:
            self.plain = b""
            if not self._more():
                break
        self._end()


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None if hasattr(f, "attribute") else None
            if column in HEADERS and isinstance(f, (EqualTo, In)):
                self.wanted.append((column, frozenset(f.value) if isinstance(f, In) else frozenset([f.value])))
            elif not (column in HEADERS and isinstance(f, IsNotNull)):
                yield f
            else:
                self.wanted.append((column, None))

    def partitions(self):
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        prefix = self.path.rstrip("/")
        return [
            File(prefix + x.path.removeprefix(root.rstrip("/"))) for x in found
            if x.is_file and not x.base_name.startswith((".", "_")) and x.base_name.endswith((".warc", ".warc.gz"))
        ]

    def read(self, partition):
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload", pa.binary())])
        fs, path = _open(partition.path)
        rows, size = [], 0
        with fs.open_input_file(path) as source:
            records = Records(source, source.size())
            while (headers := records.next_header()) is not None:
                row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                row |= {c: v.strip("<>") for c in ("record_id", "refers_to") if (v := row[c]) is not None}
                if any(row[c] is None or (ok is not None and row[c] not in ok) for c, ok in self.wanted):
                    records.skip()
                    continue
                row["payload"] = None
                if self.payload:
                    block = records.block()
                    row["payload"] = payload_of(row, block)
                    size += len(block)
                else:
                    records.skip()
                rows.append(row)
                if size > BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def payload_of(row: dict, block: bytes) -> bytes | None:
    """A response's payload, held against its digest; a revisit has none of its own."""
    if row["record_type"] == "revisit":
        return None
    if "msgtype=response" in (row["content_type"] or ""):
        block = block[block.index(b"\r\n\r\n") + 4:]
    stated = row["payload_digest"]
    if stated and stated != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"The payload of {row['record_id']} does not have its digest.")
    return block


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("file_bytes", 128 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: The five-bit digits of base32; fixed value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Digest column: the hex digest in runs of 5 characters (20 bits), each as 4 base32 digits."""
    digits = F.lit(BASE32)
    runs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.col("_sha1"), i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    one = lambda run, shift: F.substring(digits, F.shiftright(run, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(*[one(r, s) for s in (15, 10, 5, 0)])), "")


def archive_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows for the writer. Of equal payloads of ``min_bytes`` or more, the largest id is the response."""
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("_id"), F.col(url).alias("target_uri"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"), F.sha1(F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")).alias("_sha1"))
    first = rows.groupBy("_sha1").agg(F.max("_id").alias("_first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    again = (F.octet_length("payload") >= min_bytes) & ~F.col("_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_sha1").select(
        name("_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, name("_first")).alias("refers_to"), base32_sha1("payload").alias("payload_digest"),
        F.when(~again, F.col("payload")).alias("payload"))


def write_archive(rows: DataFrame, path: str, **options) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").options(**options).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


@query("op6_warc_round_trip", """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as bytes, sha1(coalesce(html, '')) as hex from pages),
five as (
  select hex, i, ('0x' || hex[(i // 4) * 5 + 1 : (i // 4) * 5 + 5])::integer as run
  from (select hex, unnest(range(32)) as i from (select distinct hex from p))),
b as (select hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((run >> (15 - 5 * (i % 4))) & 31)::bigint + 1, 1), '' order by i) as b32
      from five group by hex),
f as (select hex, max(page_id) as top from p group by hex)
select page_id, bytes as payload_bytes, b32 as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id <> top then top end as refers_to
from p join b using (hex) join f using (hex)""")
def op6_warc_round_trip(spark, sf_dir):
    path = f"{work_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(archive_rows(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    digest = F.replace("payload_digest", F.lit("sha1:"), F.lit("")).alias("payload_digest")
    responses = cut(read_archive(spark, path).where("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), digest))
    full = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = read_archive(spark, path, payload=False).where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), digest, number("refers_to").alias("refers_to"))
    same = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return same.unionByName(revisits.join(full, "payload_digest").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
