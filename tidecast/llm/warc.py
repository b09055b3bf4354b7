"""WARC as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions from the files' sizes. Predicates on record type and on header columns are taken
from Spark's filters; each record's header block is parsed first, and the payload of a record that fails
them, or whose payload column was not asked for, is passed over without being kept or decoded. Files are
reached through pyarrow's file systems, so paths may be local, shared or remote.

Writing gives each task's records to files of its own, which the commit moves into place; files of tasks
that were run twice or lost are never moved. Records are gzip members one by one.

``write_pages`` stores pages: of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one
with the smallest id is a response, and the others are revisits without payload that name it. Their HTTP
header still tells the payload's length, and the digest header is that of the full payload.

Defined cases: a null payload counts as empty; a null id is larger than all others and reads back as null;
rows that share the smallest id are all responses; a null url reads back as null; line breaks in urls are percent-encoded; an
empty table gives an archive without records, which reads as no rows; extra columns are not written.
"""

from __future__ import annotations

import gzip
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In,
                                    InputPartition, IsNotNull, WriterCommitMessage)

from .common import lookup_skewed, materialise, new_path, table

REVISIT_BYTES = 100
FILE_BYTES = 64_000_000
PARTITION_BYTES = 32_000_000
BATCH_BYTES = 8_000_000
READ_BYTES = 1 << 20
# Header names of the format and the profile of revisits with equal payloads.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
           "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_length long, payload binary")


def _files(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = posixpath.abspath(path)
    return fs.FileSystem.from_uri(path)


class WarcPartition(InputPartition):
    def __init__(self, files):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.columns = [f.name for f in schema.fields]
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Take the predicates that headers decide; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _files(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
                 if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]
        parts, size = [], self.partition_bytes
        for i in sorted(found, key=lambda i: i.path):
            if size + i.size > self.partition_bytes and size:
                parts.append([])
                size = 0
            parts[-1].append(i.path)
            size += i.size
        return [WarcPartition(p) for p in parts] or [WarcPartition([])]

    def _wanted(self, record) -> bool:
        return all(record[c] in v if kind == "in" else record[c] is not None for c, kind, v in self.tests)

    def read(self, partition):
        system, _ = _files(self.path)
        rows, size = [], 0
        for name in partition.files:
            with system.open_input_stream(name, compression=None) as raw:
                stream = Members(raw) if name.endswith(".gz") else Plain(raw)
                while (record := read_headers(stream)) is not None:
                    length = record.pop("content_length")
                    wanted = self._wanted(record)
                    if wanted:
                        read_block(stream, record, length, "payload" in self.columns)
                        rows.append(record)
                        size += len(record.get("payload") or b"") + 200
                    else:
                        stream.skip(length)
                    stream.skip(4)  # the two line ends after a record
                    if size > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.columns], names=self.columns)


class Plain:
    """Bytes of a stream with lines, exact reads and skips."""

    def __init__(self, raw):
        self.raw, self.buffer = raw, b""

    def _more(self) -> bytes:
        return self.raw.read(READ_BYTES)

    def fill(self, n: int) -> bool:
        parts, have = [self.buffer], len(self.buffer)
        while have < n and (more := self._more()):
            parts.append(more)
            have += len(more)
        self.buffer = b"".join(parts)
        return have >= n

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self.fill(len(self.buffer) + 1):
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 2:]
        return out

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise EOFError("a record ends before its length")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = self._more()
            if not self.buffer:
                raise EOFError("a record ends before its length")
        self.buffer = self.buffer[n:]


class Members(Plain):
    """The same over gzip members laid end to end, inflated a piece at a time."""

    def __init__(self, raw):
        super().__init__(raw)
        self.inflate, self.rest = zlib.decompressobj(31), b""

    def _more(self) -> bytes:
        while True:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data or self.rest
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.unconsumed_tail or self.rest or self.raw.read(READ_BYTES)
            self.rest = b""
            if not data:
                return b""
            out = self.inflate.decompress(data, READ_BYTES)
            if out:
                return out


def read_headers(stream) -> dict | None:
    """The named headers of the next record, or None at the end."""
    first = stream.line()
    if first is None:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    found = {}
    while line := stream.line():
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    record = {c: found.get(h.lower()) for c, h in HEADERS.items()}
    record["content_length"] = int(found["content-length"])
    record["http"] = found.get("content-type", "").startswith("application/http")
    return record


def read_block(stream, record: dict, length: int, with_payload: bool) -> None:
    """Read a wanted record's block: the HTTP header if there is one, then the payload if asked for."""
    told = None
    if record.pop("http"):
        while line := stream.line():
            length -= len(line) + 2
            if line.lower().startswith(b"content-length:"):
                told = int(line.split(b":")[1])
        length -= 2
    if with_payload:
        record["payload"] = stream.take(length)
    else:
        stream.skip(length)
    record["payload_length"] = length if told is None else told


class WarcMessage(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Expects the columns of SCHEMA that it has to write: all but payload_length are optional but record_type
    and record_id; a null payload writes a record with the HTTP header only."""

    def __init__(self, options, overwrite):
        self.path = options["path"]
        self.temporary = posixpath.join(self.path, f"_temporary-{uuid.uuid4().hex}")
        self.date = options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator):
        from pyspark import TaskContext

        names, out, size = [], None, 0
        system = root = None
        for batch in iterator:
            if system is None:
                system, root = _files(self.temporary)
                system.create_dir(root, recursive=True)
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(posixpath.join(root, names[-1]), compression=None), 0
                member = gzip.compress(record_bytes(row, self.date), 3, mtime=0)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return WarcMessage(names)

    def commit(self, messages):
        system, final = _files(self.path)
        _, temporary = _files(self.temporary)
        system.create_dir(final, recursive=True)
        for m in messages:
            for name in m.files if m else ():
                system.move(posixpath.join(temporary, name), posixpath.join(final, name))
        self._clear(system, temporary)

    def abort(self, messages):
        system, temporary = _files(self.temporary)
        self._clear(system, temporary)

    def _clear(self, system, temporary):
        from pyarrow import fs

        if system.get_file_info(temporary).type == fs.FileType.Directory:
            system.delete_dir(temporary)


def record_bytes(row: dict, date: str) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    payload = row.get("payload")
    length = row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [VERSION]
    for column, name in HEADERS.items():
        value = row.get(column) if column != "date" else row.get("date") or date
        if value is not None:
            lines.append(f"{name}: {clean(value)}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


ID_PREFIX = "<urn:page:"


def _urn(col):
    return F.concat(F.lit(ID_PREFIX), F.coalesce(col.cast("string"), F.lit("")), F.lit(">"))


def page_id_of(urn):
    """The id in a record id; null for none."""
    text = F.substring_index(F.substring_index(urn, ":", -1), ">", 1)
    return F.when(text != "", text).cast("long")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per page, later copies of a payload without it."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("target_uri"),
                        payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    slim = materialise(rows.where(F.col("payload_length") >= REVISIT_BYTES)
                       .groupBy("digest", "page").agg(F.count("*").alias("n")), "warc-digests")
    first = slim.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n_ids"))
    # a third of all pages may share one digest: the few such digests are looked up by broadcast
    again = lookup_skewed(slim, first, "digest", "n_ids", slim.count()).where("page is null or page > first")
    again = again.where("first is not null").select(F.col("digest").alias("d"), F.col("page").alias("p"), "first")
    return rows.join(again, (F.col("digest") == F.col("d")) & F.col("page").eqNullSafe(F.col("p")), "left").select(
        _urn(F.col("page")).alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.when(F.col("first").isNotNull(), _urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload_length",
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, **columns) -> None:
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").save(path)


def read_records(spark, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records with the asked columns; leave ``payload`` out of the schema to pass payloads over."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND coalesce(page_id > first, first IS NOT NULL) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM r"""


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    # responses tell length and digest by their payload; revisits by their headers, their payload passed over
    responses = read_records(spark, path).where("record_type = 'response'").select(
        "record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"))
    revisits = read_records(spark, path, SCHEMA.replace(", payload binary", "")).where(
        "record_type = 'revisit'").select(
        "record_id", "record_type", "refers_to", F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"))
    return responses.unionByName(revisits).select(
        page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_id_of(F.col("refers_to")).alias("refers_to"))
