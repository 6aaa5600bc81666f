"""Operator 5, WARC revisit resolution and payload dedup."""

from __future__ import annotations

import gzip
import os
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import measured, written

START = 1704067200  # 2024-01-01, second of the first capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, http_header binary, payload binary"
#: Bytes that are read from an archive, and given on as rows, at a time.
READ, GIVE = 1 << 20, 8 << 20
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def _urn(key: Column) -> Column:
    h = F.md5(key)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def crawl_records(pages: DataFrame) -> DataFrame:
    """The records (RECORD) of a crawl of pages (page_id, url, html): each page
    is fetched once; every fifth is found unchanged 30 days later, which leaves
    a revisit record without payload; every seventh is fetched again a day
    later by a crawler that doesn't know the first, which leaves a second
    response. A null page_id has its first fetch only, at second 0; a null html
    is a response without payload and without payload digest."""
    p, page = F.col("page_id").cast("long"), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))
    later = lambda kind, wait: F.struct(F.lit(kind).alias("kind"), F.lit(wait).alias("wait"))
    none = F.array().cast("array<struct<kind:string,wait:int>>")
    visits = F.concat(
        F.array(later("response", 0)),
        F.when((p % 5 == 0) & F.col("html").isNotNull(), F.array(later("revisit", 30 * 86400))).otherwise(none),
        F.when((p % 7 == 0) & F.col("html").isNotNull(), F.array(later("response", 86400))).otherwise(none),
    )
    seen = pages.select(p.alias("p"), page.alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.concat(F.lit("sha1:"), F.sha1(F.col("html").cast("string"))).alias("digest"), F.explode(visits).alias("visit"))
    second = F.lit(START) + F.coalesce("p", F.lit(0)) % 86400 + F.col("visit.wait")
    date = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return seen.select(
        _urn(F.concat_ws(":", "page", "visit.kind", F.col("visit.wait").cast("string"), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.col("visit.kind").alias("warc_type"), F.col("url").alias("target_uri"), date.alias("warc_date"), F.col("digest").alias("payload_digest"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n").cast("binary").alias("http_header"),
        F.when(F.col("visit.kind") == "response", F.col("html").cast("binary")).alias("payload"),
    )


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _fresh(record_id: Column) -> Column:
    return _urn(F.concat(record_id, F.lit(":deduplicated")))


def deduplicate(records: DataFrame) -> DataFrame:
    """A deduplicated archive (source_record_id, warc_type, target_uri,
    warc_date, payload_digest, refers_to, header, block) of WARC records
    (RECORD): each distinct payload digest is kept in one response, the
    earliest by date, then record id; other responses with it become revisit
    records, and revisit records are resolved to it. All headers are written
    anew: ids, lengths, digests of the block, and for a revisit what it refers to.

    Headers alone are shuffled by payload digest, with map-side minima; the
    payloads, of any bytes and length, only pass a filter that removes the
    demoted records. Of responses that tie in date and record id the one of the
    least URI is the original. An empty table gives an empty archive.

    A revisit whose original isn't in the input keeps refers_to null and says
    nothing of what it refers to. Records without a payload digest are written
    as they are. Rows that repeat a record_id are one record if they agree in
    type, date, URI and digest; otherwise all are handled, each for itself. A
    null record_id gets its fresh id from date and URI. Other types than
    response and revisit pass with fresh headers. Further columns are dropped.
    """
    known = records.select(*(f.split()[0] for f in RECORD.split(", "))).withColumn("record_id", F.coalesce("record_id", _urn(F.concat_ws(":", F.lit("none"), "warc_date", "target_uri"))))
    heads = known.select("record_id", "warc_type", "target_uri", "warc_date", "payload_digest", "http_header")
    bearing = (F.col("warc_type") == "response") & F.col("payload_digest").isNotNull()
    rank = F.struct("warc_date", "record_id", "target_uri")
    groups = heads.where(F.col("payload_digest").isNotNull() & F.col("warc_type").isin("response", "revisit")).groupBy(F.col("payload_digest").alias("__d"))
    originals = groups.agg(F.min(F.when(bearing, rank)).alias("__o"), F.count("*").alias("__n"), F.count_if(F.col("warc_type") == "revisit").alias("__v"))
    originals = written(originals.where("__n > 1 OR __v > 0").select("__d", "__o"), "originals")
    joined = heads.join(measured(originals), F.col("payload_digest") == F.col("__d"))
    pointing = joined.where((F.col("warc_type") == "revisit") | ((F.col("warc_type") == "response") & (rank != F.col("__o")))).distinct()
    pointing = written(pointing, "revisits")
    demoted = pointing.where("warc_type = 'response'").select(F.col("record_id").alias("__id"), F.col("warc_date").alias("__date"), F.col("target_uri").alias("__uri"), F.col("payload_digest").alias("__pd")).distinct()
    demoted = written(demoted, "demoted")
    same = (F.col("record_id") == F.col("__id")) & F.col("warc_date").eqNullSafe(F.col("__date")) & F.col("target_uri").eqNullSafe(F.col("__uri")) & (F.col("payload_digest") == F.col("__pd")) & (F.col("warc_type") == "response")
    stay = known.where("warc_type <> 'revisit' OR warc_type IS NULL OR payload_digest IS NULL").join(measured(demoted), same, "left_anti")
    repeated = stay.groupBy("record_id", "warc_type", "target_uri", "warc_date", "payload_digest").count().where("count > 1")
    repeated = written(repeated.select("record_id").distinct(), "repeated")
    side = measured(repeated)
    once = stay.join(side, "record_id", "left_anti").unionByName(stay.join(side, "record_id", "left_semi").dropDuplicates(["record_id", "warc_type", "target_uri", "warc_date", "payload_digest"]))
    nothing, empty, blank = F.lit(None).cast("string"), F.lit("").cast("binary"), F.lit("\r\n").cast("binary")
    kept = once.select(
        F.col("record_id").alias("source_record_id"), "warc_type", "target_uri", "warc_date", "payload_digest", nothing.alias("refers_to"), nothing.alias("refers_uri"), nothing.alias("refers_date"),
        F.concat(F.coalesce(F.col("http_header").cast("binary"), empty), blank, F.coalesce(F.col("payload").cast("binary"), empty)).alias("block"),
    )
    sent = pointing.select(
        F.col("record_id").alias("source_record_id"), F.lit("revisit").alias("warc_type"), "target_uri", "warc_date", "payload_digest",
        _fresh(F.col("__o.record_id")).alias("refers_to"), F.col("__o.target_uri").alias("refers_uri"), F.col("__o.warc_date").alias("refers_date"),
        F.concat(F.coalesce(F.col("http_header").cast("binary"), empty), blank).alias("block"),
    )
    both = kept.unionByName(sent)
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("warc_type")), F.lit("WARC-Record-ID: <"), _fresh(F.col("source_record_id")), F.lit(">\r\n"), _line("WARC-Date", F.col("warc_date")), _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Payload-Digest", F.col("payload_digest")), _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        _line("WARC-Profile", F.when(F.col("warc_type") == "revisit", F.lit(PROFILE))), _line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))), _line("WARC-Refers-To-Target-URI", F.col("refers_uri")), _line("WARC-Refers-To-Date", F.col("refers_date")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n"),
    )
    return both.select("source_record_id", "warc_type", "target_uri", "warc_date", "payload_digest", "refers_to", header.alias("header"), "block")


def write_archives(archive: DataFrame, folder: str) -> DataFrame:
    """Writes one .warc.gz, a gzip member per record, for each partition into a
    folder all executors share (a path, or the URI of a file system that Arrow
    knows), and returns its index (source_record_id, file, offset, length). A
    file appears under its name when it is whole; a task that runs again
    replaces it. Blocks are bytes and are written as they are."""

    def run(batches):
        from pyspark import TaskContext

        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{root}/.{name}.{uuid.uuid4().hex}"
        index: list[list] = [[], [], [], []]
        at = 0
        with fs.open_output_stream(part, compression=None) as f:
            for batch in batches:
                for source, header, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    member = gzip.compress(header.encode() + b"\r\n" + block.as_py() + b"\r\n\r\n", 6, mtime=0)
                    f.write(member)
                    for c, x in zip(index, (source, name, at, len(member))):
                        c.append(x)
                    at += len(member)
        fs.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(index[0], pa.string()), pa.array(index[1], pa.string()), pa.array(index[2], pa.int64()), pa.array(index[3], pa.int64())], ["source_record_id", "file", "offset", "length"])

    return written(archive.select("source_record_id", "header", F.col("block").cast("binary")).mapInArrow(run, "source_record_id string, file string, offset long, length long"), "index")


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Also for the one slash that Hadoop leaves after file:."""
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return fs, path.rstrip("/")


def _records(stream):
    """(header, block) of each record of an open archive, read piece by piece.
    stream gives plain bytes; between records any line breaks may stand."""
    data, at = bytearray(), 0

    def need(n: int) -> bool:
        nonlocal at
        if at > 4 * READ:
            del data[:at]
            at = 0
        while len(data) - at < n:
            more = stream.read(max(READ, n - len(data) + at))
            if not more:
                return False
            data.extend(more)
        return True

    while True:
        while need(1) and data[at] in b"\r\n":
            at += 1
        if not need(1):
            return
        start, end = 0, -1
        while end < 0:
            end = data.find(b"\r\n\r\n", at + start)
            if end < 0:
                start = max(0, len(data) - at - 3)
                if not need(len(data) - at + 1):
                    raise ValueError("an archive ends within a record's header")
        header = bytes(data[at : end + 2])
        length = LENGTH.search(header)
        if not header.startswith(b"WARC/") or length is None:
            raise ValueError("an archive has a record without version or Content-Length")
        at, n = end + 4, int(length.group(1))
        if not need(n):
            raise ValueError("an archive ends within a record's block")
        yield header.decode("utf-8", "replace"), bytes(data[at : at + n])
        at += n


class _Members:
    """The plain bytes of a file of gzip members, or of one that isn't packed."""

    def __init__(self, stream) -> None:
        self.stream, self.left = stream, stream.read(READ)
        self.packed = self.left[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def read(self, n: int) -> bytes:
        while True:
            if not self.left:
                self.left = self.stream.read(READ)
                if not self.left:
                    if self.packed and self.inflate is not None and not self.inflate.eof and self.begun:
                        raise ValueError("an archive ends within a gzip member")
                    return b""
            if not self.packed:
                out, self.left = self.left, b""
                return out
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.begun = True
            out = self.inflate.decompress(self.left, max(READ, n))
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.begun = False
            if out:
                return out

    begun = False


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, header, block) of every record in the .warc.gz and .warc files of
    a folder. The listing holds no contents: a task opens its files and reads
    them as streams, a member after the other, so an archive may have any
    size; a record's block must fit a row (2 GB). A field's name may be written
    in any case. An archive that is cut off, or isn't one, raises ValueError."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").load(folder)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _file_system(path)
                name, rows, size = os.path.basename(path), [], 0
                with fs.open_input_stream(inner, compression=None, buffer_size=READ) as stream:
                    for header, block in _records(_Members(stream)):
                        rows.append((name, header, block))
                        size += len(block)
                        if size > GIVE:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return files.select("path").mapInArrow(run, "file string, header string, block binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), (pa.string(), pa.string(), pa.binary()))], ["file", "header", "block"])


def records_of(archives: DataFrame) -> DataFrame:
    """Records (RECORD) of read_archives(); a block of another type than
    response and revisit, or one without a blank line, is all payload. Blocks
    are cut as bytes."""
    field = lambda name: F.nullif(F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}:[ ]*<?([^\r\n>]*)", 1), F.lit(""))
    found = F.arrow_udf(lambda block: pc.find_substring(pc.binary_join_element_wise(pa.scalar(b"\r\n"), block, pa.scalar(b"")), b"\r\n\r\n").cast(pa.int32()), "int")
    http = field("WARC-Type").isin("response", "revisit")
    at = found("block")
    head = F.when(http & (at >= 0), F.substring("block", F.lit(1), at))
    body = F.when(http & (at >= 0), F.substring("block", at + 3, F.octet_length("block"))).otherwise(F.col("block"))
    return archives.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("warc_type"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("warc_date"),
        field("WARC-Payload-Digest").alias("payload_digest"), head.alias("http_header"), F.when(field("WARC-Type") != "revisit", body).alias("payload"),
    )
