"""WARC archives: written through Spark's text sink, read by a Python data source.

A record is one string whose separator is the blank lines that end a WARC record, so Spark's own
committed, splittable-by-file writer makes the archives on whatever store the folder lives. Payloads that
repeat are stored once: the page with the least id is the ``response``, the others are ``revisit``
records that carry only headers, with the digest and the length of the payload they refer to.

The source plans one partition per archive file. Predicates on the record type and on header columns are
pushed into it; for each record it parses the headers first, and a record that the predicates reject, or
whose payload is not asked for (``payload`` option ``skip``), is skipped without being decoded.

How it scales: digests are compared instead of pages; only (id, digest) pairs are grouped, combined on the
map side, and pages are joined by their own id. Files hold a bounded number of records and are streamed.

Defined cases: a null page has an empty payload; payloads below ``least`` bytes are always responses; a page
without id is always a response; equal rows of one id are one page and all responses; line breaks in a
url are percent-encoded; an empty table gives archives without records. Other columns are not read.
"""

from __future__ import annotations

import gzip
import io
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from vigilog.session import run_folder

#: Bytes from which equal payloads are stored once.
LEAST = 100
#: Records in one archive file at most.
RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SEPARATOR = "\r\n\r\n"


# --- writing -------------------------------------------------------------------------------


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    lines = [F.lit("WARC/1.1")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_SEPARATOR))


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST) -> DataFrame:
    """One WARC record per page, as a string without the closing blank lines (column ``value``)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    large = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")
    )
    firsts = firsts.filter("first_id < last_id").drop("last_id")
    again = large.join(firsts, "digest").filter("page_id > first_id").distinct()
    joined = rows.join(again, ["page_id", "digest"], "left")
    revisit = F.col("first_id").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(_SEPARATOR),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = _header(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.format_string("<urn:page:%d>", "page_id")),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, F.format_string("<urn:page:%d>", "first_id"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(head, block).alias("value"))


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = LEAST,
) -> None:
    out = records(pages, id_col, url_col, html_col, least).write
    out = out.option("lineSep", _SEPARATOR).option("compression", "gzip")
    out.option("maxRecordsPerFile", RECORDS).text(folder)


# --- reading -------------------------------------------------------------------------------

SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("http_length", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
#: Columns that are headers, which predicates can be pushed to.
_FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "refers_to": "warc-refers-to",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
}


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _lines(stream: io.BufferedIOBase) -> tuple[int, dict[str, str]]:
    """Bytes read and fields of a header block, up to its blank line."""
    n, fields = 0, {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        n += len(line)
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return n + len(line), fields


def _skip(stream: io.BufferedIOBase, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise EOFError("an archive ends within a record")
        n -= got


def parse(stream: io.BufferedIOBase, wanted, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive that ``wanted(fields)`` accepts."""
    while True:
        start = stream.readline()
        if not start:
            return
        if not start.strip():
            continue
        if not start.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {start[:40]!r}")
        _, fields = _lines(stream)
        left = int(fields["content-length"])
        if not wanted(fields):
            _skip(stream, left)
            continue
        http: dict[str, str] = {}
        if fields.get("content-type", "").startswith("application/http"):
            n, http = _lines(stream)
            left -= n
        payload = None
        if with_payload:
            payload = stream.read(left)
            if len(payload) < left:
                raise EOFError("an archive ends within a record")
        else:
            _skip(stream, left)
        length = http.get("content-length")
        yield (
            *(fields.get(_FIELDS[c]) for c in list(_FIELDS)),
            int(fields["content-length"]),
            None if length is None else int(length),
            fields,
            payload,
        )


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload
        #: Header and the values it may have; None: it must be there.
        self.conditions: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = _FIELDS.get(f.attribute[0]) if isinstance(f, EqualTo | In | IsNotNull) else None
            if name is None:
                yield f
            elif isinstance(f, IsNotNull):
                self.conditions.append((name, None))
            else:
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.conditions.append((name, frozenset(values)))

    def partitions(self):
        from pyarrow import fs

        files, root = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(
            i.path
            for i in found
            if i.type == fs.FileType.File and i.size and not os.path.basename(i.path).startswith(("_", "."))
        )
        return [InputPartition(n) for n in names] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        files, _ = _filesystem(self.path)
        conditions = self.conditions

        def wanted(fields: dict[str, str]) -> bool:
            return all(n in fields if v is None else fields.get(n) in v for n, v in conditions)

        with files.open_input_stream(partition.value, compression=None) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            if partition.value.endswith(".gz"):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
            yield from parse(stream, wanted, self.with_payload)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "skip").load(folder)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "read") != "skip")


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records below a folder. Filters on header columns are pushed into the parser."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", "read" if payload else "skip").load(folder)


def archive_report(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes the pages, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    write_warc(pages, folder, id_col, url_col, html_col)
    number = r"^<urn:page:(-?\d+)>$"
    # Pages come with their payloads, which are measured; revisits are read by their headers alone.
    pages_read = read_warc(spark, folder).filter("record_type = 'response'").select(
        "record_id", "record_type", "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    revisits = read_warc(spark, folder, payload=False).filter("record_type = 'revisit'").select(
        "record_id", "record_type", "refers_to",
        F.col("http_length").alias("payload_bytes"),
        F.regexp_extract("payload_digest", "^sha256:(.*)$", 1).alias("payload_digest"),
    )
    both = pages_read.unionByName(revisits)

    def to_id(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.regexp_extract(name, number, 1)).try_cast("long")

    return both.select(
        to_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        to_id("refers_to").alias("refers_to"),
    )
