"""WARC from legacy ARC archives: header lines of both ARC versions, declared lengths, synthesised WARC fields.

An archive is one file of bounded size, written by Spark's text writer (one row is one archive, the line
separator is what ends a record) and read back with the binary-file source, so every file is committed or
absent and any executor can read it. Conversion goes archive by archive: a first pass parses the ARC records
and keeps a digest of each payload, Spark decides which record of equal payloads stays whole, a second pass
parses again and writes the WARC records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm.common import keep
from parcelwise.session import scratch_path

# fixed values: the fields of a record's header line by ARC version, in their order
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARCHIVE_BYTES = 32 << 20
_HOT_SHARE = 1000  # a group of more than one in so many records is hot; there are fewer such groups than this number


# --- ARC ----------------------------------------------------------------------------------------


class ArcRecord(NamedTuple):
    version: int
    archive: str  # name that the archive gives itself
    offset: int
    fields: dict[str, str]
    body: bytes


def _uri(url: str | None, known: str = "about:blank") -> str:
    """A URL without white space and control characters, which would end a field; ``known`` stands for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else known


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    rest = f"{version} 0 parcelwise\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(rest)}\n".encode() + rest


def arc_entry(version: int, name: str, offset: int, url: str, date: str, kind: str, body: bytes) -> bytes:
    """A header line and its body, without the line end that follows."""
    middle = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{url} 0.0.0.0 {date} {kind} {middle}{len(body)}\n".encode() + body


def http_response(payload: bytes, page_id: int | None) -> bytes:
    named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload


def _arcs(date: str, archive_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages (page_id, url, html) to whole archives, of version 1 and 2 in turn."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, pieces, size = TaskContext.get().partitionId(), 0, [], 0
        version, name = 1, ""
        for part in parts:
            for page_id, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if not pieces:
                    version, name = 1 + (task + number) % 2, f"pages-{task:05}-{number:05}.arc"
                    pieces = [arc_head(version, name, date)]
                    size = len(pieces[0])
                # every record but the first follows the line end of the one before it
                pieces.append(arc_entry(version, name, size, _uri(url), date, "text/html", http_response((html.as_py() or "").encode(), page_id)))
                size += len(pieces[-1]) + 1
                if size >= archive_bytes:
                    yield _archive(pieces[0] + b"\n".join(pieces[1:]))
                    pieces, number = [], number + 1
        if pieces:
            yield _archive(pieces[0] + b"\n".join(pieces[1:]))

    return run


def _archive(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"value": pa.array([content], pa.binary())})


def _write(archives: DataFrame, path: str, end: str) -> None:
    """One gzip file for each row of ``archives`` (value binary), which ends with ``end``."""
    texts = archives.select(F.col("value").cast("string").alias("value"))
    texts.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def write_arc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "20240101000000", archive_bytes: int = _ARCHIVE_BYTES,
) -> None:
    """Write pages as ARC archives of about ``archive_bytes`` before compression, each of version 1 or 2.

    A record is an HTTP response with the html in UTF-8 (null: empty) and, unless null, the id as ``X-Page-Id``.
    A null or empty url is ``about:blank``; white space and control characters in it are percent-encoded. The
    order of records is that of the rows. Repeated rows are records of their own; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    _write(rows.mapInArrow(_arcs(date, archive_bytes), "value binary"), path, "\n")


def _opened(content: bytes) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _exactly(file: BinaryIO, n: int) -> bytes:
    out = file.read(n)
    if len(out) != n:
        raise ValueError(f"archive ends {n - len(out)} bytes before a record does")
    return out


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """All records of an archive, plain or gzip (one member or one a record), the version blocks included.

    A version block says which fields header lines have from there on; without one a line is of version 2 if
    its last but nine fields fit, else of version 1. Bodies are taken by their declared length alone.
    """
    file, version, archive, offset = _opened(content), 0, "", 0
    while line := file.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        head = line.rstrip(b"\r\n")
        opens = head.startswith(b"filedesc:")
        if opens or not version:
            version = 2 if len(head.split(b" ")) >= 10 else 1
        names = ARC_FIELDS[version]
        values = head.rsplit(b" ", len(names) - 1)
        if len(values) < len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line of version {version} at {start}: {head[:200]!r}")
        fields = {k: v.decode("utf-8", "surrogateescape") for k, v in zip(names, values, strict=True)}
        body = _exactly(file, int(values[-1]))
        offset += len(body)
        if opens:
            archive = fields["URL"].removeprefix("filedesc:").lstrip("/")
            version = int(body.split(b" ", 1)[0]) if body[:1].isdigit() else version
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        yield ArcRecord(2 if len(names) == 10 else 1, archive, start, fields, body)


# --- synthesised WARC fields --------------------------------------------------------------------


def record_id(archive: str, offset: int) -> str:
    """The same identifier whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str, other: str = "19700101000000") -> str:
    """14 digits, or fewer that are filled up, as ISO time; ``other`` where they are none."""
    d = date if re.fullmatch(r"\d{8}(\d\d){0,3}", date) else other
    d += "000000"[len(d) - 8 :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(body: bytes) -> tuple[bytes, bytes] | None:
    """Head with its empty line, and payload, of an HTTP response; None for any other body."""
    if not re.match(rb"HTTP/\d", body):
        return None
    end = re.search(rb"\r?\n\r?\n", body)
    return (body[: end.end()], body[end.end() :]) if end else (body, b"")


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "surrogateescape").strip() if found else None


def _page(head: bytes) -> int | None:
    named = http_header(head, "X-Page-Id")
    return int(named) if named and re.fullmatch(r"-?\d{1,18}|-?[1-8]\d{18}|-?9[01]\d{17}|-?922\d{16}", named) else None


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line ends that follow it; fields without a value are left out."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogateescape") + block


def to_warc(r: ArcRecord, refers: dict | None, version_date: str) -> bytes:
    """The WARC record that says the same as an ARC record; ``refers`` names the record with the equal payload, if any."""
    date = warc_date(r.fields["Archive-date"], version_date)
    if r.fields["URL"].startswith("filedesc:"):
        block = f"software: parcelwise\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {r.version}\r\n".encode()
        named = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(r.archive, r.offset)), ("WARC-Date", date), ("WARC-Filename", r.archive)]
        return warc_record([*named, ("Content-Type", "application/warc-fields")], block)
    http = http_parts(r.body)
    head, payload = http or (b"", r.body)
    ip = r.fields["IP-address"]
    fields = [
        ("WARC-Type", "revisit" if refers else "response" if http else "resource"), ("WARC-Record-ID", record_id(r.archive, r.offset)),
        ("WARC-Date", date), ("WARC-Target-URI", r.fields["URL"]), ("WARC-IP-Address", None if ip in ("0.0.0.0", "-") else ip),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
    ]
    block = r.body
    if refers:
        block = head
        fields += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers["record"]), ("WARC-Refers-To-Target-URI", refers["uri"]),
            ("WARC-Refers-To-Date", refers["date"]), ("X-Refers-To-Page-Id", None if refers["page_id"] is None else str(refers["page_id"])),
            ("X-Payload-Length", str(len(payload))),
        ]
    kind = "application/http; msgtype=response" if http else r.fields["Content-type"]
    return warc_record([*fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", kind)], block)


# --- conversion ---------------------------------------------------------------------------------


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below ``path``; one is read as a whole, so archives have a bounded size."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


_SEEN = pa.schema([("path", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("record", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("bytes", pa.int64())])
_SEEN_SQL = "path string, at long, page_id long, record string, uri string, date string, payload binary, bytes long"


def _text(value: str) -> str:
    """A header value as valid UTF-8."""
    return value.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _seen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            rows, opened = [], "19700101000000"
            for r in read_arc(content.as_py()):
                if r.fields["URL"].startswith("filedesc:"):
                    opened = r.fields["Archive-date"]
                    continue
                head, payload = http_parts(r.body) or (b"", r.body)
                rows.append({
                    "path": path, "at": r.offset, "page_id": _page(head), "record": record_id(r.archive, r.offset), "uri": _text(r.fields["URL"]),
                    "date": warc_date(r.fields["Archive-date"], opened), "payload": hashlib.sha256(payload).digest(), "bytes": len(payload),
                })
            yield pa.RecordBatch.from_pylist(rows, _SEEN)


def revisits(seen: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(path, at, refers) of the records whose payload another record has, too: ``refers`` is the one with the smallest page_id.

    Null ids come last; of equal ids the first in the written table wins. Payloads are equal when SHA-256 and length
    are. Hot groups are joined by broadcast: of groups with over a thousandth of all records there are fewer than 1,000.
    """
    seen = keep(seen.withColumn("serial", F.monotonically_increasing_id()), "arc-records")
    # id and serial as one number, so that the least of a group is found in a hash aggregate
    order = F.coalesce(F.col("page_id").cast("decimal(19,0)") * F.expr("1000000000000000000BD"), F.expr("10000000000000000000000000000000000000BD")).cast("decimal(38,0)")
    grouped = seen.filter(F.col("bytes") >= least_bytes).groupBy("payload", "bytes")
    groups = grouped.agg(F.count("*").alias("n"), F.min(order + F.col("serial")).alias("least")).filter("n > 1")
    first = groups.withColumn("serial", F.expr("pmod(least, 1000000000000000000BD)").cast("long"))
    first = keep(first.select("payload", "bytes", "n", "serial"), "arc-groups")
    named = first.join(seen.select("serial", F.struct("record", "uri", "date", "page_id").alias("refers")), "serial").withColumnRenamed("serial", "winner")
    named, others = keep(named, "arc-winners"), seen.select("path", "at", "payload", "bytes", "serial")
    total = seen.count()
    hot, rest = F.broadcast(named.filter(F.col("n") * _HOT_SHARE > total)), named.filter(F.col("n") * _HOT_SHARE <= total)
    cool = others.join(hot, ["payload", "bytes"], "left_anti").join(rest, ["payload", "bytes"])
    both = others.join(hot, ["payload", "bytes"]).unionByName(cool)
    return both.filter("serial <> winner").select("path", "at", "refers")


def _converted(files: pa.Table, decided: pa.Table) -> pa.Table:
    refers, pieces, opened = dict(zip(decided["at"].to_pylist(), decided["refers"].to_pylist(), strict=True)), [], "19700101000000"
    for content in files["content"]:
        for r in read_arc(content.as_py()):
            if r.fields["URL"].startswith("filedesc:"):
                opened = r.fields["Archive-date"]
            pieces.append(to_warc(r, refers.get(r.offset), opened))
    return pa.table({"value": pa.array([b"\r\n\r\n".join(pieces)] if pieces else [], pa.binary())})


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Write the ARC archives below ``arc_path`` as WARC 1.1 archives, one for one, to ``warc_path``.

    HTTP responses become ``response`` records, other bodies ``resource``, version blocks ``warcinfo``. A record
    whose payload (of at least ``least_bytes`` bytes) equals that of another becomes ``revisit``: see
    :func:`revisits`. Identifiers follow from the archive's name and the offset, so reruns agree; a date that is
    none is replaced by the archive's. Empty files give none. A truncated record or an unknown header is an error.
    """
    files = archives(spark, arc_path)
    decided = keep(revisits(files.mapInArrow(_seen, _SEEN_SQL), least_bytes), "arc-revisits")
    out = files.groupBy("path").cogroup(decided.groupBy("path")).applyInArrow(_converted, "value binary")
    _write(out, warc_path, "\r\n\r\n")


# --- WARC ---------------------------------------------------------------------------------------


class WarcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]  # names in lower case
    block: bytes


def read_warc(content: bytes) -> Iterator[WarcRecord]:
    """All records of an archive, plain or gzip; blocks by their declared length."""
    file, offset = _opened(content), 0
    while line := file.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start}: {line[:200]!r}")
        fields: dict[str, str] = {}
        while (line := file.readline()).strip():
            offset += len(line)
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        offset += len(line)
        block = _exactly(file, int(fields["content-length"]))
        offset += len(block)
        yield WarcRecord(start, fields, block)


_READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload", pa.binary()),
])
_READ_SQL = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, refers_to_id string, target_uri string, date string, payload binary"
)


def _read(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(r: WarcRecord) -> dict:
        kind, digest = r.fields["warc-type"], r.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        head, payload = http_parts(r.block) or (b"", r.block)
        size = int(r.fields["x-payload-length"]) if kind == "revisit" else len(payload)
        if "warc-block-digest" in r.fields and r.fields["warc-block-digest"] != f"sha1:{sha1_base32(r.block)}":
            raise ValueError(f"block of {r.fields['warc-record-id']} does not have its digest")
        if kind != "revisit" and digest != sha1_base32(payload):
            raise ValueError(f"payload of {r.fields['warc-record-id']} does not have its digest")
        refers = r.fields.get("x-refers-to-page-id")
        return {
            "page_id": _page(head), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": int(refers) if refers else None, "record_id": r.fields["warc-record-id"], "refers_to_id": r.fields.get("warc-refers-to"),
            "target_uri": _text(r.fields.get("warc-target-uri", "")), "date": r.fields.get("warc-date"),
            "payload": payload if payloads and kind != "revisit" else None,
        }

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                yield pa.RecordBatch.from_pylist([row(r) for r in read_warc(content.as_py()) if r.fields["warc-type"] != "warcinfo"], _READ)

    return run


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC archives below ``path`` but for ``warcinfo``; digests are recomputed and must agree.

    ``payload`` is null for revisits, and for all if ``payloads`` is off.
    """
    return archives(spark, path).select("content").mapInArrow(_read(payloads), _READ_SQL)


def archived(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = _ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC back to rows: one of :func:`records` per row of ``pages`` (page_id, url, html).

    Null html is empty, null ids stay null and are never referred to if an equal payload has an id, repeated
    rows are records of their own (all but one revisits), an empty table gives no rows; other columns are not
    read and may have any name.
    """
    spark, run = pages.sparkSession, uuid.uuid4().hex
    arc, warc = scratch_path(spark, f"llm/arc-{run}"), scratch_path(spark, f"llm/warc-{run}")
    write_arc(pages, arc, archive_bytes=archive_bytes)
    convert(spark, arc, warc, least_bytes)
    return records(spark, warc, payloads=False)


def _base32_sql(hexes: str) -> str:
    """Base32 of 40 hexadecimal digits: five digits at a time are four characters of five bits."""
    five = f"list_transform(range(8), lambda k: ('0x' || substr({hexes}, (5 * k + 1)::int, 5))::bigint)"
    return f"array_to_string(list_transform({five}, lambda v: " + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31)::int + 1, 1)" for s in (15, 10, 5, 0)) + "), '')"


SQL = f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as digest from pages),
numbered as (select *, row_number() over (partition by payload order by page_id nulls last) as place, min(page_id) over (partition by payload) as least from p)
select page_id, strlen(payload) as payload_bytes, {_base32_sql('digest')} as payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type, case when place > 1 then least end as refers_to
from numbered
"""
