"""ARC archives of both versions to WARC and back: round trip, odd archives, revisits."""

import base64
import gzip
import hashlib
import random

import pytest

from parcelwise.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, serial string, path string"


def plain(rows):
    first = {}
    for k, (page, _, html) in enumerate(rows):
        key = html or ""
        order = (page is None, page or 0)
        if key not in first or order < first[key][0]:
            first[key] = (order, k)
    out = []
    for k, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = first[html or ""][1]
        out.append((page, len(data), digest, "response" if own == k else "revisit", None if own == k else rows[own][0]))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def rows_of(n, seed):
    rng = random.Random(seed)
    bodies = [None, "", "<p>a</p>", "\r\n\r\nWARC/1.1\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\nin a page", "filedesc://x 0.0.0.0 1 text/plain 3\n", "Ä日🙂", "x" * 3_000_000]
    urls = [None, "", "http://a.example/ x\ty\nz", "https://é.example/ä?q=1 2", "dns:example"]
    return [(rng.choice([k, None, -k, 7, 9223372036854775807, -9223372036854775808]), rng.choice(urls), rng.choice([*bodies[:7], f"own {k}\r\n\r\n"])) for k in range(n)] + [(3, None, bodies[7]), (2, "u", bodies[7])]


@pytest.mark.parametrize("archive_bytes", [1, 2000, 32 << 20])
def test_round_trip_through_both_formats(spark, archive_bytes):
    rows = rows_of(90 if archive_bytes > 1 else 20, archive_bytes)
    got = warc.archived(frame(spark, rows), archive_bytes=archive_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    # of equal ids with equal payloads any one may be the response: rows are compared without their place
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_empty_table_and_least_bytes(spark):
    assert warc.archived(frame(spark, []).limit(0)).count() == 0
    rows = [(1, "u", "long enough"), (2, "u", "long enough"), (3, "u", "s"), (4, "u", "s")]
    got = warc.archived(frame(spark, rows), least_bytes=5)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None)]


def test_hot_payload_group_refers_to_one_record(spark):
    rows = [(k, f"http://h.example/{k}", "copy") for k in range(5, 1500)] + [(k, "u", f"own {k}") for k in range(5)]
    kinds = {r.record_type: r["count"] for r in warc.archived(frame(spark, rows), archive_bytes=5000).groupBy("record_type").count().collect()}
    assert kinds == {"response": 6, "revisit": 1494}


def entry(version, url, body, date="20051231235958", kind="text/html", name="old.arc"):
    return warc.arc_entry(version, name, 0, url, date, kind, body) + b"\n"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", ["plain", "gzip", "gzip by record"])
def test_archives_of_others(spark, tmp_path, version, packed):
    http = b"HTTP/1.0 404 Not Found\nServer: x\n\nGIF89a\x00\xff\xfe\n\nend"
    parts = [
        warc.arc_head(version, "old.arc", "20050101000000"), entry(version, "http://h.example/a", http), entry(version, "dns:h.example", b"h.example 1 IN A 1.2.3.4", kind="text/dns"),
        entry(version, "http://h.example/b", http, date="nonsense"), entry(version, "http://h.example/with space", b"HTTP/1.1 200 OK\r\n\r\n", date="200601020304"),
    ]
    content = b"".join(parts)
    if packed == "gzip":
        content = gzip.compress(content)
    elif packed == "gzip by record":
        content = b"".join(map(gzip.compress, parts))
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc.gz").write_bytes(content)
    (tmp_path / "arc" / "empty.arc").write_bytes(b"")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.target_uri: r for r in warc.records(spark, f"{tmp_path}/warc").collect()}
    payload = b"GIF89a\x00\xff\xfe\n\nend"
    a, b = got["http://h.example/a"], got["http://h.example/b"]
    assert (a.record_type, bytes(a.payload), a.date) == ("response", payload, "2005-12-31T23:59:58Z")
    assert (b.record_type, b.payload, b.refers_to_id, b.payload_bytes, b.date) == ("revisit", None, a.record_id, len(payload), "2005-01-01T00:00:00Z")
    assert a.payload_digest == b.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert got["dns:h.example"].record_type == "resource" and bytes(got["dns:h.example"].payload).startswith(b"h.example 1 IN A")
    assert got["http://h.example/with space"].payload_bytes == 0 and got["http://h.example/with space"].date == "2006-01-02T03:04:00Z"
    assert len(got) == 4


def test_written_archives_are_warc_by_the_letter(spark, tmp_path):
    warc.write_arc(frame(spark, [(1, "http://a.example/", "one"), (2, "http://a.example/", "one")]).coalesce(1), f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    (content,) = [bytes(r.content) for r in warc.archives(spark, f"{tmp_path}/warc").collect()]
    text = gzip.decompress(content)
    assert text.endswith(b"\r\n\r\n") and text.count(b"WARC/1.1\r\n") == 3
    kinds = []
    while text:
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds.append(fields[b"WARC-Type"])
        assert fields[b"WARC-Record-ID"].startswith(b"<urn:uuid:") and fields[b"WARC-Date"].endswith(b"Z")
        if kinds[-1] == b"revisit":
            assert fields[b"WARC-Profile"] == warc.REVISIT_PROFILE.encode() and fields[b"WARC-Refers-To-Target-URI"] == b"http://a.example/"
            assert rest[:n].endswith(b"\r\n\r\n") and b"one" not in rest[:n]
        text = rest[n + 4 :]
    assert sorted(kinds) == [b"response", b"revisit", b"warcinfo"]


@pytest.mark.parametrize("bad", [b"http://a 0.0.0.0 20050101000000 text/html 50\nshort", b"no header at all\n", b"filedesc://x 0.0.0.0 1 text/plain 4\n9 0 \n"])
def test_broken_archives_are_errors(bad):
    with pytest.raises(ValueError):
        list(warc.read_arc(bad))


def test_damaged_warc_is_an_error():
    record = warc.to_warc(next(r for r in warc.read_arc(entry(1, "http://a", b"HTTP/1.1 200 OK\r\n\r\nbody"))), None, "20050101000000") + b"\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc._read(True)(iter([__import__("pyarrow").RecordBatch.from_pydict({"content": [record.replace(b"body", b"bodY")]})])))
