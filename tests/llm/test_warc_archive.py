import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from nearfield.llm.warc_archive import Archive, read_back, write_archive

SCHEMA = "page_id long, url string, html string, record_type string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def plain(rows, least=0):
    first = {}
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        first.setdefault(h or "", (i, u))
    out, seen = [], set()
    for i, u, h in rows:
        body = (h or "").encode()
        lead = first[h or ""] == (i, u) and (h or "") not in seen
        if lead:
            seen.add(h or "")
        response = len(body) < least or lead
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""][0]))
    return sorted(out, key=str)


ROWS = [(5, "http://a/5", "<p>é</p>"), (3, "http://a/3", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "http://a/1", None), (2, "http://a/2\r\nX: y", ""), (4, "u", "long " * 40000), (4, "u", "long " * 40000), (None, "v", "only"), (None, "w", "<p>é</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_records(spark, least):
    archive = write_archive(frame(spark, ROWS), least_bytes=least)
    found = read_back(archive).collect()
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == plain(ROWS, least)
    assert all(r["stated_digest"] == r["payload_digest"] for r in found)
    assert archive.payloads.count() == len({h or "" for _, _, h in ROWS})


def test_bytes_of_records(spark):
    archive = write_archive(frame(spark, ROWS))
    by = {(r["id"], r["url"], r["copy"]): r for r in archive.records().collect()}
    kept = {(r["id"], r["url"], r["copy"]): bytes(r["record"]) for r in archive.records(whole=False).collect()}
    html = {(i, u): h for i, u, h in ROWS}
    for key, r in by.items():
        record = bytes(r["record"])
        head, _, rest = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        assert rest.partition(b"\r\n\r\n")[2] == (html[key[:2]] or "").encode() + b"\r\n\r\n"
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert len(kept[key].partition(b"\r\n\r\n")[2]) == int(lines["Content-Length"]) + 4
        if r["record_type"] == "revisit":
            lead = next(x for x in by.values() if x["record_type"] == "response" and x["address"] == r["address"])
            assert lines["WARC-Refers-To"] in bytes(lead["warc_header"]).decode()
    assert len({dict(x.split(": ", 1) for x in bytes(r["warc_header"]).decode().split("\r\n")[1:-2])["WARC-Record-ID"] for r in by.values()}) == len(ROWS)


def test_many_records_of_one_payload(spark):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own{i}") for i in range(900)]
    archive = write_archive(frame(spark, rows))
    assert archive.crowded.count() == 600 and archive.headers.count() == 300
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_back(archive).collect()), key=str) == plain(rows)


def test_many_copies_of_one_row(spark):
    rows = [(7, "u", "same")] * 700 + [(3, "v", "same"), (8, "w", "other")]
    archive = write_archive(frame(spark, rows))
    assert archive.crowded.count() == 701
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_back(archive).collect()), key=str) == plain(rows)
    assert archive.records().select("id", "url", "copy").distinct().count() == len(rows)


@pytest.mark.parametrize("least", [1, 2])
def test_payloads_of_a_few_hundred_records(spark, least, monkeypatch):
    """Between a crowd and a few: in the buckets, read by salts."""
    monkeypatch.setattr("nearfield.llm.warc_archive.HEAVY", 2)
    rows = [(i, f"u{i}", "same" if i < 300 else f"own{i % 400}") for i in range(900)]
    archive = write_archive(frame(spark, rows), least_bytes=least)
    assert archive.crowded.count() == 0 and archive.headers.where("often").count() == 300
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_back(archive).collect()), key=str) == plain(rows, least)


def test_damage_is_found(spark):
    archive = write_archive(frame(spark, ROWS))
    broken = Archive(archive.headers, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))), archive.crowded)
    with pytest.raises(Exception, match="damaged payload"):
        read_back(broken).collect()


def test_empty(spark):
    assert read_back(write_archive(frame(spark, ROWS).limit(0))).collect() == []
