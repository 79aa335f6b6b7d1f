import gzip
from collections import Counter
from pathlib import Path

import pytest

from vecframe.llm import warc

LONG = "é<p>" * 200_000
PAGES = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, "x"), (None, "http://b", ""), (5, "http://b", None), (6, "http://c", LONG), (7, "http://c", LONG), (1, "http://a/1", "x")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("hot", [1, 2, 100])
def test_rebuild_gives_back_every_record(spark, hot):
    records = warc.records_of_pages(pages(spark))
    headers, payloads = warc.archive(records)
    again = warc.rebuild(headers, payloads, hot=hot).select(records.columns)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, records.collect()))
    stored = {r.payload: r.n_records for r in payloads.collect()}
    assert stored == {"x": 4, "": 1, LONG: 2}
    assert all(r.payload_digest == warc.sha256(r.payload.encode()) for r in payloads.collect())


def test_names_that_are_taken_and_no_rows(spark):
    records = warc.records_of_pages(pages(spark)).selectExpr("header", "payload", "'mine' AS payload_digest", "1 AS digest_ok", "2 AS shares", "3 AS `a.b`", "4 AS stored_n")
    headers, payloads = warc.archive(records)
    assert {r.payload_digest for r in headers.collect()} == {"mine"}
    again = warc.rebuild(headers, payloads, digest="_payload_digest", hot=2)
    assert Counter(map(tuple, again.select([f"`{c}`" for c in records.columns]).collect())) == Counter(map(tuple, records.collect()))
    headers, payloads = warc.archive(records.limit(0))
    assert warc.rebuild(headers, payloads, digest="_payload_digest").count() == 0


def test_wrong_digests_are_found(spark):
    rows = [("WARC/1.0\r\nWARC-Payload-Digest: sha256:" + "0" * 64 + "\r\n\r\n", "x"), ("WARC/1.0\r\n\r\n", "y")]
    headers, payloads = warc.archive(spark.createDataFrame(rows, "header string, payload string"))
    assert [r.digest_ok for r in headers.orderBy("header").collect()] == [None, False] or {r.digest_ok for r in headers.collect()} == {None, False}
    bad = payloads.selectExpr("payload_digest", "concat(payload, '!') AS payload", "n_records")
    with pytest.raises(Exception, match="bad payload"):
        warc.rebuild(headers, bad).collect()
    with pytest.raises(Exception, match="no payload"):
        warc.rebuild(headers, payloads.limit(0)).collect()


def test_files_round_trip(spark, tmp_path):
    head = b"WARC/1.0\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    bodies = [b"\x00\xff\x80binary\r\n\r\n", b"", b"x" * 100_000, b"WARC/1.0\r\n"]
    rows = [(bytearray(head % (19 + len(b))), bytearray(b)) for b in bodies]
    warc.write_warc(spark.createDataFrame(rows, "header binary, payload binary").coalesce(1), f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w/*.gz").orderBy("offset").collect()
    assert [(bytes(r.header), bytes(r.payload)) for r in got] == [(bytes(a), bytes(b)) for a, b in rows]
    raw = b"".join(bytes(a) + bytes(b) + b"\r\n\r\n" for a, b in rows)
    Path(tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(bytes(a) + bytes(b) + b"\r\n\r\n") for a, b in rows))
    assert [x[2] for x in warc.split_records((tmp_path / "members.warc.gz").read_bytes())] == bodies
    assert [x[2] for x in warc.split_records(raw[:-60])] == bodies[:-1]
    assert list(warc.split_records(b"")) == []


HEAD = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n"


def record(body):
    return HEAD % len(body) + body + b"\r\n\r\n"


BODIES = [b"first", b"second " * 30_000, b"", b"WARC/1.0 third", b"fourth"]


def found(content):
    return [x[2] for x in warc.read_records(content) if x[3] is None], [x[3] for x in warc.read_records(content) if x[3] is not None]


@pytest.mark.parametrize("piece", [1 << 20, 1000, 17])
def test_damage_costs_no_more_than_it_covers(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    members = [gzip.compress(record(b)) for b in BODIES]
    assert found(b"".join(members)) == (BODIES, [])
    assert found(gzip.compress(b"".join(map(record, BODIES)))) == (BODIES, [])
    bad = bytearray(members[1])
    bad[-6] ^= 255  # the checksum
    got, errors = found(b"".join([members[0], bytes(bad), *members[2:]]))
    assert [b for b in got if b != BODIES[1]] == [BODIES[0], *BODIES[2:]] and errors
    bad = bytearray(members[1])
    bad[30] ^= 255
    got, errors = found(b"".join([members[0], bytes(bad), *members[2:]]))
    assert got[0] == BODIES[0] and got[-3:] == BODIES[2:] and errors
    assert found(b"".join(members) + b"junk behind the last member") == (BODIES, ["bytes between gzip members"])
    assert found(b"".join(members) + b"\0" * 50) == (BODIES, [])
    got, errors = found(b"".join(members)[:-10])
    assert got in (BODIES, BODIES[:-1]) and errors


def test_bytes_that_are_no_record():
    plain = list(map(record, BODIES))
    assert found(b"\r\n".join(plain)) == (BODIES, [])
    assert found(plain[0] + b"junk\r\n" + plain[1] + plain[2]) == (BODIES[:3], ["no record"])
    assert found(plain[0] + b"WARC/1.0\r\nno length\r\n\r\n" + plain[1]) == (BODIES[:2], ["no record"])
    assert found(plain[0] + plain[1][:-500]) == (BODIES[:1], ["the record is cut"])
    assert found(b"") == ([], []) and found(b"junk") == ([], ["no record"])
    [a, b] = list(warc.read_records(plain[0] + plain[1]))
    assert (plain[0] + plain[1])[b[0] :].startswith(b[1] + b[2])


def test_reading_damaged_files_and_null_headers(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"one")) + b"\x1f\x8b\x08broken" + gzip.compress(record(b"two")))
    (tmp_path / "b.warc").write_bytes(b"")
    rows = warc.read_warc(spark, f"file://{tmp_path}/*").collect()
    assert sorted(bytes(r.payload) for r in rows if r.error is None) == [b"one", b"two"] and sum(r.error is not None for r in rows) == 1
    warc.write_warc(spark.createDataFrame([(None, None), (None, bytearray(b"x"))], "header binary, payload binary").coalesce(1), f"file://{tmp_path}/w")
    assert all(r.error for r in warc.read_warc(spark, f"file://{tmp_path}/w/*.gz").collect())


def test_append_stores_known_payloads_once(spark):
    first = warc.archive(warc.records_of_pages(pages(spark, PAGES[:4])))
    second = warc.archive(warc.records_of_pages(pages(spark, PAGES[3:])))
    headers, payloads = warc.append(*first, *second)
    stored = [(r.payload, r.n_records) for r in payloads.collect()]
    assert sorted(stored) == sorted([("x", 4), ("", 2), (LONG, 2)])
    whole = warc.records_of_pages(pages(spark, PAGES[:4] + PAGES[3:]))
    assert Counter(map(tuple, warc.rebuild(headers, payloads).select(whole.columns).collect())) == Counter(map(tuple, whole.collect()))
