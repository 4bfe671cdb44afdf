import base64
import collections
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from molspark.llm import warc
from molspark.staging import fresh_path
from tests.llm.helpers import FOLDER, prose

SCHEMA = "page_id long, url string, html string"


def pages(spark, data):
    return spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS id", "2 AS payload", "3 AS sha1", "4 AS last", "5 AS record_type")


def data():
    rnd = random.Random(1)
    texts = ["", None, "x", "é" * 50_000, "\r\n\r\nabc", prose(rnd, 20_000), "WARC/1.1\r\n\r\n"]
    out = [(i, rnd.choice(("http://a/é", "http://b\nX: y", None, "")), rnd.choice(texts)) for i in range(60)]
    return out + [(100 + i, "u", prose(rnd, 50)) for i in range(40)] + [(100, "u", out[0][2])]


def expected(rows, least=0):
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        name = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            again = len(payload) >= least and i != last
            out.append((i, len(payload), name, "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    found = warc.archive_round_trip(pages(spark, data()), least)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(data(), least)


def test_nulls_and_repeats(spark):
    rows = [(None, "u", "x"), (None, "u", "y"), (None, "u", "y"), (3, "u", "x"), (3, "u", "x"), (1, "u", "x")]
    found = sorted((tuple(r)[0], r.record_type, r.refers_to) for r in warc.archive_round_trip(pages(spark, rows)).collect() if r.page_id) 
    assert found == [(1, "revisit", 3), (3, "response", None), (3, "response", None)]
    lone = [(r.record_type, r.refers_to) for r in warc.archive_round_trip(pages(spark, rows)).where("page_id IS NULL").collect()]
    assert sorted(lone, key=repr) == [("response", None), ("response", None), ("revisit", 3)]


def test_payloads_and_pushed_predicates(spark):
    folder = fresh_path(spark, "warc-test")
    warc.write_pages(pages(spark, data()), folder)
    whole = warc.read_records(spark, folder)
    texts = {}
    for i, _, h in data():
        texts.setdefault(i, set()).add((h or "").encode())
    for r in whole.where("record_type = 'response'").collect():
        assert bytes(r.payload) in texts[int(r.record_id[10:-1])]
    whole = warc.read_records(spark, folder)
    every = [tuple(r) for r in whole.drop("payload").collect()]
    for test in ("record_type = 'revisit'", "target_uri LIKE 'http://a%'", "record_type IN ('response', 'warcinfo')", "NOT record_type = 'response'", "refers_to IS NULL", "target_uri IS NOT NULL AND record_type <> 'revisit'"):
        names = whole.drop("payload").columns
        wanted = spark.createDataFrame(every, whole.drop("payload").schema).where(test)
        assert sorted(map(tuple, warc.read_records(spark, folder).where(test).select(names).collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_unwanted_payloads_are_not_unpacked(spark, monkeypatch):
    folder = fresh_path(spark, "warc-test")
    warc.write_pages(pages(spark, data()), folder)
    reader = warc.WarcReader({"path": folder, "payload": "true"})
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    monkeypatch.setattr(warc.Records, "block", lambda self: pytest.fail("a block was unpacked"))
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == sum(r[3] == "revisit" for r in expected(data()))


def test_splits_cover_each_record_once(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 2000)
    writer = warc.WarcWriter({"path": fresh_path(spark, "warc-test")})
    import pyarrow as pa
    rows = [{"record_id": f"<urn:page:{i}>", "target_uri": "u", "refers_to": None, "payload_digest": warc.digest(b"x" * i), "payload_length": i, "payload": b"x" * i} for i in range(300)]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)])), None])
    reader = warc.WarcReader({"path": writer._path})
    parts = reader.partitions()
    found = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert len(parts) > 5 and [x["payload_length"] for x in found if x["record_type"] == "response"] == list(range(300))


def test_a_wrong_digest_and_a_cut_record_are_reported(spark):
    packed = warc.pack({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:x"}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert zlib.decompress(packed, 31).endswith(b"body\r\n\r\n")
    with pytest.raises((ValueError, zlib.error)):
        for _, record in warc.Records(io.BytesIO(packed[:-20]), 0, len(packed) - 20):
            record.block()


def test_members_without_length_are_read(spark):
    import gzip
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    both = gzip.compress(raw) + gzip.compress(raw.replace(b"hello", b"again"))
    assert [r.block() for _, r in warc.Records(io.BytesIO(both), 0, len(both))] == [b"hello", b"again"]


def test_files_that_were_never_committed_are_not_read(spark):
    folder = fresh_path(spark, "warc-test")
    warc.write_pages(pages(spark, data()[:10]), folder)
    import pathlib
    root = pathlib.Path(folder.removeprefix("file:"))
    (root / "part-lost.warc.gz").write_bytes(b"half a record")
    assert warc.read_records(spark, folder).where("record_type != 'warcinfo'").count() == 10


def test_empty_and_driver_pages(spark):
    assert warc.archive_round_trip(pages(spark, []).limit(0)).collect() == []
    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = warc.archive_round_trip(table)
    assert sorted(map(tuple, found.collect()), key=repr) == expected([(r.page_id, r.url, r.html) for r in table.collect()])


def test_archives_from_elsewhere(spark):
    """Plain files without a manifest or length fields, with other records, folded over folders."""
    import gzip
    import pathlib
    folder = fresh_path(spark, "foreign")
    root = pathlib.Path(folder.removeprefix("file:"))

    def record(kind, number, body, **more):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body if kind == "response" else body
        headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{number}>", "WARC-Target-URI": f"http://example.org/{number}", **more}
        lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
        return gzip.compress(f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    for part in range(3):
        (root / f"segment{part}").mkdir(parents=True)
        packed = [record("warcinfo", f"i{part}", b"software: other")]
        for k in range(20):
            packed.append(record("request", f"q{part}-{k}", b"GET / HTTP/1.1\r\n\r\n"))
            packed.append(record("response", f"r{part}-{k}", f"<p>page {part} {k}</p>".encode() * 200, **({"WARC-Payload-Digest": "sha1:OTHER"} if k % 2 else {})))
        (root / f"segment{part}" / "a.warc.gz").write_bytes(b"".join(packed))
        (root / f"segment{part}" / "notes.txt").write_text("not an archive")
    assert warc.read_records(spark, folder).rdd.getNumPartitions() == 3
    found = {r.target_uri: bytes(r.payload) for r in warc.read_records(spark, folder).where("record_type = 'response'").collect()}
    assert found == {f"http://example.org/r{p}-{k}": f"<p>page {p} {k}</p>".encode() * 200 for p in range(3) for k in range(20)}
    one = warc.read_records(spark, folder, payload=False).where("target_uri = 'http://example.org/r1-7'").collect()
    assert [(r.record_type, r.payload_digest, r.payload) for r in one] == [("response", "sha1:OTHER", None)]
    assert warc.read_records(spark, folder).count() == 3 * 41
