"""Archives: round trips, every way of cutting a file, chance magics, archives inside archives, and damage."""

import gzip
import hashlib
import io
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docgauge.llm import warc
from docgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def folder():
    return tempfile.mkdtemp(prefix="spark-") + "/archives"


def brute(pages):
    digest = lambda p: hashlib.sha256((p or "").encode()).hexdigest()
    first = {}
    for i, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            first[digest(html)] = min(first.get(digest(html), i), i)
    rows = []
    for i, html in pages:
        to = first.get(digest(html))
        to = None if to == i else to
        rows.append((i, len((html or "").encode()), digest(html), "response" if to is None else "revisit", to))
    return sorted(map(str, rows))


def made(df):
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in df.collect())


def archives(path):
    return sorted(p for p in Path(path).iterdir() if p.name.startswith("part"))


def test_query_equals_brute_force(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert made(QUERIES["op13_warc"](spark, SF)) == brute(pages)


LONG = "<p>" + "words of a page " * 20
ODD = [
    (3, "http://a/1", LONG), (1, None, LONG), (2, "http://a/ b\r\nWARC-Type: evil", LONG), (4, "u", "short"), (5, "u", "short"), (6, "", None), (None, "u", LONG), (None, None, None), (7, "é/漢", "x" * 300_000), (8, "v", "x" * 300_000),
    (9, "u", "é" * 50), (10, "u", "é" * 49 + "a"), (1, None, LONG), (-5, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (None, "w", "y" * 200), (None, "w", "y" * 200),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, PAGES)
    expected = brute([(i, h) for i, _, h in ODD])
    assert made(warc.through_archives(df, folder())) == expected
    clashing = df.select("*", *[F.lit("clash").alias(c) for c in ("payload", "payload_digest", "first", "n", "piece", "value", "refers_to", "record_type", "file", "start")])
    assert made(warc.through_archives(clashing, folder())) == expected
    assert warc.through_archives(df.limit(0), folder()).collect() == []
    path = folder()
    warc.write_archives(warc.with_revisits(df), path)
    found = {r["record_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert found["urn:page:2"]["target_uri"] == "http://a/%20b%0D%0AWARC-Type:%20evil" and found["urn:page:7"]["target_uri"] == "é/漢" and found["urn:page:none"]["target_uri"] in (None, "u", "w")


def test_archives_are_gzip_of_warc(spark):
    """Other readers see one record after another."""
    path = folder()
    warc.write_archives(warc.with_revisits(spark.createDataFrame(ODD, PAGES)).coalesce(1), path)
    whole = gzip.decompress(archives(path)[0].read_bytes())
    heads = [x for x in whole.split(b"WARC/1.1\r\nWARC-Type: ")[1:]]
    assert len(heads) == len(ODD) and all(h.endswith(b"\r\n\r\n") for h in heads)


def _inner(draw):
    """An archive of random payloads, which gzip stores as they are."""
    out = io.BytesIO()
    for k in range(6):
        body = draw.randbytes(draw.randint(0, 900))
        out.write(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:inner:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n", mtime=0))
    return out.getvalue()


def test_ranges_of_any_size_and_magics_inside(spark):
    """Payloads hold the magic, and whole archives, stored without compression; ranges begin inside them."""
    draw = random.Random(3)
    payloads = [b"", b"plain " * 30, draw.randbytes(700), warc.MAGIC * 40 + draw.randbytes(500), _inner(draw), draw.randbytes(300) + _inner(draw) + b"end", warc.EMPTY_MEMBER * 20, draw.randbytes(2000), _inner(draw) * 2]
    rows = [(i, None, f"u{i}", p, hashlib.sha256(p).hexdigest(), len(p)) for i, p in enumerate(payloads)]
    records = spark.createDataFrame(rows, "page_id long, refers_to long, url string, payload binary, payload_digest string, payload_bytes long").coalesce(1)
    path = folder()
    warc.write_archives(records, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    certain = []
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        for size in (211, 300, 997, 2500, 7000, 10**6):
            spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
            found = warc.read_archives(spark, path).collect()
            assert not any(r["error"] for r in found)
            assert {int(r["record_id"].rpartition(":")[2]): bytes(r["payload"]) for r in found} == dict(enumerate(payloads)) and len(found) == len(payloads)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def _record(k, body=b"some text"):
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n"


@pytest.mark.parametrize(
    ("data", "whole", "faults"),
    [
        (gzip.compress(_record(1) + _record(2)) + gzip.compress(_record(3)), [1, 2, 3], 0),  # several records in a member
        (b"garbage" + gzip.compress(_record(1)), [1], 1),
        (gzip.compress(_record(1)) + gzip.compress(_record(2))[:-40] + gzip.compress(_record(3)), [1, 3], 1),  # a member breaks off
        (gzip.compress(_record(1)) + gzip.compress(_record(2))[:-4] + gzip.compress(_record(3)), [1, 2, 3], 1),  # its record is whole, its checksum isn't
        (gzip.compress(_record(1)) + gzip.compress(_record(2))[:40], [1], 1),
        (gzip.compress(_record(1)) + gzip.compress(b"no record") + gzip.compress(_record(3)), [1, 3], 1),
        (gzip.compress(_record(1)) + b"\x1f\x8b\x08 nothing \x1f\x8b\x08" + gzip.compress(_record(3)), [1, 3], 1),
        (gzip.compress(_record(1, b"x" * 9_000_000)), [1], 0),  # unfolds to many times its size
        (b"", [], 0),
        (b"no archive at all", [], 1),
    ],
)
def test_damage(spark, data, whole, faults):
    path = Path(tempfile.mkdtemp(prefix="spark-"))
    (path / "a.warc").write_bytes(data)
    found = warc.read_archives(spark, str(path)).collect()
    assert sorted(int(r["record_id"].rpartition(":")[2]) for r in found if not r["error"]) == whole
    assert sum(bool(r["error"]) for r in found) == faults
