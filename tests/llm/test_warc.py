import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from gridhead.llm import warc
from gridhead.sources.shared import shared_path

PAGES = "page_id long, url string, html string, payload string"


def test_revisits(spark):
    big, edge, small = "é" * 600, "x" * 1000, "x" * 999
    html = {1: big, 2: big, 9: big, 3: edge, 4: edge, 5: small, 6: small, 7: None, 8: ""}
    pages = spark.createDataFrame([(k, None if k == 4 else f"http://h/{k}\r\n", v, "clash") for k, v in html.items()], PAGES)
    got = {r.source_id: r for r in warc.archive_pages(pages.repartition(3)).collect()}
    assert {k: r.refers_to for k, r in got.items()} == {1: 9, 2: 9, 9: None, 3: 4, 4: None, 5: None, 6: None, 7: None, 8: None}
    for k, v in html.items():
        raw = (v or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[k].record_type == ("revisit" if got[k].refers_to else "response")
    assert got[4].target_uri is None and got[3].target_uri == "http://h/3"


def test_null_and_repeated_ids(spark):
    body = "y" * 2000
    pages = spark.createDataFrame([(None, "a", body, ""), (None, "b", body, ""), (5, "c", body, ""), (5, "c", body, "")], PAGES)
    got = sorted((r.source_id or 0, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect())
    assert got == [(0, "revisit", 5)] * 2 + [(5, "response", None)] * 2
    nameless = spark.createDataFrame([(None, "a", body, ""), (None, "b", body, ""), (None, "c", "z" * 3000, "")], PAGES)
    assert [(r.source_id, r.record_type, r.payload_bytes) for r in warc.archive_pages(nameless).orderBy("payload_bytes").collect()] == [(None, "response", 2000)] * 2 + [(None, "response", 3000)]


def test_an_id_with_several_payloads(spark):
    pages = spark.createDataFrame([(7, "a", "p" * 2000, ""), (3, "b", "p" * 2000, ""), (7, "c", "q" * 5000, ""), (2, "d", "q" * 5000, ""), (7, "e", "r", "")], PAGES)
    got = sorted((r.source_id, r.payload_bytes, r.record_type, r.refers_to, r.record_id, r.refers_to_record) for r in warc.archive_pages(pages).collect())
    assert [g[:4] for g in got] == [(2, 5000, "revisit", 7), (3, 2000, "revisit", 7), (7, 1, "response", None), (7, 2000, "response", None), (7, 5000, "response", None)]
    assert len({g[4] for g in got}) == 5 and got[0][5] == got[4][4] and got[1][5] == got[3][4]


def test_a_very_long_page(spark):
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 2, F.expr("repeat('z', 50000000)")).otherwise("z").alias("html"))
    got = sorted((r.source_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages.coalesce(1)).collect())
    assert got == [(0, 50_000_000, "revisit", 1), (1, 50_000_000, "response", None), (2, 1, "response", None)]


def test_only_what_the_manifest_lists_is_read(spark):
    """A repeated task that rolls over at other places leaves no record behind."""
    records = spark.createDataFrame([(i, f"u{i}", bytearray(random.Random(i).randbytes(300))) for i in range(40)], "source_id long, target_uri string, payload binary").coalesce(2)
    folder = shared_path(spark, "warc-test")
    first, second = (warc.write_archives(warc.resolve_revisits(records), folder, roll_bytes=n) for n in (1000, 3000))
    for manifest in (first, second):
        assert sorted(r.source_id for r in warc.read_archives(manifest).collect()) == list(range(40))
    paths = [{r.path for r in m.collect()} for m in (first, second)]
    assert len(paths[0]) > len(paths[1]) and not paths[0] & paths[1]


def test_a_damaged_archive_is_not_read(spark):
    records = spark.createDataFrame([(1, "u", bytearray(b"x" * 5000))], "source_id long, target_uri string, payload binary")
    manifest = warc.write_archives(warc.resolve_revisits(records), shared_path(spark, "warc-test"))
    path = pathlib.Path(manifest.first().path.removeprefix("file:"))
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(manifest).collect()


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).isEmpty()


def test_archives_roll_and_keep_payloads(spark):
    records = spark.createDataFrame([(i, f"u{i}", bytearray(bytes([i % 251]) * (i + 1) + b"\r\n\r\n")) for i in range(300)], "source_id long, target_uri string, payload binary")
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(warc.resolve_revisits(records.coalesce(1)), folder, roll_bytes=5000)
    assert manifest.count() > 3 and sum(r.records for r in manifest.collect()) == 300
    read = {r.source_id: bytes(r.payload) for r in warc.read_archives(manifest, payloads=True).collect()}
    assert read == {i: bytes([i % 251]) * (i + 1) + b"\r\n\r\n" for i in range(300)}
