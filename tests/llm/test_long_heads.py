"""WARC heads of any length are read back."""

from __future__ import annotations

import pyarrow as pa

from salespark.llm import warc

URLS = ["data:text/html," + "x" * 70_000, "http://a/?" + "q" * 300_000, "http://b/WARC/1.1", None]


def test_pages_with_very_long_urls_stay(spark):
    pages = spark.createDataFrame([(i, u, "<p>same</p>") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(pages, "long-heads"))
    assert {r["uri"] for r in records.collect()} == set(URLS)
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.page_records(records).collect()}
    assert found == {0: ("response", None), 1: ("revisit", 0), 2: ("revisit", 0), 3: ("revisit", 0)}


def test_plain_file_with_long_heads_and_a_head_without_its_end():
    whole = [warc.record(i, u, b"payload", None, False) for i, u in enumerate(URLS)]
    cut = warc.record(9, "http://c/" + "y" * 100_000, b"payload", None, False)[:90_000] + b"\r\n"
    found = list(warc.salvage(pa.BufferReader(whole[0] + cut + b"".join(whole[1:]))))
    assert [x.head and x.head.get("warc-record-id") for x in found] == ["<urn:page:0>", None, "<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert found[1].end - found[1].start == len(cut)
