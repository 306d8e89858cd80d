import base64
import glob
import hashlib
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm.warc import SKIPPABLE, archived, frames, op4, read_archives, read_record, record, write_archives

ROWS = [(3, "http://a/ b", "<p>same</p>", 1), (1, "http://a", "<p>same</p>", 2), (2, None, "<p>other</p>", 3), (5, "u", None, 4), (4, "u", "", 5), (None, "u", "<p>same</p>", 6), (7, "é\r\nX: y", "漢字", 7), (7, "é\r\nX: y", "漢字", 8), (None, "u", "alone", 9), (8, "u", "big " * 400_000, 10)]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_records_read_back():
    row = read_record(record(12, "http://x/y z", b"\r\n\r\nbody\x00", digest(b"\r\n\r\nbody\x00"), None))
    assert row == (12, "http://x/y%20z", 9, digest(b"\r\n\r\nbody\x00"), "response", None, True, b"\r\n\r\nbody\x00")
    row = read_record(record(13, None, b"body", digest(b"body"), 12))
    assert row == (13, None, 4, digest(b"body"), "revisit", 12, True, None)


def test_archives_roll_and_start_with_their_dictionary(tmp_path):
    records = [f"record {i} with the same words again and again, {i * i}".encode() * 20 for i in range(4000)]
    table = list(write_archives(iter(records), f"file://{tmp_path}", roll=30_000))
    assert len(table) > 1 and sum(r[1] for r in table) == 4000
    for path, number, size, dictionary in table:
        raw = open(path.removeprefix("file://"), "rb").read()
        assert len(raw) == size and dictionary > 0 and struct.unpack("<I", raw[:4])[0] == SKIPPABLE
        packed = raw[8 : 8 + struct.unpack("<I", raw[4:8])[0]]
        own = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
        first = zstandard.ZstdDecompressor(dict_data=own).decompressobj().decompress(raw[8 + len(packed) :])
        assert first in records and len(list(frames(path))) == number
    assert [d for r in table for d in frames(r[0])] == records


def dictionary_bytes(path):
    raw = open(path.removeprefix("file://"), "rb").read()
    head = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + struct.unpack("<I", raw[4:8])[0]])
    return zstandard.ZstdCompressionDict(head).as_bytes()


@pytest.mark.parametrize("number", [1, 2, 3, 5, 8, 200])
@pytest.mark.parametrize("body", [b"", b"x", b"<p>some words of a page</p>" * 30, b"\0" * 5000])
def test_every_archive_has_a_dictionary(tmp_path, number, body):
    records = [record(i, None, body, digest(body), None) for i in range(number)]
    [(path, n, _, size)] = write_archives(iter(records), f"file://{tmp_path}")
    assert n == number and size > 0 and len(dictionary_bytes(path)) == size and list(frames(path)) == records


def test_dictionary_of_an_archive_with_a_long_first_record(tmp_path):
    """Samples are spread over the archive: a long first record leaves room for the others."""
    words = [b"<td class='cell wide'>", b"</td></tr>", b"a phrase that every record has"]
    records = [record(0, None, bytes(np.random.RandomState(1).bytes(2_100_000)), "A" * 32, None)]
    records += [record(i, None, b"".join(words) + str(i).encode(), "A" * 32, None) for i in range(1, 5001)]
    [(path, n, _, size)] = write_archives(iter(records), f"file://{tmp_path}")
    assert n == 5001 and size > 0 and words[2] in dictionary_bytes(path) and list(frames(path)) == records
    plain = sum(len(zstandard.compress(r, 3)) for r in records[1:])
    own = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary_bytes(path)))
    assert sum(len(own.compress(r)) for r in records[1:]) < plain / 2


def test_a_record_beyond_the_roll_is_whole(tmp_path):
    records = [b"a" * 10, b"b" * 100_000, b"c" * 10]
    table = list(write_archives(iter(records), f"file://{tmp_path}", roll=1000))
    assert [r[1] for r in table] == [1, 1, 1] and [d for r in table for d in frames(r[0])] == records


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = [(row[0],) for k in range(64) for row in write_archives(iter([record(k, None, b"x", digest(b"x"), None)]), f"file://{tmp_path}")]
    found = read_archives(spark.createDataFrame(rows, "path string"))
    assert found.rdd.getNumPartitions() == 64 and {r["page_id"] for r in found.collect()} == set(range(64))
    parts = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 30


def test_record_ids_are_unique(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, sha1 long")
    paths = [r["path"] for r in archived(pages, f"file://{tmp_path}").collect()]
    heads = [dict(line.split(": ", 1) for line in data.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for p in paths for data in frames(p)]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(ids) == len(ROWS)
    assert {h["WARC-Refers-To"] for h in heads if "WARC-Refers-To" in h} <= {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}


def test_a_payload_of_most_pages(spark):
    """A third of all pages and more share a payload, another third has none."""
    rows = [(i, "u", ("<p>common</p>", None, f"own {i}")[i % 3]) for i in range(3000)]
    found = {r["page_id"]: r for r in read_archives(archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7))).collect()}
    assert len(found) == 3000
    for i in range(3000):
        assert found[i]["refers_to"] == (None if i < 2 or i % 3 == 2 else i % 3)


def test_cut_archive_is_an_error(tmp_path):
    [(path, *_)] = write_archives(iter([b"some record " * 50]), f"file://{tmp_path}")
    raw = open(path.removeprefix("file://"), "rb").read()
    open(path.removeprefix("file://"), "wb").write(raw[:-5])
    with pytest.raises(ValueError):
        list(frames(path))


def test_awkward_rows(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, sha1 long")
    found = read_archives(archived(pages, f"file://{tmp_path}")).collect()
    assert len(found) == len(ROWS) and all(r["intact"] for r in found) and glob.glob(f"{tmp_path}/*.warc.zst")
    want = {(3, "revisit", 1), (1, "response", None), (2, "response", None), (5, "revisit", 4), (4, "response", None), (None, "revisit", 1), (7, "response", None), (None, "response", None), (8, "response", None)}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found} == want
    by = {i: (h or "").encode() for i, _, h, _ in ROWS}
    assert all(r["payload_bytes"] == len(by[r["page_id"]]) and r["payload_digest"] == digest(by[r["page_id"]]) for r in found if r["page_id"])
    assert read_archives(archived(pages.limit(0))).count() == 0


def test_least_payload_of_a_revisit(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, sha1 long")
    kinds = {r["page_id"]: r["record_type"] for r in read_archives(archived(pages, least=5), keep_payload=False).collect()}
    assert kinds[5] == kinds[4] == "response" and kinds[3] == "revisit"


def test_op4(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in op4(spark, sf).collect():
        own = first[pages[r["page_id"]]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(pages[r["page_id"]]), digest(pages[r["page_id"]]))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == r["page_id"] else ("revisit", own))
