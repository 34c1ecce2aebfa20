from __future__ import annotations

import gzip
import hashlib
import pathlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from voxspark.llm.warc import archive_pages, pack_record, read_records, runs, unpack_record, write_archives

SCHEMA = "page_id long, url string, html string, payload string, digest string, size int, archive string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "payload", "digest", 1, "archive") for r in rows], SCHEMA).repartition(3)


def pages():
    draw = random.Random(2)
    texts = ["".join(draw.choice("abcdé <>\r\n") for _ in range(size)) for size in (0, 1, 500, 999, 1000, 1500, 40_000, 300_000)]
    rows = [(n, f"http://e.org/{n}", draw.choice(texts)) for n in range(200)]
    rows += [(1000 + n, "http://e.org/same", texts[5]) for n in range(120)]
    rows += [(2000, None, None), (2001, "http://e.org/ü %41\r\nWARC-Type: x", "\r\n\r\n" * 400), (2002, "", "\x00" * 2000)]
    return rows


def expected(rows):
    known = {}
    for page_id, _, html in rows:
        octets = (html or "").encode()
        if len(octets) >= 1000:
            known[octets] = max(known.get(octets, page_id), page_id)
    told = []
    for page_id, _, html in rows:
        octets = (html or "").encode()
        kept = known.get(octets, page_id)
        revisit = kept != page_id
        told.append((page_id, len(octets), hashlib.sha1(octets).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(told)


def test_pages_come_back_and_equal_ones_are_stored_once(spark, tmp_path):
    rows = pages()
    assert sorted(map(tuple, archive_pages(spark, frame(spark, rows), f"file://{tmp_path}/a").collect())) == expected(rows)


def test_selected_records_are_read_by_their_ranges(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/a"
    index = write_archives(frame(spark, rows), folder, archive_bytes=100_000)
    files = {p.name: p.read_bytes() for p in pathlib.Path(f"{tmp_path}/a").iterdir()}
    assert len(files) > 3 and all(name.endswith(".warc.gz") and len(data) <= 200_000 for name, data in files.items())
    for r in index.collect():
        member = files[r.archive][r.offset : r.offset + r.length]
        assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and unpack_record(member).page_id == r.page_id
    assert sum(r.length for r in index.collect()) == sum(map(len, files.values()))
    wanted = index.where((F.col("page_id") % 7 == 0) | F.col("url").isNull())
    got = {r.page_id: (r.url, r.record_type, None if r.payload is None else bytes(r.payload)) for r in read_records(wanted, folder, span_bytes=20_000).collect()}
    kinds = {page_id: kind for page_id, _, _, kind, _ in expected(rows)}
    assert got == {p: (u, kinds[p], (h or "").encode() if kinds[p] == "response" else None) for p, u, h in rows if p % 7 == 0 or u is None}


def test_empty_table_null_ids_and_repeated_rows(spark, tmp_path):
    assert archive_pages(spark, frame(spark, []), f"file://{tmp_path}/none").count() == 0
    long = "long " * 300
    rows = [(None, "u", long), (None, None, None), (3, "u", long), (3, "u", long), (1, "u", long), (None, "v", "other " * 300)]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in archive_pages(spark, frame(spark, rows), f"file://{tmp_path}/odd").collect())
    assert got == [(0, "response", None), (0, "response", None), (0, "revisit", 3), (1, "revisit", 3), (3, "response", None), (3, "response", None)]


def test_damaged_records_are_told():
    payload = b"some payload " * 100
    whole = pack_record(7, "http://e.org/", payload, hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z", 3)
    record = unpack_record(whole)
    assert (record.payload, record.page_id, record.url) == (payload, 7, "http://e.org/")
    with pytest.raises(zlib.error):
        unpack_record(whole[:-9])
    with pytest.raises(ValueError, match="digest"):
        unpack_record(pack_record(7, None, payload, "00" * 20, None, "2000-01-01T00:00:00Z", 3))
    with pytest.raises(ValueError, match="whole"):
        unpack_record(gzip.compress(gzip.decompress(whole)[:-5]))


def test_near_ranges_are_read_together():
    ranges = [(0, 10), (10, 10), (25, 5), (1000, 50), (1050, 100), (1150, 10)]
    assert list(runs(ranges, run_bytes=120, gap_bytes=5)) == [(0, 30, [0, 1, 2]), (1000, 1050, [3]), (1050, 1160, [4, 5])]
    assert list(runs([], 1, 1)) == []
