import base64
import gzip
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc


def archive(entries, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **how) as z:
        for name, data in entries:
            with z.open(name, "w", force_zip64=True) as member:
                member.write(data)
        z.comment = b"PK\x05\x06 in a comment is no end"[4:]
    return out.getvalue()


def test_directories_are_read_from_the_end():
    data = archive([("a.txt", b"hello"), ("dir/b", b"x" * 70000), ("é", b"")])
    file = io.BytesIO(data)
    found = warc.members(file, len(data))
    assert [(m.name, m.method, m.size) for m in found] == [("a.txt", 0, 5), ("dir/b", 0, 70000), ("é", 0, 0)]
    at = warc.stored_at(file, found[1])
    assert data[at : at + 70000] == b"x" * 70000


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = archive([(f"m{i}", bytes([65 + i]) * 200) for i in range(5)])
    assert warc.END64 in data and warc.LOCATOR64 in data
    file = io.BytesIO(data)
    for i, m in enumerate(warc.members(file, len(data))):
        at = warc.stored_at(file, m)
        assert (m.name, data[at : at + m.size]) == (f"m{i}", bytes([65 + i]) * 200)


def test_damaged_files_raise():
    with pytest.raises(ValueError, match="no end"):
        warc.members(io.BytesIO(b"nothing"), 7)
    data = archive([("a", b"1")], compression=zipfile.ZIP_DEFLATED)
    packed = warc.Member("a", 8, 1, 1, 0)
    with pytest.raises(ValueError, match="compressed"):
        warc.stored_at(io.BytesIO(data), packed)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x.example/{i % 7} é", f"<p>{i % 5}</p>") for i in range(40)] + [(50, None, None), (51, "u\r\nv", ""), (52, "u", "é" * 50000), (53, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>0</p>"), (54, "u", None), (0, "again", "<p>0</p>")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(5)


def test_round_trip(spark, pages):
    archives = warc.write_archives(pages, warc.scratch_path(spark, "wacz"))
    records = warc.read_archives(archives).collect()
    rows = pages.collect()
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(first.get(r["html"] or "", r["page_id"]), r["page_id"])
    name = lambda i: f"urn:page:{'null' if i is None else i}"
    want = []
    for r in rows:
        payload, least = (r["html"] or "").encode(), first[r["html"] or ""]
        own = r["page_id"] == least
        want.append((name(r["page_id"]), "response" if own else "revisit", None if own else name(least), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload if own else None))
    got = [(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in records]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = warc.read_archives(warc.write_archives(pages, warc.scratch_path(spark, "wacz"), min_revisit_bytes=9)).collect()
    assert {r["record_type"] for r in small} == {"response"}


def test_archives_are_zip_files_of_gzip_records(spark, pages):
    for r in warc.write_archives(pages, warc.scratch_path(spark, "wacz")).collect():
        fs, path = warc.open_fs(r["archive"])
        with fs.open_input_file(path) as file, zipfile.ZipFile(io.BytesIO(file.read())) as z:
            data, index = z.read(warc.DATA), z.read(warc.INDEX).decode().splitlines()
            assert json.loads(z.read("datapackage.json"))["resources"] and len(index) == r["records"]
            for line in index:
                place = json.loads(line[line.index(" {") + 1 :])
                at, n = int(place["offset"]), int(place["length"])
                assert gzip.decompress(data[at : at + n]).startswith(b"WARC/1.1\r\n")


def test_empty_table_and_damaged_record(spark, pages):
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
    record = warc._record("response", "urn:page:1", "u", b"payload", "A" * 32, None)
    with pytest.raises(ValueError, match="damaged"):
        warc._parse(record, True)


def test_archives_of_bounded_size(spark, pages, monkeypatch):
    write = warc._writer(warc.scratch_path(spark, "wacz"))
    rows = pages.select(F.concat(F.lit("urn:page:"), "page_id").alias("record_id"), "url", F.col("html").alias("payload"), F.lit(None).cast("string").alias("refers_to")).toPandas()
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 10)
    out = pa.Table.from_batches(list(write(iter(pa.Table.from_pandas(rows.dropna(subset="record_id")).to_batches()))))
    assert out["records"].to_pylist() == [10, 10, 10, 10, 6]
