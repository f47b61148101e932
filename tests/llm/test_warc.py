"""Archives: pages against brute force, predicates, payloads that are skipped, other writers' files."""

import base64
import gzip
import hashlib
import os

import oracle
import pytest
from pyspark.sql import datasource as ds

from docweave.config import DocumentationError
from docweave.llm import queries, warc
from docweave.llm.common import read_table
from helpers import ODD_TEXTS, SF_DIR


def brute(pages):
    first, rows = {}, []
    for key, _, html in pages:
        payload = (html or "").encode()
        known = [k for k in (first.get(payload), key) if k is not None]
        first[payload] = min(known) if known else None
    for key, _, html in pages:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        least = first[payload]
        kind = ("response", None) if key == least else ("revisit", least)
        rows.append((key, len(payload), digest, *kind))
    return sorted(rows, key=repr)


def test_query_against_brute_force(spark):
    pages = list(map(tuple, read_table(spark, SF_DIR, "pages").select("page_id", "url", "html").collect()))
    got = queries.QUERIES["op12_warc"](spark, SF_DIR)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(pages)
    assert oracle.difference(oracle.connect(SF_DIR), got, queries.ORACLES["op12_warc"]) is None


@pytest.mark.parametrize("packed", ["none", "gzip"])
def test_odd_repeated_and_empty_pages(spark, tmp_path, packed):
    pages = [(i, None if i % 3 else "http://a/\r\nWARC-Type: x", text) for i, text in enumerate(ODD_TEXTS)]
    pages += [(2, "u", "same text here"), (None, "u", "same text here"), (None, "u", "alone"), (9, "u", "WARC/1.1\r\n\r\n"),
              (15, "again", "same text here"), (40, "u", "z" * 3_000_000)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for name in ("key", "first", "uses", "cache_key", "salt", "payload", "record_type"):
        table = table.selectExpr("*", f"'x' AS {name}")
    folder = f"{tmp_path}/archive"
    warc.write_warc(warc.page_records(table), folder, compression=packed, file_bytes=4000)
    got = warc.pages_of(spark, folder).selectExpr("bigint(key)", "payload_bytes", "payload_digest", "record_type", "bigint(refers_to)")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(pages)
    whole = warc.read_warc(spark, folder)
    back = {bytes(r["payload"]) for r in whole.where("record_type = 'response'").collect()}
    assert back == {(text or "").encode() for _, _, text in pages}
    assert {r["target_uri"] for r in whole.collect()} <= {None, "u", "again", "http://a/%0D%0AWARC-Type: x"}
    assert whole.where("error IS NOT NULL").isEmpty()
    if packed == "none":  # each record stands where its offset says
        for row in whole.collect():
            with open(row["file"], "rb") as file:
                file.seek(row["offset"])
                assert file.read(8) == b"WARC/1.1"
    empty = f"{tmp_path}/empty"
    warc.write_warc(warc.page_records(table.where("false")), empty)
    assert warc.read_warc(spark, empty).collect() == [] == warc.pages_of(spark, empty).collect()


def test_a_hot_payload_is_dealt_to_tasks(spark):
    pages = [(i, "u", "hot" if i % 3 else f"page {i}") for i in range(900)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records = warc.page_records(table)
        assert records.where("record_type = 'revisit'").count() == 599
        sizes = records.rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 600


def foreign(folder):
    """Records as other tools write them: line feeds, folded and odd-case fields, chunks, requests."""
    http = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabcd\r\n3;x=y\r\nefg\r\n0\r\n\r\n"
    records = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n",
        b"WARC/1.0\nwarc-type: response\nWARC-Target-URI: <http://x/a>\nContent-Type: application/http;\n msgtype=response\ncontent-length: %d\n\n%b\r\n\r\n" % (len(http), http),
        b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Target-URI: http://y/b\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    ]
    with open(f"{folder}/a.warc", "wb") as file:
        file.write(b"".join(records))
    with open(f"{folder}/b.warc.gz", "wb") as file:
        file.write(b"".join(map(gzip.compress, records)))
    with open(f"{folder}/cut.warc", "wb") as file:
        file.write(b"".join(records)[:-70])
    with open(f"{folder}/cut.warc.gz", "wb") as file:
        file.write(gzip.compress(records[0]) + gzip.compress(records[1])[:-20])
    with open(f"{folder}/none.warc", "wb") as file:
        file.write(b"no archive\n")
    return records


def test_archives_of_other_writers(spark, tmp_path):
    foreign(tmp_path)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    by_file = {}
    for row in rows:
        by_file.setdefault(os.path.basename(row["file"]), []).append(row)
    for name in ("a.warc", "b.warc.gz"):
        info, response, request = by_file[name]
        assert (info["record_type"], info["record_id"], bytes(info["payload"])) == ("warcinfo", "urn:uuid:1", b"hello")
        assert (response["target_uri"], response["http_status"], bytes(response["payload"])) == ("http://x/a", 404, b"abcdefg")
        assert response["content_type"] == "application/http; msgtype=response"
        assert (request["record_type"], request["payload_length"]) == ("request", 0)
    assert [r["error"] is None for r in by_file["cut.warc"]][-1] is False
    assert [r["error"] is None for r in by_file["cut.warc.gz"]] == [True, False]
    assert len(by_file["none.warc"]) == 1 and by_file["none.warc"][0]["error"]
    with pytest.raises(DocumentationError):
        warc.WarcReader({"path": "x"}, warc.T.StructType().add("other", "string"))


CONDITIONS = [
    "record_type = 'response'", "record_type IN ('warcinfo', 'request')", "record_type <> 'response'",
    "target_uri LIKE 'http://x%'", "target_uri IS NULL", "content_length > 4 AND content_length <= 5",
    "record_type <=> NULL", "record_type NOT IN ('request')", "record_type = 'request' OR content_length = 5",
    "target_uri LIKE '%b' AND http_status IS NULL", "upper(record_type) = 'REQUEST'",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_pushed_predicates_give_the_same_rows(spark, tmp_path, condition):
    foreign(tmp_path)
    rows = warc.read_warc(spark, str(tmp_path))
    columns = ["file", "offset", "record_type", "payload", "error"]
    kept = spark.createDataFrame(rows.collect(), rows.schema).where(condition).select(*columns)
    wanted = sorted(map(tuple, kept.collect()), key=repr)
    assert sorted(map(tuple, rows.where(condition).select(*columns).collect()), key=repr) == wanted


def test_unwanted_payloads_are_not_read(tmp_path, monkeypatch):
    foreign(tmp_path)
    read = []
    monkeypatch.setattr(warc._Records, "read", lambda self, size: read.append(size) or b"")
    schema = warc.SCHEMA
    narrow = warc.T.StructType([schema["record_type"], schema["payload_length"]])
    for name in ("a.warc", "b.warc.gz"):
        reader = warc.WarcReader({"path": f"{tmp_path}/{name}"}, schema)
        left = list(reader.pushFilters([ds.EqualTo(("record_type",), "request"), ds.EqualTo(("http_status",), 404)]))
        assert left == [ds.EqualTo(("http_status",), 404)]
        assert len(list(reader.rows(f"{tmp_path}/{name}"))) == 1 and read == [0]
        read.clear()
        list(warc.WarcReader({"path": f"{tmp_path}/{name}"}, narrow).rows(f"{tmp_path}/{name}"))
        assert len(read) == 1  # only the chunked body, to know its length
        read.clear()


def test_only_committed_files_count_and_overwrite_replaces(spark, tmp_path):
    folder = str(tmp_path / "archive")
    table = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id bigint, url string, html string")
    warc.write_warc(warc.page_records(table), folder)
    with open(f"{folder}/part-lost.warc", "wb") as file:
        file.write(b"WARC/1.1\r\n left by a lost task")
    assert warc.read_warc(spark, folder).count() == 2
    warc.write_warc(warc.page_records(table.where("page_id = 1")), folder)
    assert warc.read_warc(spark, folder).count() == 3
    more = warc.page_records(table.where("page_id = 2"))
    more.write.format("warc").mode("overwrite").save(folder)
    assert [r["record_id"] for r in warc.read_warc(spark, folder).collect()] == ["urn:page:2"]


def test_files_are_planned_into_partitions(spark, tmp_path):
    for i in range(40):
        with open(f"{tmp_path}/{i:02}.warc", "wb") as file:
            file.write(warc.record_bytes({"record_type": "response", "payload": b"x" * 300_000}))
    reader = warc.WarcReader({"path": str(tmp_path)}, warc.SCHEMA)
    parts = reader.partitions()
    assert sum(len(p.paths) for p in parts) == 40 and 10 <= len(parts) <= 20
    assert warc.read_warc(spark, str(tmp_path), ["payload_length"]).agg({"payload_length": "sum"}).first()[0] == 12_000_000
