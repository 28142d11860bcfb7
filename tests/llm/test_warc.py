import hashlib

from plumbline.llm import warc


def test_round_trip(spark, tmp_path):
    big, other = "<p>ü</p>" * 200, "<p>é</p>" * 200
    pages = [(1, "http://a/", big, 1), (7, "http://b/\r\nX: y", big, 1), (7, "http://c/", big, 1), (3, None, other, 1), (4, "http://d/", "short", 1), (5, "http://e/", "short", 1), (6, "u", None, 1), (None, "n", big, 1), (9, "m", "", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha256 int")
    path = warc.write_archive(df, str(tmp_path / "archive"), date="2026-01-02T03:04:05Z")
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = warc.records(spark, path).collect()
    assert len(got) == len(pages)
    for page, own in {(p[0], p[2] or "") for p in pages}:
        data = own.encode()
        rows = [r for r in got if r["page_id"] == page and bytes(r["payload"]) == data]
        assert rows and all(r["payload_digest"] == hashlib.sha1(data).hexdigest() and r["payload_bytes"] == len(data) for r in rows)
    responses = [r for r in got if r["record_type"] == "response"]
    assert sorted((r["page_id"] for r in responses), key=str) == [3, 4, 5, 6, 7, 9]
    assert all(r["refers_to"] == 7 for r in got if r["record_type"] == "revisit") and len(got) - len(responses) == 3
    for r in got:
        head, rest = bytes(r["record"]).split(b"\r\n\r\n", 1)
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert fields[b"WARC-Date"] == b"2026-01-02T03:04:05Z" and fields[b"WARC-Block-Digest"] == b"sha256:" + hashlib.sha256(rest[:length]).hexdigest().encode()
        if r["record_type"] == "response":
            assert rest[:length].split(b"\r\n\r\n", 1)[1] == bytes(r["payload"])


def test_damage_is_found(spark, tmp_path):
    import pytest

    path = warc.write_archive(spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string"), str(tmp_path / "a"))
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "n_bytes", "cast('y' as binary) payload", "sha1").write.parquet(str(tmp_path / "bad"))
    import shutil

    shutil.rmtree(f"{path}/payloads")
    shutil.move(str(tmp_path / "bad"), f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.records(spark, path).collect()


def test_response_of_a_null_id(spark, tmp_path):
    rows = [(None, "", "x" * 1000), (None, None, "x" * 1000), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "", "é" * 300000)]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.records(spark, path).collect()), key=str)
    assert got == [(5, "response", None, 999), (6, "response", None, 999), (7, "response", None, 600000), (None, "response", None, 1000), (None, "revisit", None, 1000)]


def test_empty(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.records(spark, path).count() == 0
