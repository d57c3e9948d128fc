import gzip
from pathlib import Path

from oracle import assert_same, connect

from causeway.llm import archive

PAGES = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c\r\nX", ""), (5, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 200_000), (6, "u", "x" * 200_000), (None, "n", "alone")]


def test_records_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "h", 1) for p in PAGES], "page_id long, url string, html string, header string, payload int")
    path = archive.write_archive(pages, str(tmp_path / "a"))
    rows = archive.parse(archive.records(spark, path)).collect()
    assert sorted(((r.page_id, bytes(r.payload)) for r in rows), key=str) == sorted(((i, (h or "").encode()) for i, _, h in PAGES), key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    rebuilt = [bytes(r.record) for r in archive.records(spark, path).collect()]
    for record in rebuilt:
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block)
    archive.export_warc(spark, path, str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "w").glob("part-*")))
    left = text
    for record in sorted(rebuilt, key=len, reverse=True):
        assert record + b"\r\n\r\n" in left
        left = left.replace(record + b"\r\n\r\n", b"", 1)
    assert left == b""


def test_damage_is_noticed(spark, tmp_path):
    path = archive.write_archive(spark.createDataFrame(PAGES[:1], "page_id long, url string, html string"), str(tmp_path / "a"))
    broken = spark.read.parquet(f"{path}/payloads").selectExpr("payload_sha256", "response_id", "cast('other' as binary) AS payload").collect()
    spark.createDataFrame(broken, "payload_sha256 string, response_id long, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    try:
        archive.index(spark, path).collect()
    except Exception as damage:
        assert "damaged payload" in str(damage)
    else:
        raise AssertionError("damage went unnoticed")


def test_no_pages(spark, tmp_path):
    path = archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert archive.index(spark, path).count() == 0


def test_query(spark, sf_dir):
    assert_same(archive.op5_warc(spark, sf_dir), connect(sf_dir), archive.ORACLE)
