"""Documents from a service with faults, record files with commit and abort."""

import gzip
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from causeway.sources import artefacts, fetch, records


@pytest.fixture
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            name = self.path.rsplit("/", 1)[-1]
            asked[name] += 1
            status, body = 200, json.dumps({"document": {"DocketNumber": ["05000277"], "LicenseeEventReport": f"LER 2025-{name}", "DocumentTitle": name, "content": "text é"}}).encode()
            if name == "busy" and asked[name] < 3:
                status, body = 429, b"slow down"
            elif name == "broken" and asked[name] < 2:
                body = b"{not json"
            elif name == "down":
                status, body = 503, b"no"
            elif name == "gone":
                status, body = 404, b"unknown"
            elif self.headers.get("X-Key") != "k":
                status, body = 401, b"who"
            packed = gzip.compress(body) if name == "packed" else body
            self.send_response(status)
            if name == "packed":
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(packed)))
            self.end_headers()
            self.wfile.write(packed)

        def log_message(self, *args):
            pass

    with ThreadingHTTPServer(("127.0.0.1", 0), Handler) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{running.server_port}/docs/{{accession}}", asked
        running.shutdown()


def service(endpoint, **more):
    return fetch.Service(endpoint, **({"key": "k", "key_header": "X-Key", "retries": 3, "backoff": 0.01, "pause": 0.0, "timeout": 5.0} | more))


def test_refresh_resumes(spark, tmp_path, server):
    endpoint, asked = server
    names = ["a", "busy", "broken", "packed", "down", "gone", "a", " a ", "", None]
    listed = spark.createDataFrame([(n,) for n in names], "accession string")
    path = str(tmp_path / "store")
    run = lambda rows, **more: {r.status: r.n for r in fetch.refresh(rows, path, service(endpoint), **more).collect()}
    assert run(listed, tasks=3) == {"requested": 6, "fetched": 4, "failed": 2}
    assert asked == {"a": 1, "busy": 3, "broken": 2, "packed": 1, "down": 4, "gone": 1}
    failures = {r.accession: (r.error, r.attempts) for r in spark.read.parquet(f"{path}/failures").collect()}
    assert failures == {"down": ("HTTP 503: no (after 4 attempts)", 4), "gone": ("HTTP 404: unknown", 1)}
    fields = records.unwrap_documents(fetch.documents(listed, path)).collect()
    assert sorted((r.ler_number, r.content) for r in fields) == [(f"277-2025-{n}", "text é") for n in ("a", "broken", "busy", "packed")]
    before = Counter(asked)
    known = listed.where("accession NOT IN ('down', 'gone')")
    assert run(known) == {"requested": 4, "cached": 4} and asked == before  # nothing is fetched twice
    assert run(known.where("accession = 'a'"), force=True) == {"requested": 1, "fetched": 1} and asked["a"] == 2
    assert fetch.documents(listed, path).count() == 4
    assert run(listed.limit(0)) == {}


def test_failures_that_are_final(server):
    endpoint, _ = server
    assert fetch.ask(service(endpoint, key="wrong"), "a") == (None, "HTTP 401: who", 1)
    reply, error, attempts = fetch.ask(service("http://127.0.0.1:1/{accession}", retries=1), "a")
    assert reply is None and error.startswith("network error") and attempts == 2


def test_data_source(spark, server):
    endpoint, asked = server
    spark.dataSource.register(fetch.Filings)
    read = lambda listed: spark.read.format("filings").options(endpoint=endpoint, key="k", keyHeader="X-Key", backoff="0.01", pause="0", retries="3", tasks="2", accessions=listed).load()
    assert sorted((r.accession, r.error is None, r.attempts) for r in read("a, gone,busy,a").collect()) == [("a", True, 1), ("busy", True, 3), ("gone", False, 1)]
    assert asked["a"] == 1 and read("a,gone,busy").rdd.getNumPartitions() == 2
    assert read("").count() == 0


RECORD = {"ler_number": "1/2 é", "identity": {"plant_name": "North", "unit": 2}, "nodes": [{"id": "l", "type": "LER", "display_name": "n", "properties": {"b": "2", "a": "1"}, "key": "K"}, {"id": "s", "type": "System", "display_name": "s", "properties": {}}], "edges": [{"source": "l", "relation": "INVOLVES", "target": "s"}], "notes": "two\nlines"}


def test_records_come_back(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(30):
        (source / f"{k}.json").write_text(json.dumps(RECORD | {"ler_number": f"{RECORD['ler_number']}{k}"}))
    reports = records.validated(records.read_reports(spark, f"{source}/*.json"))[0].drop("source_file")
    path = str(tmp_path / "out")
    artefacts.write_records(reports, path)
    again = records.read_reports(spark, f"{path}/part-*/*.json").drop("source_file", "_corrupt_record")
    assert {json.dumps(r.asDict(True), sort_keys=True) for r in again.collect()} == {json.dumps(r.asDict(True), sort_keys=True) for r in reports.collect()}
    files = list((tmp_path / "out").rglob("*.json"))
    assert len(files) == 30 and not list((tmp_path / "out").glob("_staging*"))
    keys = list(json.loads(files[0].read_text()))
    assert keys == sorted(keys) and files[0].read_text().startswith("{\n  ")
    artefacts.write_records(reports.limit(3), path)  # appends a second set
    assert len(list((tmp_path / "out").rglob("*.json"))) == 33
    artefacts.write_records(reports.limit(3), path, overwrite=True)
    assert len(list((tmp_path / "out").rglob("*.json"))) == 3


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    twice = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "ler_number string, n int")
    with pytest.raises(Exception, match="name of its own"):
        artefacts.write_records(twice, path)
    assert not list(tmp_path.rglob("*.json"))
    artefacts.write_records(spark.createDataFrame([(None, 1)], "ler_number string, n int"), path)
    assert not list(tmp_path.rglob("*.json"))


def test_quarantine(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "bad.json").write_text("{broken\nover lines, with \"quotes\"")
    (source / "odd.json").write_text(json.dumps(RECORD | {"edges": [{"source": "l", "relation": "INVOLVES", "target": "gone"}]}))
    _, bad = records.validated(records.read_reports(spark, f"{source}/*.json"))
    for _ in range(2):
        artefacts.quarantine(bad, str(tmp_path / "q"))
    got = artefacts.read_quarantine(spark, str(tmp_path / "q"))
    assert {(r.reason, r.n) for r in got.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {("unreadable", 2), ("edge without node", 2)}
    assert {r.error for r in got.where("reason = 'unreadable'").collect()} == {'{broken over lines, with "quotes"'}
