"""Documents of a web service, by accession: a partitioned read that backs off, keeps failures as rows and resumes.

Each task asks for its own accessions one after the other; what fails for good is a row with an error, so one document never ends
a run of many. ``refresh`` asks only for what its table lacks and appends replies and failures, so that a run that was cut off goes on
where it stopped. The same reader is a data source: ``spark.read.format("filings")`` with the options of ``Service``.

Defined results: an accession is asked for once, however often it is listed; null and blank ones are passed over; replies that are not
JSON are tried again like a network error; client errors other than 429 are final; an empty list gives an empty table.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from causeway.operators.storage import materialize
from causeway.plans.shipping import ship

REPLY = "accession string, reply string, error string, attempts int"
#: Characters of an error body that are kept.
ERROR_CHARS = 200


@dataclass(frozen=True)
class Service:
    """``endpoint`` holds ``{accession}``; waits are ``backoff`` seconds, doubled after each try, and ``pause`` between documents of a task."""

    endpoint: str
    key: str = ""
    key_header: str = "Ocp-Apim-Subscription-Key"
    timeout: float = 60.0
    retries: int = 4
    backoff: float = 2.0
    pause: float = 1.0

    @classmethod
    def of(cls, options: dict[str, str]) -> Service:
        """From the options of a read, whose names are case-insensitive and whose values are texts."""
        given = {k.lower(): v for k, v in options.items()}
        kinds = {"timeout": float, "backoff": float, "pause": float, "retries": int}
        named = {f: given[f.replace("_", "")] for f in cls.__dataclass_fields__ if f.replace("_", "") in given}
        return cls(**{f: kinds.get(f, str)(v) for f, v in named.items()})


def ask(service: Service, accession: str) -> tuple[str | None, str | None, int]:
    """(reply, error, attempts) for one document, one of the first two null."""
    headers = {"Accept": "application/json", "Accept-Encoding": "gzip"} | ({service.key_header: service.key} if service.key else {})
    request = urllib.request.Request(service.endpoint.format(accession=urllib.parse.quote(accession, safe="")), headers=headers)
    said = ""
    for attempt in range(1, service.retries + 2):
        try:
            with urllib.request.urlopen(request, timeout=service.timeout) as answer:
                raw = answer.read()
                body = gzip.decompress(raw) if (answer.headers.get("Content-Encoding") or "").lower() == "gzip" else raw
            text = body.decode("utf-8")
            json.loads(text)
            return text, None, attempt
        except urllib.error.HTTPError as refused:
            said = f"HTTP {refused.code}: {refused.read().decode('utf-8', 'replace')[:ERROR_CHARS]}"
            if refused.code != 429 and refused.code < 500:
                return None, said, attempt
        except (json.JSONDecodeError, UnicodeDecodeError, gzip.BadGzipFile) as unreadable:
            said = f"bad reply: {unreadable}"
        except OSError as failed:  # urllib's errors, timeouts and resets
            said = f"network error: {getattr(failed, 'reason', failed)}"
        if attempt <= service.retries:
            time.sleep(service.backoff * 2 ** (attempt - 1))
    return None, f"{said} (after {service.retries + 1} attempts)", service.retries + 1


def _answers(service: Service, accessions: Iterator[str]) -> Iterator[tuple[str, str | None, str | None, int]]:
    for k, accession in enumerate(accessions):
        if k and service.pause:
            time.sleep(service.pause)
        yield (accession, *ask(service, accession))


def fetch(accessions: DataFrame, service: Service, tasks: int = 4) -> DataFrame:
    """(accession, reply, error, attempts) for the distinct accessions, dealt to ``tasks``: so many requests are open at once.

    Every action on the result asks again; ``refresh`` writes it first.
    """
    ship(accessions.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = (a for batch in batches for a in batch.column(0).to_pylist())
        for row in _answers(service, listed):
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.string()), pa.array([row[2]], pa.string()), pa.array([row[3]], pa.int32())], ["accession", "reply", "error", "attempts"])

    wanted = accessions.select(F.trim("accession").alias("accession")).where("accession <> ''").distinct()
    return wanted.repartition(tasks, "accession").mapInArrow(run, REPLY)


def _table(like: DataFrame, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not be there yet."""
    spark = like.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def refresh(accessions: DataFrame, path: str, service: Service, tasks: int = 4, force: bool = False) -> DataFrame:
    """Fetch what ``path/documents`` lacks (all, with ``force``), append it, and append failures to ``path/failures``.

    Returns (status, n) for requested, cached, fetched and failed. Of several replies of an accession the newest run's counts.
    """
    wanted = materialize(accessions.select(F.trim("accession").alias("accession")).where("accession <> ''").distinct(), "accessions")
    known = _table(wanted, f"{path}/documents", "accession string, reply string, run long").select("accession").distinct()
    todo = wanted if force else wanted.join(known, "accession", "left_anti")
    run = F.lit(time.time_ns())
    got = materialize(fetch(todo, service, tasks), "replies")  # asked for once, whatever is read from it
    got.where("error IS NULL").select("accession", "reply", run.alias("run")).write.mode("append").parquet(f"{path}/documents")
    got.where("error IS NOT NULL").select("accession", "error", "attempts", run.alias("run")).write.mode("append").parquet(f"{path}/failures")
    status = got.select(F.when(F.col("error").isNull(), "fetched").otherwise("failed").alias("status"))
    cached = wanted.join(got.select("accession"), "accession", "left_anti").select(F.lit("cached").alias("status"))
    return status.unionAll(cached).unionAll(wanted.select(F.lit("requested"))).groupBy("status").agg(F.count("*").alias("n"))


def documents(like: DataFrame, path: str) -> DataFrame:
    """(accession, reply): the newest reply of each accession."""
    rows = _table(like, f"{path}/documents", "accession string, reply string, run long")
    return rows.groupBy("accession").agg(F.max_by("reply", "run").alias("reply"))


class _Listed(InputPartition):
    def __init__(self, accessions: list[str]) -> None:
        super().__init__(None)
        self.accessions = accessions


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.service = Service.of(options)
        given = {k.lower(): v for k, v in options.items()}
        self.accessions = list(dict.fromkeys(a.strip() for a in given.get("accessions", "").split(",") if a.strip()))
        self.tasks = max(1, int(given.get("tasks", 4)))

    def partitions(self) -> list[InputPartition]:
        return [_Listed(part) for k in range(self.tasks) if (part := self.accessions[k :: self.tasks])] or [_Listed([])]

    def read(self, partition: _Listed) -> Iterator[tuple]:
        yield from _answers(self.service, iter(partition.accessions))


class Filings(DataSource):
    """``spark.read.format("filings")``: a list of accessions in the option of that name, with commas; longer lists are a table for ``fetch``."""

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return REPLY

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
