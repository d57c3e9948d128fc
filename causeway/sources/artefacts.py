"""Records as JSON files, one for each, written by a data source with commit and abort, and the table of what was put aside.

Tasks write into folders of their own; committing moves one folder for each task, so neither names nor records pass through the
driver, and a task that is tried again or a job that is aborted leaves nothing behind. Paths are any that Arrow's file systems open
and that driver and executors share.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from causeway.plans.shipping import ship

STAGING = "_staging"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    where, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where, inner.rstrip("/")


def document(row: Row) -> str:
    """The row as indented JSON with sorted keys; maps and structs alike are objects, nulls stay."""
    return json.dumps(row.asDict(recursive=True), sort_keys=True, indent=2, ensure_ascii=False, default=str)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    n: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.name_col, self.overwrite = given["path"], given.get("namecolumn", "ler_number"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        where, base = _opened(self.path)
        folder, n, seen = f"{base}/{STAGING}-{self.job}/{uuid.uuid4().hex}", 0, set()
        for row in rows:
            name = row[self.name_col]
            if name is None or name in seen:
                raise ValueError(f"a record needs a name of its own, not {name!r}")
            seen.add(name)
            if not n:
                where.create_dir(folder, recursive=True)
            with where.open_output_stream(f"{folder}/{urllib.parse.quote(str(name), safe='')}.json") as out:
                out.write(document(row).encode("utf-8"))
            n += 1
        return _Written(folder, n)

    def commit(self, messages: list[_Written | None]) -> None:
        where, base = _opened(self.path)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    where.delete_dir(old.path)
        where.create_dir(base, recursive=True)
        for k, message in enumerate(m for m in messages if m is not None and m.n):
            where.move(message.folder, f"{base}/part-{self.job}-{k:05d}")
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, base = _opened(self.path)
        staging = f"{base}/{STAGING}-{self.job}"
        if where.get_file_info(staging).type == fs.FileType.Directory:
            where.delete_dir(staging)


class RecordFiles(DataSource):
    """``df.write.format("record_files").option("nameColumn", ...).mode("append" or "overwrite").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def write_records(reports: DataFrame, path: str, name: str = "ler_number", overwrite: bool = False) -> None:
    """One JSON file for each report under ``path/part-*/``, read again by ``records.read_reports(spark, f"{path}/part-*/*.json")``.

    Rows of a name are brought together, so a name that several rows have is refused.
    """
    spark = reports.sparkSession
    ship(spark)
    spark.dataSource.register(RecordFiles)
    rows = reports.where(F.col(name).isNotNull()).repartition(name)
    rows.write.format("record_files").option("nameColumn", name).mode("overwrite" if overwrite else "append").save(path)


def quarantine(bad: DataFrame, path: str) -> None:
    """Append (source_file, ler_number, reason, error) of reports put aside to a CSV table with a header."""
    error = F.coalesce(F.left("_corrupt_record", F.lit(200)), F.col("reason"))
    bad.select("source_file", "ler_number", "reason", F.regexp_replace(error, r"\s+", " ").alias("error")).write.mode("append").option("header", True).csv(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("source_file string, ler_number string, reason string, error string").csv(path)
