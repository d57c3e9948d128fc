"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a byte of a compressed file is taken for where Spark plans a join. Without it, files of a few MB that
#: hold far more are sent to every executor by way of the driver.
EXPANSION = 16.0
_FACTOR = "spark.sql.sources.fileCompressionFactor"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of this machine, if the session is on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def count_in_full(spark: SparkSession) -> None:
    """Tables count by what their files hold, not by their compressed size, where joins of this session are planned."""
    if float(spark.conf.get(_FACTOR)) < EXPANSION:
        spark.conf.set(_FACTOR, str(EXPANSION))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    count_in_full(spark)
    path = f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in order of ``key``, equal keys in one task.

    They are dealt out by a hash of the key. By the key itself Spark would take the partitions of a union whose sides are dealt by it already,
    and then join small ones of each side on its own, so that rows of one key end in several tasks.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores after it, such that no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and lost executors recompute nothing."""
    return stored(df, new_path(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
            try:
                remove(spark, path)
            except Exception:  # noqa: BLE001  the session may be gone at exit
                return
