"""Maps the star-schema tables onto the incident model, for Spark and, with the same rules, for SQL.

An order is an event, its customer's nation the plant, its priority the cause (``4-NOT SPECIFIED`` plays the provisional one),
a line a consequence, the part's brand a system, its name a component, the supplier's nation a backup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.taxonomy import SQL_TAXONOMY

PROVISIONAL = "NOT SPECIFIED"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_key, event_date, year, status, plant, code, category)."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    plants = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("plant"))
    return orders.join(plants, orders.o_custkey == plants.c_custkey, "left").select(
        F.col("o_orderkey").alias("event_key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.col("o_orderstatus").alias("status"),
        "plant",
        F.substring("o_orderpriority", 1, 1).alias("code"),
        F.substring("o_orderpriority", 3, 40).alias("category"),
    )


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_key, code, category) with provisional ones."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("event_key"), F.substring("o_orderpriority", 1, 1).alias("code"), F.substring("o_orderpriority", 3, 40).alias("category"))


def consequences(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(event_key, outcome, confidence, sure) and the named columns of the line: ``sure`` is the gate at 0.60, in whole hundredths of the discount."""
    li = table(spark, sf_dir, "lineitem")
    f, s, heavy = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity") >= 25
    outcome = (
        F.when((f == "A") & (s == "F"), F.when(heavy, "loss-of-safety-function").otherwise("safety-system-inoperable"))
        .when((f == "A") & (s == "O"), "reactor-trip-or-scram")
        .when((f == "N") & (s == "F"), F.when(heavy, "esf-actuation").otherwise("containment-isolation"))
        .when((f == "N") & (s == "O"), "degraded-not-lost")
        .when((f == "R") & (s == "F"), "ts-violation-only")
        .otherwise("other-or-no-safety-impact")
    )
    return li.select(F.col("l_orderkey").alias("event_key"), outcome.alias("outcome"), (1 - 5 * F.col("l_discount")).alias("confidence"), (F.round(F.col("l_discount") * 100) <= 8).alias("sure"), *more)


def _lines(spark: SparkSession, sf_dir: str, what: str, name: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("event_key"), F.col(what).alias(name)).distinct()


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "p_brand", "system")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "p_name", "component")


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_key")).agg((F.max("l_quantity") * 2).alias("power_level"))


OUTCOME_SQL = """CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN CASE WHEN l_quantity >= 25 THEN 'loss-of-safety-function' ELSE 'safety-system-inoperable' END
            WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'reactor-trip-or-scram'
            WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN CASE WHEN l_quantity >= 25 THEN 'esf-actuation' ELSE 'containment-isolation' END
            WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'degraded-not-lost'
            WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'ts-violation-only' ELSE 'other-or-no-safety-impact' END"""
SQL = f"""
WITH RECURSIVE {SQL_TAXONOMY},
ev AS (SELECT o_orderkey AS event_key, strftime(o_orderdate, '%Y-%m-%d') AS event_date, strftime(o_orderdate, '%Y') AS year, o_orderstatus AS status, n_name AS plant,
       substr(o_orderpriority, 1, 1) AS code, substr(o_orderpriority, 3) AS category
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
con AS (SELECT l_orderkey AS event_key, 1 - 5 * l_discount AS confidence, round(l_discount * 100) <= 8 AS sure,
       {OUTCOME_SQL} AS outcome FROM lineitem),
sys AS (SELECT DISTINCT l_orderkey AS event_key, p_brand AS system FROM lineitem JOIN part ON l_partkey = p_partkey),
comp AS (SELECT DISTINCT l_orderkey AS event_key, p_name AS component FROM lineitem JOIN part ON l_partkey = p_partkey),
cau AS (SELECT event_key, code, category FROM ev),
worst AS (SELECT event_key, arg_max(outcome, w) FILTER (WHERE sure) AS worst, count(*) AS n_consequences, sum(CASE WHEN sure THEN 0 ELSE 1 END) AS n_gated
          FROM (SELECT con.*, severity * 100 - idx AS w FROM con JOIN tax USING (outcome)) GROUP BY event_key),
pow AS (SELECT l_orderkey AS event_key, max(l_quantity) * 2 AS power_level FROM lineitem GROUP BY 1)
"""
