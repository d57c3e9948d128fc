"""Catalogue: faceted frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.functions.text import duration_hours
from causeway.operators import facets, risk
from causeway.operators.facets import FacetQuery, Filter
from causeway.plans import proxy
from causeway.plans.registry import query


def event_facets(spark, sf_dir, needed: set[str]) -> DataFrame:
    """One row per event with the facets that are asked for and no others."""
    ev = proxy.events(spark, sf_dir)
    out = ev.select("event_key", "event_date", F.col("plant").alias("plants"), F.col("year").alias("years"), F.when(F.col("category") != proxy.PROVISIONAL, F.col("category")).alias("causes"))
    sets = {"systems": lambda: proxy.systems(spark, sf_dir).select("event_key", F.concat("system", F.lit(" ["), F.lower(F.regexp_replace("system", "Brand", "b")), F.lit("]")).alias("v")), "components": lambda: proxy.components(spark, sf_dir).withColumnRenamed("component", "v"), "consequence": lambda: proxy.consequences(spark, sf_dir).select("event_key", F.col("outcome").alias("v")), "corrective_actions": lambda: proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_key"), F.concat(F.lit("ship under "), "l_linestatus").alias("v"))}
    for name in sorted(needed & set(sets)):
        values = sets[name]().groupBy("event_key").agg(F.sort_array(F.collect_set("v")).alias(name))
        out = out.join(values, "event_key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if "outcomes" in needed:
        out = out.join(risk.worst_outcomes(proxy.consequences(spark, sf_dir)).select("event_key", F.col("worst").alias("outcomes")), "event_key", "left")
    if "power_level" in needed:
        out = out.join(proxy.power(spark, sf_dir), "event_key", "left")
    return out


def _frequency(spark, sf_dir, q: FacetQuery):
    return facets.frequency(event_facets(spark, sf_dir, q.needed()), q)


_FREQ = """, m AS ({matched}), z AS (SELECT count(*) AS n_matched FROM m)
SELECT value, count(*) AS n, CAST(count(*) AS DOUBLE) / any_value(n_matched) AS share, any_value(n_matched) AS n_matched FROM ({values}) v, z WHERE value IS NOT NULL GROUP BY value"""
_SYSTEM_VALUES = "SELECT event_key, system || ' [' || lower(replace(system, 'Brand', 'b')) || ']' AS value FROM m JOIN sys USING (event_key)"


@query("facet_reverse", proxy.SQL + _FREQ.format(matched="SELECT event_key FROM worst WHERE worst = 'loss-of-safety-function'", values=_SYSTEM_VALUES))
def facet_reverse(spark, sf_dir):
    return _frequency(spark, sf_dir, FacetQuery("systems", (Filter("outcome", "both trains"),)))


@query("facet_compound", proxy.SQL + _FREQ.format(
    matched="SELECT DISTINCT event_key FROM ev JOIN worst USING (event_key) JOIN sys USING (event_key) WHERE category <> 'NOT SPECIFIED' AND contains(lower(category), 'urgent') AND worst = 'reactor-trip-or-scram' AND contains(lower(system), 'brand#2')",
    values="SELECT event_key, component AS value FROM m JOIN comp USING (event_key)"))
def facet_compound(spark, sf_dir):
    return _frequency(spark, sf_dir, FacetQuery("components", facets.usable([{"facet": "cause", "value": "Urgent"}, {"facet": "outcome", "value": "scram"}, {"facet": "system", "value": "brand#2"}, {"facet": "plant", "value": ""}])))


@query("facet_plants", proxy.SQL + _FREQ.format(matched="SELECT event_key, plant FROM ev WHERE contains(lower(category), 'high') AND category <> 'NOT SPECIFIED'", values="SELECT event_key, plant AS value FROM m"))
def facet_plants(spark, sf_dir):
    return _frequency(spark, sf_dir, FacetQuery("plants", (Filter("cause", "high"),)))


@query("facet_numeric", proxy.SQL + _FREQ.format(matched="SELECT event_key FROM pow WHERE power_level >= 90", values=_SYSTEM_VALUES))
def facet_numeric(spark, sf_dir):
    return _frequency(spark, sf_dir, FacetQuery("systems", (Filter("power", " 90% ", "=>"),)))


@query("facet_trend_year", proxy.SQL + "SELECT year, count(*) AS n FROM ev JOIN worst USING (event_key) WHERE worst = 'esf-actuation' GROUP BY year")
def facet_trend_year(spark, sf_dir):
    return _frequency(spark, sf_dir, FacetQuery("years", (Filter("outcome", "esf-actuation"),))).select(F.col("value").alias("year"), "n")


@query("facet_pairs", proxy.SQL + ", m AS (SELECT event_key FROM ev WHERE contains(lower(category), 'low') AND category <> 'NOT SPECIFIED') SELECT x.component AS a, y.component AS b, count(*) AS n FROM m JOIN comp x USING (event_key) JOIN comp y USING (event_key) WHERE x.component < y.component GROUP BY ALL")
def facet_pairs(spark, sf_dir):
    q = FacetQuery("components", (Filter("cause", "low"),))
    return facets.pairs(event_facets(spark, sf_dir, q.needed()), q)


@query("facet_compare", proxy.SQL + """, q(compare_value) AS (VALUES ('Brand#12'), ('Brand#23')),
m AS (SELECT compare_value, event_key, worst FROM q JOIN sys ON system = compare_value LEFT JOIN worst USING (event_key)), z AS (SELECT compare_value, count(*) AS n_matched FROM m GROUP BY 1)
SELECT compare_value, worst AS value, count(*) AS n, any_value(n_matched) AS n_matched FROM m JOIN z USING (compare_value) WHERE worst IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY compare_value ORDER BY count(*) DESC, worst) <= 8""")
def facet_compare(spark, sf_dir):
    q = FacetQuery("outcomes")
    return facets.compare(event_facets(spark, sf_dir, q.needed() | {"systems"}), q, "system", ["Brand#12", "Brand#23"])


@query("facet_empty", "SELECT CAST(0 AS BIGINT) AS n_matched")
def facet_empty(spark, sf_dir):
    q = FacetQuery("systems", (Filter("no_such_facet", "x"),))
    return facets.matched(event_facets(spark, sf_dir, set()), q).agg(F.count("*").alias("n_matched"))


@query("facet_listing", proxy.SQL + "SELECT event_key, left(event_date || ' ' || plant || ' ' || worst, 90) AS text FROM ev JOIN worst USING (event_key) WHERE worst = 'containment-isolation' ORDER BY event_date DESC, event_key LIMIT 25")
def facet_listing(spark, sf_dir):
    q = FacetQuery("outcomes", (Filter("outcome", "PCIV"),))
    found = facets.matched(event_facets(spark, sf_dir, q.needed()), q)
    return found.orderBy(F.desc("event_date"), "event_key").limit(25).select("event_key", F.left(F.concat("event_date", F.lit(" "), "plants", F.lit(" "), "outcomes"), F.lit(90)).alias("text"))


# three spellings of a duration by line number; the longest of an event counts
@query("facet_duration", """SELECT l_orderkey AS event_key, max(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity WHEN l_linenumber % 3 = 1 THEN l_quantity * 24 ELSE (l_quantity + 30) / 60 END) AS duration_hours
FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity) AS l_quantity FROM lineitem) GROUP BY 1 HAVING max(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity WHEN l_linenumber % 3 = 1 THEN l_quantity * 24 ELSE (l_quantity + 30) / 60 END) >= 48""")
def facet_duration(spark, sf_dir):
    n = F.floor("l_quantity").cast("string")
    kind = F.col("l_linenumber") % 3
    text = F.when(kind == 0, F.concat(F.lit("~"), n, F.lit(" hours"))).when(kind == 1, F.concat(F.lit("approx. "), n, F.lit(" days"))).otherwise(F.concat(n, F.lit(" minutes and 30 mins")))
    li = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_key"), text.alias("duration"))
    longest = li.groupBy("event_key").agg(F.max(duration_hours(F.col("duration"))).alias("duration_hours"))
    return longest.where(facets.predicate(Filter("duration", "48", ">=")))


@query("plant_substring_resolve", proxy.SQL + ", q(query) AS (VALUES ('nation_1'), ('ATION_24'), ('nowhere'), ('%')) SELECT query, plant, count(*) AS n_events FROM q JOIN ev ON contains(lower(plant), lower(query)) GROUP BY ALL")
def plant_substring_resolve(spark, sf_dir):
    asked = spark.createDataFrame([("nation_1",), ("ATION_24",), ("nowhere",), ("%",)], "query string")
    counts = proxy.events(spark, sf_dir).groupBy("plant").agg(F.count("*").alias("n_events"))
    return F.broadcast(asked).join(counts, F.lower("plant").contains(F.lower("query"))).select("query", "plant", "n_events")


@query("clarify_candidates", proxy.SQL + """, c AS (SELECT event_key, event_date FROM ev WHERE plant = 'NATION_7' AND event_key IN (SELECT event_key FROM sys WHERE system = 'Brand#12'))
SELECT row_number() OVER (ORDER BY event_date DESC NULLS FIRST, event_key) AS rank, event_key, event_date, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 8 AS overflow FROM c ORDER BY event_date DESC NULLS FIRST, event_key LIMIT 8""")
def clarify_candidates(spark, sf_dir):
    with_system = proxy.systems(spark, sf_dir).where(F.col("system") == "Brand#12")
    found = proxy.events(spark, sf_dir).where(F.col("plant") == "NATION_7").join(with_system, "event_key", "left_semi").select("event_key", "event_date")
    total = found.agg(F.count("*").alias("total"))
    shown = found.orderBy(F.desc_nulls_first("event_date"), "event_key").limit(8)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_first("event_date"), "event_key")).cast("bigint")
    return shown.select(place.alias("rank"), "event_key", "event_date").join(F.broadcast(total)).withColumn("overflow", F.col("total") > 8)
