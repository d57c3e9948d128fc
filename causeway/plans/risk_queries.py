"""Catalogue: risk layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import risk
from causeway.plans import proxy
from causeway.plans.registry import query

BRAND, COMPONENT = "Brand#12", "gear"

_DIST = """
, e AS ({entity}),
x AS (SELECT e.event_key, worst FROM e LEFT JOIN worst USING (event_key)),
t AS (SELECT count(*) AS n_events, count(worst) AS n_classified FROM x),
c AS (SELECT worst AS outcome, count(*) AS n FROM x WHERE worst IS NOT NULL GROUP BY 1),
m AS (SELECT CAST(sum(n * severity) AS DOUBLE) / sum(n) AS expected_severity, arg_max(outcome, n * 1000 + severity * 100 - idx) AS modal FROM c JOIN tax USING (outcome))
SELECT outcome, CAST(severity AS BIGINT) AS severity, n, CAST(n AS DOUBLE) / n_classified AS p, n_events, n_classified, expected_severity, outcome = modal AS is_modal, n_classified <= 5 AS small_sample
FROM c JOIN tax USING (outcome), t, m"""


def _dist(entity: str) -> str:
    return proxy.SQL + _DIST.format(entity=entity)


@query("likely_outcome_system", _dist(f"SELECT event_key FROM sys WHERE system = '{BRAND}'"))
def likely_outcome_system(spark, sf_dir):
    return risk.distribution(proxy.systems(spark, sf_dir).where(F.col("system") == BRAND), risk.worst_outcomes(proxy.consequences(spark, sf_dir)))


@query("likely_outcome_cause", _dist("SELECT event_key FROM cau WHERE code = '1' AND category <> 'NOT SPECIFIED'"))
def likely_outcome_cause(spark, sf_dir):
    chosen = proxy.causes(spark, sf_dir).where((F.col("code") == "1") & (F.col("category") != proxy.PROVISIONAL))
    return risk.distribution(chosen, risk.worst_outcomes(proxy.consequences(spark, sf_dir)))


@query("likely_outcome_component", _dist(f"SELECT event_key FROM comp WHERE component = (SELECT component FROM comp WHERE contains(lower(component), '{COMPONENT}') GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)"))
def likely_outcome_component(spark, sf_dir):
    named = proxy.components(spark, sf_dir).where(F.lower("component").contains(COMPONENT))
    best = named.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return risk.distribution(named.join(F.broadcast(best), "component"), risk.worst_outcomes(proxy.consequences(spark, sf_dir)))


@query("corpus_outcome_baseline", proxy.SQL + """, x AS (SELECT worst FROM ev LEFT JOIN worst USING (event_key))
SELECT worst AS outcome, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(worst) FROM x) AS p, (SELECT count(*) FROM x) AS n_total, (SELECT count(worst) FROM x) AS n_classified FROM x WHERE worst IS NOT NULL GROUP BY worst""")
def corpus_outcome_baseline(spark, sf_dir):
    all_events = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_key"))
    d = risk.distribution(all_events, risk.worst_outcomes(proxy.consequences(spark, sf_dir)))
    return d.select("outcome", "n", "p", F.col("n_events").alias("n_total"), "n_classified")


@query("event_worst_outcome", proxy.SQL + "SELECT event_key, worst, n_consequences, CAST(n_gated AS BIGINT) AS n_gated FROM worst")
def event_worst_outcome(spark, sf_dir):
    return risk.worst_outcomes(proxy.consequences(spark, sf_dir))


@query("gate_counts", proxy.SQL + "SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN sure THEN 0 ELSE 1 END) AS BIGINT) AS gated, round(avg(confidence), 6) AS avg_conf FROM con GROUP BY outcome")
def gate_counts(spark, sf_dir):
    return proxy.consequences(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.when(F.col("sure"), 0).otherwise(1)).alias("gated"), F.round(F.avg("confidence"), 6).alias("avg_conf"))


_ENT = """, ent AS (SELECT 'System' AS entity_type, system AS entity, event_key FROM sys UNION ALL SELECT 'Component', component, event_key FROM comp UNION ALL SELECT 'Cause', category, event_key FROM cau WHERE category <> 'NOT SPECIFIED'),
st AS (SELECT entity_type, entity, count(*) AS n_events, count(worst) AS n_classified, CAST(coalesce(sum(severity), 0) AS BIGINT) AS mass FROM ent LEFT JOIN worst USING (event_key) LEFT JOIN tax ON outcome = worst GROUP BY ALL)
"""


def entity_events(spark, sf_dir):
    """(entity_type, entity, event_key); systems and components of a line come from one reading of it."""
    li, part = proxy.table(spark, sf_dir, "lineitem"), proxy.table(spark, sf_dir, "part")
    kind = lambda name, c: F.struct(F.lit(name).alias("entity_type"), F.col(c).alias("entity"))
    both = F.explode(F.array(kind("System", "p_brand"), kind("Component", "p_name")))
    parts = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("event_key"), both.alias("e")).select("e.*", "event_key").distinct()
    causes = proxy.causes(spark, sf_dir).where(F.col("category") != proxy.PROVISIONAL)
    return parts.unionAll(causes.select(F.lit("Cause").alias("entity_type"), F.col("category").alias("entity"), "event_key"))


def _stats(spark, sf_dir):
    counts = risk.entity_outcomes(entity_events(spark, sf_dir), risk.worst_outcomes(proxy.consequences(spark, sf_dir)), "entity_type", "entity")
    return counts, risk.stats(counts, "entity_type", "entity")


@query("entity_stats_all", proxy.SQL + _ENT + "SELECT *, CASE WHEN n_classified = 0 THEN 0.0 ELSE CAST(mass AS DOUBLE) / n_classified END AS expected_severity, n_classified <= 5 AS small_sample, CAST(n_classified AS DOUBLE) / n_events AS coverage FROM st")
def entity_stats_all(spark, sf_dir):
    return _stats(spark, sf_dir)[1].drop("modal")


def _rank_sql(kind: str, top: int) -> str:
    return proxy.SQL + _ENT + f""", cl AS (SELECT entity, worst, count(*) AS n FROM ent JOIN worst USING (event_key) WHERE entity_type = '{kind}' AND worst IS NOT NULL GROUP BY ALL),
md AS (SELECT entity, arg_max(worst, n * 1000 + severity * 100 - idx) AS modal FROM cl JOIN tax ON outcome = worst GROUP BY 1)
SELECT row_number() OVER (ORDER BY mass DESC, entity) AS rank, entity, mass, n_classified, CAST(mass AS DOUBLE) / n_classified AS expected_severity, modal
FROM st JOIN md USING (entity) WHERE entity_type = '{kind}' AND n_classified >= 1 ORDER BY mass DESC, entity LIMIT {top}"""


def _rank(spark, sf_dir, rows, top):
    counts = risk.entity_outcomes(rows, risk.worst_outcomes(proxy.consequences(spark, sf_dir)))
    return risk.ranked(risk.stats(counts), top).select("rank", "entity", "mass", "n_classified", "expected_severity", "modal")


@query("risk_ranking_system", _rank_sql("System", 10))
def risk_ranking_system(spark, sf_dir):
    return _rank(spark, sf_dir, proxy.systems(spark, sf_dir).withColumnRenamed("system", "entity"), 10)


@query("risk_ranking_cause", _rank_sql("Cause", 6))
def risk_ranking_cause(spark, sf_dir):
    return _rank(spark, sf_dir, proxy.causes(spark, sf_dir).where(F.col("category") != proxy.PROVISIONAL).withColumnRenamed("category", "entity"), 6)


@query("risk_sensitivity", proxy.SQL + _ENT + """, b AS (SELECT entity, mass AS base FROM st WHERE entity_type = 'System' AND n_classified >= 1 ORDER BY n_classified DESC, entity LIMIT 40),
cl AS (SELECT entity, base, idx, severity, count(*) AS n FROM ent JOIN worst USING (event_key) JOIN b USING (entity) JOIN tax ON outcome = worst WHERE entity_type = 'System' GROUP BY ALL),
w AS (SELECT w, entity, base, sum(n * greatest(1, least(5, severity + (w // (3 ** idx)::BIGINT) % 3 - 1))) AS mass FROM range(6561) r(w), cl GROUP BY ALL),
p AS (SELECT w, row_number() OVER (PARTITION BY w ORDER BY mass DESC, base DESC, entity) AS now, row_number() OVER (PARTITION BY w ORDER BY base DESC, entity) AS was FROM w),
g AS (SELECT w, min(CASE WHEN (now <= 3) <> (was <= 3) THEN 0 ELSE 1 END) AS same, max(CASE WHEN now = 1 AND was = 1 THEN 1 ELSE 0 END) AS first FROM p GROUP BY w)
SELECT count(*) AS n_worlds, avg(same) AS frac_top3_stable, avg(first) AS frac_rank1_stable, avg(same) >= 0.95 AS robust FROM g""")
def risk_sensitivity(spark, sf_dir):
    counts = risk.entity_outcomes(proxy.systems(spark, sf_dir).withColumnRenamed("system", "entity"), risk.worst_outcomes(proxy.consequences(spark, sf_dir)))
    return risk.sensitivity(spark, counts)


@query("small_sample_sparsity", proxy.SQL + """, pk AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) FILTER (WHERE worst IS NOT NULL) AS n FROM lineitem LEFT JOIN worst ON event_key = l_orderkey GROUP BY 1)
SELECT n <= 5 AS small_sample, count(*) AS components FROM pk GROUP BY 1""")
def small_sample_sparsity(spark, sf_dir):
    li = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("event_key"))
    table = risk.stats(risk.entity_outcomes(li, risk.worst_outcomes(proxy.consequences(spark, sf_dir))))
    return table.groupBy("small_sample").agg(F.count("*").alias("components"))


_EC = """, ec0 AS (SELECT entity, cause, count(*) AS n FROM (SELECT DISTINCT {name} AS entity, event_key FROM {tab}) JOIN (SELECT event_key, category AS cause FROM cau WHERE category <> 'NOT SPECIFIED') USING (event_key) GROUP BY ALL),
ec AS (SELECT *, CAST(sum(n) OVER (PARTITION BY entity) AS BIGINT) AS total FROM ec0),
co0 AS (SELECT category AS cause, worst AS outcome, count(*) AS n FROM cau JOIN worst USING (event_key) WHERE category <> 'NOT SPECIFIED' AND worst IS NOT NULL GROUP BY ALL),
co AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cause) AS BIGINT) AS total FROM co0)
"""
_SYS = _EC.format(name="system", tab="sys")


@query("per_event_chains", proxy.SQL + """SELECT event_key, coalesce((SELECT string_agg(system, ',' ORDER BY system) FROM sys WHERE sys.event_key = ev.event_key), '') AS entities, CASE WHEN category <> 'NOT SPECIFIED' THEN category END AS cause, worst FROM ev LEFT JOIN worst USING (event_key)""")
def per_event_chains(spark, sf_dir):
    systems = proxy.systems(spark, sf_dir).withColumnRenamed("system", "entity")
    made = risk.event_chains(proxy.events(spark, sf_dir), systems, risk.coded(proxy.causes(spark, sf_dir), proxy.PROVISIONAL), risk.worst_outcomes(proxy.consequences(spark, sf_dir)))
    return made.withColumn("entities", F.array_join("entities", ","))


@query("transitions_entity_cause", proxy.SQL + _SYS + 'SELECT entity AS "from", cause AS "to", n, total, CAST(n AS DOUBLE) / total AS p FROM ec')
def transitions_entity_cause(spark, sf_dir):
    cause = risk.coded(proxy.causes(spark, sf_dir), proxy.PROVISIONAL)
    return risk.transitions(proxy.systems(spark, sf_dir).join(cause, "event_key"), "system", "cause").withColumnsRenamed({"system": "from", "cause": "to"})


@query("transitions_cause_outcome", proxy.SQL + _SYS + 'SELECT cause AS "from", outcome AS "to", n, total, CAST(n AS DOUBLE) / total AS p FROM co')
def transitions_cause_outcome(spark, sf_dir):
    cause = risk.coded(proxy.causes(spark, sf_dir), proxy.PROVISIONAL)
    worst = risk.worst_outcomes(proxy.consequences(spark, sf_dir)).where("worst IS NOT NULL")
    return risk.transitions(cause.join(worst, "event_key"), "cause", "worst").withColumnsRenamed({"cause": "from", "worst": "to"})


_PATH = """, j AS (SELECT ec.entity, ec.cause, CAST(ec.n AS DOUBLE) / ec.total AS p_cause, co.outcome, CAST(co.n AS DOUBLE) / co.total AS p_outcome, least(ec.n, co.n) AS min_support FROM ec JOIN co USING (cause)),
k AS (SELECT *, round(p_cause * p_outcome, 12) AS joint FROM j)
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY entity ORDER BY joint DESC, outcome, p_cause DESC, cause) = 1"""


def _paths(spark, sf_dir, rows):
    return risk.probable_paths(rows, risk.coded(proxy.causes(spark, sf_dir), proxy.PROVISIONAL), risk.worst_outcomes(proxy.consequences(spark, sf_dir)))


@query("probable_path_system", proxy.SQL + _SYS + _PATH)
def probable_path_system(spark, sf_dir):
    return _paths(spark, sf_dir, proxy.systems(spark, sf_dir).withColumnRenamed("system", "entity"))


@query("probable_path_component", proxy.SQL + _EC.format(name="component", tab="comp") + _PATH)
def probable_path_component(spark, sf_dir):
    return _paths(spark, sf_dir, proxy.components(spark, sf_dir).withColumnRenamed("component", "entity"))
