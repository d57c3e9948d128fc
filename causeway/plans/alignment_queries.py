"""Catalogue: names resolved against a vocabulary, and extracted records aligned with curated ones, over the star tables.

A record is an order. Its curated nodes are its lines: corrective actions and consequences with the part's name and type, and systems
with the brand as code. What was extracted are the lines with a tax of 2 % or more, with names whose words are turned round or that lost letters,
and now and then another brand.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.functions import fuzzy
from causeway.operators import alignment
from causeway.plans import proxy
from causeway.plans.registry import query

_NAMES = "WITH v AS (SELECT p_name || ' ' || lower(p_type) AS name, min(p_partkey) AS pos FROM part GROUP BY 1), a AS (SELECT DISTINCT lower(p_type) || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' unit ' || p_size ELSE '' END AS asked FROM part)"


def _asked(spark, sf_dir):
    part = proxy.table(spark, sf_dir, "part")
    unit = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" unit "), F.col("p_size").cast("string"))).otherwise("")
    asked = part.select(F.concat(F.lower("p_type"), F.lit(" "), "p_name", unit).alias("asked")).distinct()
    terms = part.groupBy(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name")).agg(F.min("p_partkey").alias("pos"))
    return asked, terms.select("name", F.col("name").alias("code"), "pos")


@query("name_subsets", _NAMES + """, w AS (SELECT asked, list_distinct(string_split(asked, ' ')) AS x FROM a), t AS (SELECT name, pos, list_distinct(string_split(name, ' ')) AS y FROM v)
SELECT w.asked, arg_min(name, pos) AS match, CASE WHEN count(name) > 0 THEN CAST(100 AS DOUBLE) END AS score FROM w LEFT JOIN t ON list_has_all(x, y) OR list_has_all(y, x) GROUP BY w.asked""")
def name_subsets(spark, sf_dir):
    """Names whose words are a term's, in any order, or more, or fewer: a set ratio of 100."""
    asked, terms = _asked(spark, sf_dir)
    return fuzzy.best_matches(asked, "asked", terms, "token_set", 100.0)


@query("fuzzy_resolve")
def fuzzy_resolve(spark, sf_dir):
    """Names by the weighted ratio, letters lost and words turned round."""
    asked, terms = _asked(spark, sf_dir)
    return fuzzy.best_matches(asked.select("asked", F.translate("asked", "e", "").alias("worn")), "worn", terms)


#: The order of a record's lines, whose numbers may repeat.
PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag")


def records(spark, sf_dir):
    """(extracted, curated) nodes."""
    li, part = proxy.table(spark, sf_dir, "lineitem"), proxy.table(spark, sf_dir, "part")
    place = F.row_number().over(Window.partitionBy("record").orderBy(*PLACE)).cast("bigint")
    joined = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("record"), *PLACE, "l_linestatus", F.col("p_brand").alias("brand"), F.concat("p_name", F.lit(" "), "p_type").alias("name"))
    lines = joined.select("record", place.alias("pos"), "l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", "l_tax", "brand", "name")
    kind = F.when(F.col("l_returnflag") == "R", "System").when(F.col("l_returnflag") == "N", "CorrectiveAction").otherwise("Consequence")
    coded = F.col("l_returnflag") == "R"

    def nodes(df, name, brand):
        code = F.when(coded, brand)
        key = F.concat(kind, F.lit(":"), F.coalesce(code, F.translate(name, " ", "-")))
        return df.select("record", "pos", kind.alias("type"), key.alias("match_key"), name.alias("display_name"), code.alias("eiis_code"), (~coded & (F.col("l_linestatus") == "O")).alias("provisional"))

    turned = F.when(F.col("l_suppkey") % 3 == 0, F.array_join(F.reverse(F.split("name", " ")), " ")).when(F.col("l_suppkey") % 3 == 1, F.translate("name", "e", "")).otherwise(F.col("name"))
    other = F.when(F.col("l_quantity") < 10, F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string"))).otherwise(F.col("brand"))
    return nodes(lines.where("l_tax >= 0.02D"), turned, other), nodes(lines, F.col("name"), F.col("brand"))


def coded(spark, sf_dir):
    """The systems alone, and curated corrective actions that nothing was extracted for."""
    pred, gold = records(spark, sf_dir)
    return pred.where("type = 'System'"), gold.where("type <> 'Consequence'")


@query("aligned_nodes")
def aligned_nodes(spark, sf_dir):
    return alignment.align(*records(spark, sf_dir))


@query("prf_fuzzy")
def prf_fuzzy(spark, sf_dir):
    """Precision and recall of each type, systems by code and the others by name."""
    pred, gold = records(spark, sf_dir)
    return alignment.node_scores(pred, gold, alignment.align(pred, gold), ("type",)).select("type", "tp", "pred", "true", "p", "r", "f1")


_CODED = f"""WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}) AS place FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT l_orderkey AS record, place AS pos, CASE WHEN l_returnflag = 'R' THEN 'System' ELSE 'CorrectiveAction' END AS type,
CASE WHEN l_returnflag = 'R' THEN 'System:' || p_brand ELSE 'CorrectiveAction:' || replace(p_name || ' ' || p_type, ' ', '-') END AS key, l_returnflag = 'N' AND l_linestatus = 'O' AS provisional FROM li WHERE l_returnflag <> 'A'),
e AS (SELECT l_orderkey AS record, place AS pos, 'System' AS type, 'System:' || CASE WHEN l_quantity < 10 THEN 'Brand#' || (l_suppkey % 25 + 1) ELSE p_brand END AS key FROM li WHERE l_returnflag = 'R' AND l_tax >= 0.02),
m AS (SELECT record, x.pos AS pred, y.pos AS gold FROM (SELECT record, key, min(pos) AS pos FROM e GROUP BY ALL) x JOIN (SELECT record, key, min(pos) AS pos FROM g WHERE type = 'System' GROUP BY ALL) y USING (record, key))"""


@query("node_lists", _CODED + """ SELECT record, 'spurious' AS side, key, type, false AS excused, false AS unresolved FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.record = e.record AND m.pred = e.pos)
UNION ALL SELECT record, 'missed', key, type, type = 'CorrectiveAction' AND provisional, type = 'System' FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.record = g.record AND m.gold = g.pos)""")
def node_lists(spark, sf_dir):
    pred, gold = coded(spark, sf_dir)
    return alignment.node_lists(pred, gold, alignment.align(pred, gold))


_SCORES = """SELECT {by}, tp, pred, "true", {more}CASE WHEN pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pred END AS p, CASE WHEN "true" = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / "true" END AS r,
CASE WHEN pred + "true" = 0 OR tp = 0 THEN 0.0 ELSE 2.0 * tp / (pred + "true") END AS f1 FROM s"""


@query("record_scores", _CODED + """, s AS (SELECT record, (SELECT count(*) FROM m WHERE m.record = r.record) AS tp, (SELECT count(*) FROM e WHERE e.record = r.record) AS pred,
coalesce(x.excused, 0) AS excused, coalesce(x.n, 0) - coalesce(x.excused, 0) AS "true" FROM (SELECT record FROM g UNION SELECT record FROM e) r LEFT JOIN (SELECT record, count(*) AS n, count(*) FILTER (WHERE type = 'CorrectiveAction' AND provisional) AS excused FROM g GROUP BY record) x USING (record))
""" + _SCORES.format(by="record", more="excused, "))
def record_scores(spark, sf_dir):
    pred, gold = coded(spark, sf_dir)
    return alignment.node_scores(pred, gold, alignment.align(pred, gold))


def _edges(nodes):
    """Each system leads to the one of the next line."""
    ahead = nodes.select("record", (F.col("pos") - 1).alias("pos"), F.col("match_key").alias("dst"))
    return nodes.join(ahead, ["record", "pos"]).select("record", F.col("match_key").alias("src"), F.lit("LEADS_TO").alias("rel"), "dst").distinct()


@query("edge_lists", _CODED + """, ge AS (SELECT DISTINCT a.record, a.key AS src, b.key AS dst FROM g a JOIN g b ON a.record = b.record AND b.pos = a.pos + 1), pe AS (SELECT DISTINCT a.record, a.key AS src, b.key AS dst FROM e a JOIN e b ON a.record = b.record AND b.pos = a.pos + 1)
SELECT *, 'spurious' AS side FROM (SELECT * FROM pe EXCEPT SELECT * FROM ge) UNION ALL SELECT *, 'missed' FROM (SELECT * FROM ge EXCEPT SELECT * FROM pe)""")
def edge_lists(spark, sf_dir):
    pred, gold = coded(spark, sf_dir)
    moved = alignment.aligned_edges(_edges(pred), pred, gold, alignment.align(pred, gold))
    return alignment.edge_lists(moved, _edges(gold)).select("record", "src", "dst", "side")


_SIDES = """WITH g AS (SELECT o_orderkey AS record, o_orderdate AS d, o_orderstatus AS s, o_orderpriority AS c, o_custkey AS u, o_totalprice AS t FROM orders),
e AS (SELECT l_orderkey AS record, min(l_shipdate) AS d, min(l_linestatus) AS s, CASE WHEN max(l_quantity) >= 40 THEN '1-URGENT' ELSE '2-HIGH' END AS c, min(l_suppkey) AS u, count(*) AS n, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY 1)"""
_FIELDS = {
    "event_date": "strftime(e.d, '%Y-%m-%d') = strftime(g.d, '%Y-%m-%d')", "report_date": "strftime(e.d, '%Y') = strftime(g.d, '%Y')", "operating_mode": "CAST(e.n AS VARCHAR) IS NOT DISTINCT FROM CASE WHEN g.u % 7 > 0 THEN CAST(g.u % 7 AS VARCHAR) END",
    "power_level": "e.n = g.u % 8", "status": "e.s = g.s", "revision": "CASE WHEN e.u % 2 = 0 THEN '00' END IS NOT DISTINCT FROM CASE WHEN g.u % 2 = 0 THEN '00' END", "ens_number": "CAST(e.u % 5 AS VARCHAR) = CAST(g.u % 5 AS VARCHAR)", "ens_date": "true", "ens_time": "false",
    "reported_under": "e.f = CASE WHEN g.u % 2 = 0 THEN ['A', 'R'] ELSE ['N'] END", "ssff": "CASE WHEN e.n > 3 THEN 'Y' ELSE 'N' END = CASE WHEN g.u % 3 = 0 THEN 'Y' ELSE 'N' END", "cause": "CASE WHEN substr(g.c, 1, 1) <> '5' THEN e.c = g.c END",
}


@query("field_checks", _SIDES + " UNION ALL ".join(f" SELECT record, '{k}' AS field, {v} AS ok FROM e JOIN g USING (record)" for k, v in _FIELDS.items()))
def field_checks(spark, sf_dir):
    """Headers of orders against what their lines say, field by field."""
    o, li = proxy.table(spark, sf_dir, "orders"), proxy.table(spark, sf_dir, "lineitem")
    u, day = F.col("o_custkey"), lambda c: F.date_format(c, "yyyy-MM-dd")
    word = lambda c: c.cast("string")
    rev = lambda c: F.when(c % 2 == 0, "00")
    code = lambda c: F.struct(F.when(F.left(c, F.lit(1)) == "5", "TBD").otherwise(F.left(c, F.lit(1))).alias("cause_code"), c.alias("category"))
    mode = F.when(u % 7 > 0, word(u % 7))
    own = F.struct(day("o_orderdate").alias("event_date"), F.date_format("o_orderdate", "yyyy").alias("report_date"), mode.alias("operating_mode"), (u % 8).cast("int").alias("power_level"), F.col("o_orderstatus").alias("status"), rev(u).alias("revision"), word(u % 5).alias("ens_number"), F.lit(None).cast("string").alias("ens_date"), F.lit("12:00").alias("ens_time"))
    gold = o.select(F.col("o_orderkey").alias("record"), own.alias("identity"), F.struct(F.when(u % 2 == 0, F.array(F.lit("R"), F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("N"))).alias("reported_under"), F.when(u % 3 == 0, "Y").otherwise("N").alias("ssff")).alias("reporting_basis"), code(F.col("o_orderpriority")).alias("cause"))
    said = li.groupBy(F.col("l_orderkey").alias("record")).agg(F.min("l_shipdate").alias("d"), F.min("l_linestatus").alias("s"), F.max("l_quantity").alias("q"), F.min("l_suppkey").alias("u"), F.count("*").alias("n"), F.collect_list("l_returnflag").alias("f"))
    read = F.struct(day("d").alias("event_date"), F.date_format("d", "yyyy").alias("report_date"), word(F.col("n")).alias("operating_mode"), F.col("n").cast("int").alias("power_level"), F.col("s").alias("status"), rev(F.col("u")).alias("revision"), word(F.col("u") % 5).alias("ens_number"), F.lit(None).cast("string").alias("ens_date"), F.lit(None).cast("string").alias("ens_time"))
    pred = said.select("record", read.alias("identity"), F.struct(F.col("f").alias("reported_under"), F.when(F.col("n") > 3, "Y").otherwise("N").alias("ssff")).alias("reporting_basis"), code(F.when(F.col("q") >= 40, "1-URGENT").otherwise("2-HIGH")).alias("cause"))
    return alignment.field_checks(pred, gold)
