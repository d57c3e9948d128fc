"""Catalogue: retrieval templates and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.functions.taxonomy import severity, weight
from causeway.operators import graph, retrieval, risk
from causeway.plans import proxy
from causeway.plans.registry import query


@query("node_edge_counts", """SELECT 'node' AS kind, 'LER' AS name, count(*) AS n FROM orders UNION ALL SELECT 'node', 'System', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'node', 'Component', count(DISTINCT p_name) FROM part
UNION ALL SELECT 'edge', 'INVOLVES', count(*) FROM (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) UNION ALL SELECT 'edge', 'HAS_CAUSE', count(*) FROM orders""")
def node_edge_counts(spark, sf_dir):
    part, orders = proxy.table(spark, sf_dir, "part"), proxy.table(spark, sf_dir, "orders")
    row = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
    parts = [row(orders, "node", "LER"), row(part.select("p_brand").distinct(), "node", "System"), row(part.select("p_name").distinct(), "node", "Component"), row(proxy.systems(spark, sf_dir), "edge", "INVOLVES"), row(orders, "edge", "HAS_CAUSE")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("cause_distribution", proxy.SQL + "SELECT category, code, count(*) AS n FROM cau GROUP BY ALL")
def cause_distribution(spark, sf_dir):
    return proxy.causes(spark, sf_dir).groupBy("category", "code").agg(F.count("*").alias("n"))


@query("weak_program_events", proxy.SQL + "SELECT event_key, category FROM cau WHERE code = '1'")
def weak_program_events(spark, sf_dir):
    return proxy.causes(spark, sf_dir).where(F.col("code") == "1").select("event_key", "category")


@query("system_components", proxy.SQL + "SELECT component, event_key, plant FROM comp JOIN ev USING (event_key) WHERE event_key IN (SELECT event_key FROM sys WHERE system = 'Brand#3')")
def system_components(spark, sf_dir):
    with_system = proxy.systems(spark, sf_dir).where(F.col("system") == "Brand#3")
    inside = proxy.components(spark, sf_dir).join(with_system, "event_key", "left_semi")
    return inside.join(proxy.events(spark, sf_dir), "event_key").select("component", "event_key", "plant")


@query("system_failure_modes", proxy.SQL + """SELECT outcome AS mode, count(*) AS n_events, string_agg(CAST(event_key AS VARCHAR), ',' ORDER BY event_key) AS events
FROM (SELECT DISTINCT outcome, event_key FROM con WHERE sure AND event_key IN (SELECT event_key FROM sys WHERE system = 'Brand#14')) GROUP BY outcome""")
def system_failure_modes(spark, sf_dir):
    with_system = proxy.systems(spark, sf_dir).where(F.col("system") == "Brand#14")
    rows = proxy.consequences(spark, sf_dir).where("sure").join(with_system, "event_key", "left_semi").select("outcome", "event_key").distinct()
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("event_key")), lambda x: x.cast("string")), ",")
    return rows.groupBy(F.col("outcome").alias("mode")).agg(F.count("*").alias("n_events"), joined.alias("events"))


_BACKUP = """, bk AS (SELECT DISTINCT l_orderkey AS event_key, n_name AS backup FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@query("mitigating_backups", proxy.SQL + _BACKUP + """SELECT w.event_key, worst AS consequence, string_agg(backup, ',' ORDER BY backup) AS backups FROM worst w JOIN ev USING (event_key) JOIN bk USING (event_key)
WHERE worst = 'loss-of-safety-function' AND backup <> plant GROUP BY ALL""")
def mitigating_backups(spark, sf_dir):
    li, supplier, nation = (proxy.table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation"))
    where = supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", F.col("n_name").alias("backup"))
    backup = li.join(where, li.l_suppkey == where.s_suppkey).select(F.col("l_orderkey").alias("event_key"), "backup").distinct()
    worst = risk.worst_outcomes(proxy.consequences(spark, sf_dir)).where("worst = 'loss-of-safety-function'")
    rows = worst.join(proxy.events(spark, sf_dir).select("event_key", "plant"), "event_key").join(backup, "event_key").where("backup <> plant")
    return rows.groupBy("event_key", F.col("worst").alias("consequence")).agg(F.array_join(F.sort_array(F.collect_set("backup")), ",").alias("backups"))


@query("shared_component_cause", proxy.SQL + """, k AS (SELECT DISTINCT l_orderkey AS event_key, l_partkey AS component FROM lineitem), r AS (SELECT event_key, component, category AS cause, plant FROM k JOIN ev USING (event_key) WHERE category <> 'NOT SPECIFIED')
SELECT x.component, x.cause, count(*) AS n_links FROM r x JOIN r y ON x.component = y.component AND x.cause = y.cause AND x.event_key < y.event_key AND x.plant <> y.plant GROUP BY ALL""")
def shared_component_cause(spark, sf_dir):
    li = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_key"), F.col("l_partkey").alias("component")).distinct()
    ev = proxy.events(spark, sf_dir).where(F.col("category") != proxy.PROVISIONAL).select("event_key", "plant", F.col("category").alias("cause"))
    rows = li.join(ev, "event_key").where("plant IS NOT NULL")
    return retrieval.shared_classes(rows, ["component", "cause"], "plant").select("component", "cause", "n_links")


@query("vocabulary", proxy.SQL + "SELECT 'system' AS kind, p_brand AS code, p_brand AS name FROM part GROUP BY ALL UNION ALL SELECT 'cause', code, category FROM cau GROUP BY ALL")
def vocabulary(spark, sf_dir):
    brands = proxy.table(spark, sf_dir, "part").select(F.lit("system").alias("kind"), F.col("p_brand").alias("code"), F.col("p_brand").alias("name")).distinct()
    return brands.unionAll(proxy.causes(spark, sf_dir).select(F.lit("cause").alias("kind"), "code", F.col("category").alias("name")).distinct())


def _turns(spark, sf_dir):
    c = proxy.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    edges = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("src"), (F.col("turn") + 1).alias("dst"))
    there = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("dst"))
    return c, edges.join(there, ["doc", "dst"]).select("doc", "src", "dst")


_CHAIN = """WITH RECURSIVE e AS (SELECT a.conv_id AS doc, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
reach(doc, origin, node, path, hops) AS (SELECT conv_id, turn, turn, CAST(turn AS VARCHAR), 0 FROM conversations WHERE role = 'user'
 UNION ALL SELECT r.doc, r.origin, e.dst, r.path || '>' || e.dst, r.hops + 1 FROM reach r JOIN e ON e.doc = r.doc AND e.src = r.node),
p AS (SELECT DISTINCT reach.doc, origin, node AS target, path, CAST(hops AS BIGINT) AS hops FROM reach JOIN conversations c ON c.conv_id = reach.doc AND c.turn = node WHERE role = 'assistant')
"""


def _chain_paths(spark, sf_dir):
    c, edges = _turns(spark, sf_dir)
    starts = c.where("role = 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("node"))
    ends = c.where("role = 'assistant'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("node"))
    found = graph.chains(edges, starts).join(ends, ["doc", "node"])
    joined = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return found.select("doc", "origin", F.col("node").alias("target"), joined.alias("path"), F.col("hops").cast("bigint").alias("hops"))


@query("failure_chain_paths", _CHAIN + "SELECT * FROM p")
def failure_chain_paths(spark, sf_dir):
    return _chain_paths(spark, sf_dir)


@query("longest_chain", _CHAIN + "SELECT doc, target, path, hops FROM p QUALIFY row_number() OVER (PARTITION BY doc, target ORDER BY hops DESC, path) = 1")
def longest_chain(spark, sf_dir):
    return graph.longest(_chain_paths(spark, sf_dir), "doc", "target").select("doc", "target", "path", "hops")


@query("unpinned_chain_contrast", """WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem), e AS (SELECT DISTINCT a.l_orderkey AS doc, a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.place = a.place + 1),
s AS (SELECT l_orderkey AS doc, l_partkey AS node FROM l WHERE place = 1), p(doc, node) AS (SELECT doc, node FROM s UNION SELECT e.doc, e.dst FROM p JOIN e ON e.doc = p.doc AND e.src = p.node),
f(node) AS (SELECT node FROM s WHERE doc = (SELECT min(doc) FROM s) UNION SELECT e.dst FROM f JOIN e ON e.src = f.node) SELECT (SELECT count(*) FROM p) AS pinned_n, (SELECT count(*) FROM p WHERE doc = (SELECT min(doc) FROM s)) AS one_n, (SELECT count(*) FROM f) AS unpinned_n""")
def unpinned_chain_contrast(spark, sf_dir):
    """Parts reached from each order's first line along its own lines, from one order's, and from that one along the lines of all orders."""
    li = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("node"), "l_linenumber")
    order = Window.partitionBy("doc").orderBy("l_linenumber", "node")
    placed = li.withColumn("dst", F.lead("node").over(order)).withColumn("place", F.row_number().over(order))
    edges = placed.where("dst IS NOT NULL").select("doc", F.col("node").alias("src"), "dst").distinct()
    starts = placed.where("place = 1").select("doc", "node")
    first = starts.agg(F.min("doc")).first()[0]
    n = lambda df, name: df.agg(F.count("*").alias(name))
    pinned, one, free = graph.reached(edges, starts), graph.reached(edges, starts, first), graph.free_reached(edges, starts.where(F.col("doc") == first))
    return n(pinned, "pinned_n").join(F.broadcast(n(one, "one_n"))).join(F.broadcast(n(free, "unpinned_n")))


@query("longest_free_path", """WITH RECURSIVE t AS (SELECT conv_id, turn, 'turn:' || conv_id || ':' || turn AS node FROM conversations), e AS (SELECT a.node AS src, b.node AS dst FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
r(origin, node, path, hops) AS (SELECT node, node, node, 0 FROM t WHERE node LIKE 'turn:1%' AND turn = 0 UNION ALL SELECT r.origin, e.dst, r.path || '>' || e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node)
SELECT path, CAST(hops AS BIGINT) AS hops FROM r ORDER BY hops DESC, path LIMIT 1""")
def longest_free_path(spark, sf_dir):
    """The longest path from any first turn whose key has a prefix, whichever documents it runs through."""
    c, edges = _turns(spark, sf_dir)
    name = lambda turn: F.concat(F.lit("turn:"), F.col("doc").cast("string"), F.lit(":"), F.col(turn).cast("string"))
    starts = c.where("turn = 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("node")).select("doc", name("node").alias("node"))
    found = graph.longest_free(edges.select("doc", name("src").alias("src"), name("dst").alias("dst")), starts, "turn:1")
    return found.select(F.array_join("path", ">").alias("path"), F.col("hops").cast("bigint").alias("hops"))


_GEO = "SELECT 'nation:' || n_nationkey AS src, 'PART_OF' AS rel, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'OCCURRED_AT', 'nation:' || s_nationkey FROM supplier"


def _geo(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    n = proxy.table(spark, sf_dir, "nation").select(name("nation", "n_nationkey").alias("src"), F.lit("PART_OF").alias("rel"), name("region", "n_regionkey").alias("dst"))
    s = proxy.table(spark, sf_dir, "supplier").select(name("supplier", "s_suppkey").alias("src"), F.lit("OCCURRED_AT").alias("rel"), name("nation", "s_nationkey").alias("dst"))
    return n.unionAll(s).withColumn("ler_number", F.lit("all"))


@query("khop_neighborhood", f"""WITH e AS ({_GEO}), n AS (SELECT row_number() OVER () AS id, * FROM e), s AS (SELECT id, src, rel, dst FROM n UNION ALL SELECT id, dst, rel, src FROM n)
SELECT 'nation:3' AS anchor, CAST(1 AS BIGINT) AS hop, dst AS neighbor, rel FROM s WHERE src = 'nation:3' UNION SELECT 'nation:3', 2, b.dst, b.rel FROM s a JOIN s b ON a.dst = b.src AND a.id <> b.id WHERE a.src = 'nation:3' AND b.dst <> 'nation:3'""")
def khop_neighborhood(spark, sf_dir):
    return graph.neighbourhood(_geo(spark, sf_dir), "nation:3")


@query("hub_subgraph_topn", proxy.SQL + """, w AS (SELECT event_key, arg_max(outcome, severity * 100 - idx) AS o FROM con JOIN tax USING (outcome) GROUP BY 1),
h AS (SELECT event_key, CAST(severity AS BIGINT) AS severity, event_date FROM sys JOIN ev USING (event_key) LEFT JOIN w USING (event_key) LEFT JOIN tax ON outcome = o WHERE system = 'Brand#12')
SELECT row_number() OVER (ORDER BY severity DESC, event_date DESC, event_key) AS rank, event_key, severity, event_date, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) - 20 AS hidden FROM h ORDER BY severity DESC, event_date DESC, event_key LIMIT 20""")
def hub_subgraph_topn(spark, sf_dir):
    # the hub view takes the worst class of all, gated or not
    any_worst = proxy.consequences(spark, sf_dir).groupBy("event_key").agg(F.max_by("outcome", weight(F.col("outcome"))).alias("worst"))
    spokes = proxy.systems(spark, sf_dir).where(F.col("system") == "Brand#12").join(proxy.events(spark, sf_dir), "event_key").join(any_worst, "event_key", "left")
    rows = spokes.select("event_key", severity(F.col("worst")).cast("bigint").alias("severity"), "event_date")
    order = [F.desc("severity"), F.desc("event_date"), F.asc("event_key")]
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return shown.join(F.broadcast(total)).select("rank", "event_key", "severity", "event_date", "total", F.greatest(F.col("total") - 20, F.lit(0)).alias("hidden"))


@query("event_subgraph_edges", """SELECT DISTINCT 'turn:' || a.turn AS src, CASE WHEN b.role = 'assistant' THEN 'LEADS_TO' ELSE 'FOLLOWED_BY' END AS rel, 'turn:' || b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.conv_id = 7
UNION SELECT 'event:7', 'HAS_CAUSE', 'turn:0' FROM conversations WHERE conv_id = 7""")
def event_subgraph_edges(spark, sf_dir):
    c = proxy.table(spark, sf_dir, "conversations").where("conv_id = 7").select("conv_id", "turn", "role")
    ahead = Window.partitionBy("conv_id").orderBy("turn")
    steps = c.withColumn("next", F.lead("turn").over(ahead)).withColumn("kind", F.lead("role").over(ahead)).where("next IS NOT NULL")
    turn = lambda x: F.concat(F.lit("turn:"), F.col(x).cast("string"))
    edges = steps.select(turn("turn").alias("src"), F.when(F.col("kind") == "assistant", "LEADS_TO").otherwise("FOLLOWED_BY").alias("rel"), turn("next").alias("dst"))
    root = c.select(F.concat(F.lit("event:"), F.col("conv_id").cast("string")).alias("src"), F.lit("HAS_CAUSE").alias("rel"), F.lit("turn:0").alias("dst"))
    return edges.unionAll(root).distinct()


@query("whole_components", """WITH RECURSIVE s AS (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
c(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, min(c.root) FROM c JOIN s ON s.a = c.node JOIN recurring.c u ON u.node = s.b WHERE c.root < u.root GROUP BY s.b)
SELECT root AS component, count(*) AS size FROM c GROUP BY root""")
def whole_components(spark, sf_dir):
    """Components of the order-part graph of all lines, of which one holds nearly all nodes."""
    li = proxy.table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return graph.labels(edges).groupBy("component").agg(F.count("*").alias("size"))


@query("synthesized_edges", """WITH n AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 40), m AS (SELECT o, min(p) AS lo FROM n GROUP BY o),
c AS (SELECT DISTINCT o FROM l JOIN m USING (o) WHERE p = lo OR p % 2 = 0)
SELECT 'LER:' || n.o AS src, 'INVOLVES' AS rel, 'Component:' || n.p AS dst, 'synthesized' AS kind FROM n JOIN m USING (o) LEFT JOIN l ON l.o = n.o AND l.p = n.p LEFT JOIN c ON c.o = n.o WHERE l.p IS NULL AND ((n.p <> lo AND n.p % 2 = 1) OR c.o IS NULL)
UNION ALL SELECT 'LER:' || o_orderkey, 'HAS_CAUSE', 'Cause:' || substr(o_orderpriority, 3), 'structural' FROM orders""")
def synthesized_edges(spark, sf_dir):
    """Parts of large lines are linked to their report, those with an even number to its first part as well; reach and bridges find the rest."""
    li = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("ler_number"), F.concat(F.lit("Component:"), F.col("l_partkey").cast("string")).alias("gkey"), F.col("l_partkey").alias("p"), "l_quantity")
    report = F.concat(F.lit("LER:"), "ler_number")
    parts = li.select("ler_number", "gkey", "p").distinct()
    lo = parts.groupBy("ler_number").agg(F.min("p").alias("lo"))
    direct = li.where("l_quantity >= 40").select("ler_number", report.alias("src"), F.col("gkey").alias("dst"))
    by_part = parts.where("p % 2 = 0").join(lo, "ler_number").where("p <> lo").select("ler_number", F.col("gkey").alias("src"), F.concat(F.lit("Component:"), F.col("lo").cast("string")).alias("dst"))
    numbers = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ler_number"), "o_orderpriority")
    nodes = parts.select("ler_number", "gkey", F.lit("Component").alias("type")).unionAll(numbers.select("ler_number", report, F.lit("LER")))
    apart = graph.unreached(nodes, direct.unionAll(by_part))
    causes = numbers.select("ler_number", F.lit("Cause").alias("type"), F.concat(F.lit("Cause:"), F.substring("o_orderpriority", 3, 40)).alias("gkey"), F.lit("").alias("seq"))
    bridges = graph.cause_bridges(causes).select("src", "rel", "dst", F.lit("structural").alias("kind"))
    return apart.select(report.alias("src"), F.lit("INVOLVES").alias("rel"), F.col("gkey").alias("dst"), F.lit("synthesized").alias("kind")).unionAll(bridges)


@query("orphans", "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def orphans(spark, sf_dir):
    nodes = proxy.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gkey"), F.lit(None).cast("boolean").alias("stub"))
    edges = proxy.table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    edges = edges.withColumn("src", F.lit(None).cast("bigint"))
    return graph.orphans(nodes, edges).select(F.col("gkey").alias("node"))


@query("cross_document_hubs", "SELECT l_partkey AS hub, count(DISTINCT l_orderkey) AS n_docs FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def cross_document_hubs(spark, sf_dir):
    edges = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.col("l_orderkey").alias("ler_number"))
    return graph.shared_hubs(edges).where("hub IS NOT NULL")


@query("hub_merge_last_wins", "SELECT o_custkey AS gkey, o_orderpriority AS display_name, o_orderstatus = 'O' AS is_stub FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderkey DESC) = 1")
def hub_merge_last_wins(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gkey"), F.col("o_orderpriority").alias("display_name"), (F.col("o_orderstatus") == "O").alias("stub"), F.col("o_orderkey").alias("seq"))
    return graph.merge_nodes(rows).select("gkey", "display_name", F.col("stub").alias("is_stub"))
