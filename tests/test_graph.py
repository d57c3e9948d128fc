import json
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import assemble, graph, retrieval, risk
from causeway.operators.components import components
from causeway.plans import catalogue, engine_queries
from causeway.plans.shipping import ship
from causeway.sources import graph_store, records
from causeway.streaming import refresh


def report(number, nodes, edges):
    return {"ler_number": number, "nodes": nodes, "edges": edges}


def node(i, kind, name="n", **more):
    return {"id": i, "type": kind, "display_name": name, "properties": {}, **more}


def edge(a, rel, b):
    return {"source": a, "relation": rel, "target": b}


def write(path, reports):
    path.mkdir()
    for k, r in enumerate(reports):
        (path / f"{k}.json").write_text(r if isinstance(r, str) else json.dumps(r, indent=1))
    return f"{path}/*.json"


def test_reports_to_graph(spark, tmp_path):
    first = report("K1", [node("l", "LER", key="K1"), node("s", "System", "Old name", eiis_code="BJ"), node("c", "Component", "Pump"), node("z", "Component", "Lone"), node("k", "Cause", category="provisional", provisional=True)], [edge("l", "INVOLVES", "s"), edge("c", "PART_OF", "s")])
    second = report("K2", [node("l", "LER", key="K2"), node("o", "LER", key="K1", stub=True), node("s", "System", "New name", eiis_code="BJ"), node("k", "Cause", category="Other")], [edge("l", "SIMILAR_TO", "o"), edge("l", "INVOLVES", "s")])
    path = write(tmp_path / "in", [first, second, "{broken", report("K3", [node("l", "LER", key="K3")], [edge("l", "INVOLVES", "gone")])])
    good, bad = records.validated(records.read_reports(spark, path))
    assert {r.ler_number for r in good.collect()} == {"K1", "K2"}
    assert {r.reason for r in bad.collect()} == {"unreadable", "edge without node"}
    nodes, edges = assemble.build_graph(good)
    by = {r.gkey: r for r in nodes.collect()}
    assert by["LER:K1"].stub is not True and by["System:BJ"].display_name == "New name"
    assert "Cause:provisional:K1" in by and "Cause:Other" in by
    made = {(r.src, r.rel, r.dst) for r in edges.where("synthesized").collect()}
    assert made == {("LER:K1", "INVOLVES", "Component:lone")}
    assert edges.where("structural").count() == 2
    assert {(r.entity, r.event_key) for r in assemble.entity_events(nodes, edges).collect()} >= {("System:BJ", "K1"), ("System:BJ", "K2"), ("Cause:Other", "K2")}
    assert sum(r["size"] for r in assemble.connectivity(nodes, edges).collect()) == len(by)


def test_paths_stay_in_their_document(spark):
    edges = spark.createDataFrame([("A", 1, 2), ("A", 2, 1), ("B", 2, 3)], "doc string, src long, dst long")
    start = spark.createDataFrame([("A", 1)], "doc string, node long")
    assert {tuple(r.path) for r in graph.chains(edges, start).collect()} == {(1,), (1, 2)}
    assert {tuple(r.path) for r in graph.free_chains(edges, start).collect()} == {(1,), (1, 2), (1, 2, 3)}


def test_paths_have_no_limit(spark):
    """A hundred and thirty steps in one document, a ring and a fork in others, of which only what is asked for is read."""
    rows = [("A", k, k + 1) for k in range(130)] + [("B", 1, 2), ("B", 2, 1), ("B", 1, 3), ("C", 1, 2)]
    edges = spark.createDataFrame(rows, "doc string, src long, dst long").coalesce(1)
    starts = spark.createDataFrame([("A", 0), ("B", 1), ("C", 1), ("B", 1)], "doc string, node long").distinct().coalesce(1)
    found = graph.chains(edges, starts, "A").collect()
    assert sorted((r.doc, r.origin, r.node, r.hops, r.path == list(range(r.hops + 1))) for r in found) == [("A", 0, k, k, True) for k in range(131)]
    asked = spark.createDataFrame([("B",), ("C",)], "doc string")
    assert sorted((r.doc, tuple(r.path)) for r in graph.chains(edges, starts, asked).collect()) == [("B", (1,)), ("B", (1, 2)), ("B", (1, 3)), ("C", (1,)), ("C", (1, 2))]
    assert sorted((r.doc, r.node) for r in graph.reached(edges, starts, asked).collect()) == [("B", 1), ("B", 2), ("B", 3), ("C", 1), ("C", 2)]
    assert graph.chains(edges, starts, "none").count() == graph.reached(edges, starts, "none").count() == 0


def test_one_report_reads_its_own_steps(spark, sf_dir):
    """The condition on the report reaches the scan of the partition of its relation."""
    engine = engine_queries.engine(spark, sf_dir)
    steps, _ = engine._steps(any_origin=True)
    plan = graph.within(steps, "7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel" in plan and "(rel#" in plan and "EqualTo(ler_number,7)" in plan
    before = set(spark.catalog.listTables())
    conf = spark.conf.get("spark.sql.cteRecursionRowLimit")
    catalogue.QUERIES["engine_failure_chain"](spark, sf_dir).collect()
    assert set(spark.catalog.listTables()) == before and spark.conf.get("spark.sql.cteRecursionRowLimit") == conf


def test_stamps_touch_their_partitions_only(spark, tmp_path):
    columns = "gkey string, type string, display_name string"
    nodes = spark.createDataFrame([("System:A", "System", "a"), ("System:B", "System", "b"), ("Cause:X", "Cause", "x"), ("LER:1", "LER", "1")], columns)
    edges = spark.createDataFrame([("LER:1", "INVOLVES", "System:A", "1")], "src string, rel string, dst string, ler_number string")
    path = str(tmp_path / "g")
    graph_store.write_graph(nodes, edges, path)
    files = lambda: {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "g").rglob("*.parquet")}
    before = files()
    values = lambda *rows: spark.createDataFrame(rows, "gkey string, n_events long, version string")
    assert {tuple(r) for r in graph_store.stamp(spark, path, values(("System:A", 3, "v1"), ("Cause:X", 4, "v1"), ("LER:1", 5, "v1")), "System", "Cause").collect()} == {("System", 1), ("Cause", 1)}
    kept = {f: t for f, t in files().items() if "type=LER" in f or "edges" in f}
    assert kept and kept.items() <= before.items()
    graph_store.stamp(spark, path, values(("System:B", 9, "v2")), "System")
    got = {r.gkey: (r.display_name, r.n_events, r.version) for r in graph_store.read_graph(spark, path)[0].collect()}
    assert got == {"System:A": ("a", None, None), "System:B": ("b", 9, "v2"), "Cause:X": ("x", 4, "v1"), "LER:1": ("1", None, None)}
    for wrong in (values(("System:A", 1, "v"), ("System:A", 2, "v")), spark.createDataFrame([("System:A", 1)], "gkey string, colour long")):
        with pytest.raises(ValueError):
            graph_store.stamp(spark, path, wrong, "System")


def test_spines(spark):
    nodes = [("1", "LER:1", "LER", False), ("1", "LER:0", "LER", True), ("1", "R", "RegulatoryReference", None), ("1", "a", "Component", None), ("1", "b", "Component", None), ("1", "c", "Component", None), ("2", "LER:2", "LER", None), ("2", "a", "Component", None)]
    edges = [("1", "LER:1", "LER:0"), ("1", "LER:0", "c"), ("1", "R", "c"), ("1", "LER:1", "a"), ("1", "b", "R"), ("2", "LER:2", "a"), ("2", "a", "gone")]
    got = assemble.spines(spark.createDataFrame(nodes, "ler_number string, gkey string, type string, stub boolean"), spark.createDataFrame(edges, "ler_number string, src string, dst string"))
    assert sorted(map(tuple, got.collect())) == [("1", "LER:1", 2, 3, True), ("1", "b", 1, 3, False), ("1", "c", 1, 3, False), ("2", "LER:2", 2, 1, True)]


def test_arrow_bound_in_any_unit(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    for size in ("64m", "1g", "1000"):
        spark.conf.set(key, size)
        ship(spark)
        assert spark.conf.get(key) in ("1000", "8388608b")
    spark.conf.set(key, was)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_against_union_find(spark, kind):
    draw = random.Random(3)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(5, k) for k in range(300, 340)] + [(None, 3), (4, None), (7, 7)]
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    name = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"n{x}é")
    for a, b in pairs:
        if a is not None and b is not None:
            lo, hi = sorted((top(name(a)), top(name(b))))
            above[hi] = lo
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"u {kind}, v {kind}").repartition(7)
    assert {r.node: r.root for r in components(edges).collect()} == {x: top(x) for x in list(above)}


def test_labels_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "src long, dst long")
    assert {r.component for r in graph.labels(edges).collect()} == {1, 100}


def test_risk_example(spark):
    rows = [("E1", "reactor-trip-or-scram", 0.9), ("E1", "safety-system-inoperable", 0.9), ("E2", "loss-of-safety-function", 0.59), ("E2", "ts-violation-only", 0.60), ("E3", "esf-actuation", None)]
    cons = spark.createDataFrame(rows, "event_key string, outcome string, conf double").withColumn("sure", F.coalesce("conf", F.lit(0.0)) >= 0.60)
    worst = risk.worst_outcomes(cons)
    assert {r.event_key: r.worst for r in worst.collect()} == {"E1": "safety-system-inoperable", "E2": "ts-violation-only", "E3": None}
    entities = spark.createDataFrame([("S1", "E1"), ("S1", "E2"), ("S2", "E3")], "entity string, event_key string")
    counts = risk.entity_outcomes(entities, worst)
    got = {r.entity: r for r in risk.stats(counts).collect()}
    assert (got["S1"].mass, got["S1"].expected_severity, got["S1"].modal, got["S1"].small_sample) == (6, 3.0, "safety-system-inoperable", True)
    assert (got["S2"].n_events, got["S2"].n_classified, got["S2"].expected_severity) == (1, 0, 0.0)
    assert [r.entity for r in risk.ranked(risk.stats(counts), 5).collect()] == ["S1"]


def test_shares_add_up(spark, sf_dir):
    from causeway.plans import catalogue

    total = catalogue.QUERIES["likely_outcome_system"](spark, sf_dir).agg(F.sum("p")).first()[0]
    assert abs(total - 1) < 1e-9


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    records.append_missing(rows, path)
    records.append_missing(rows.unionAll(spark.createDataFrame([(3, "c")], rows.schema)), path)
    assert spark.read.parquet(path).count() == 3
    try:
        records.overwrite(rows, path)
        raise AssertionError("overwrote without yes")
    except ValueError:
        pass


def test_stream_counts(spark, tmp_path):
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "entity string, outcome string"
    for k in range(4):
        spark.createDataFrame([("s", "x"), ("s", "y")], schema).write.mode("append").parquet(source)
        refresh.keep_counts(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination()
        assert {(r.outcome, r.n) for r in refresh.latest_counts(spark, out, k + 1).collect()} == {("x", k + 1), ("y", k + 1)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["2", "3"]  # older versions are gone


def test_intents(spark, tmp_path):
    def incident(number, plant, part, cause, code, backup):
        identity = {"event_date": f"20{number[-1]}0-01-01", "plant_name": plant, "power_level": 90}
        nodes = [node("l", "LER", key=number), node("s", "System", "Injection", eiis_code="BJ"), node("b", "System", "Spare", eiis_code="BN"), node("p", "Component", part), node("f", "FailureMode", "pump stuck"), node("k", "Cause", cause, category=cause, cause_code=code), node("c", "Consequence", "manual reactor trip", duration="3 hours")]
        edges = [edge("l", "INVOLVES", "s"), edge("p", "PART_OF", "s"), edge("l", "LEADS_TO", "f"), edge("f", "CAUSED_BY", "k"), edge("f", "LEADS_TO", "c")] + [edge("c", "BACKED_UP_BY", "b")] * backup
        return {"ler_number": number, "identity": identity, "nodes": nodes, "edges": edges}

    path = write(tmp_path / "in", [incident("N1", "North", "Pump", "Personnel Error", "A", True), incident("N2", "South", "Pump", "Personnel Error", "A", False), incident("N3", "South", "Valve", "Other", "X", False)])
    engine = retrieval.Engine.from_reports(records.validated(records.read_reports(spark, path))[0])
    engine.nodes, engine.edges = engine.nodes.cache(), engine.edges.cache()
    ask = lambda intent, **anchors: engine.ask(retrieval.QuerySpec(intent, anchors))
    several = ask("failure_chain", plant="south")
    assert isinstance(several, retrieval.Clarification) and several.total == 2 and retrieval.suggest_subgraph(several) is None
    one = ask("failure_chain", ler_key="N1")
    assert [(r.doc, r.hops, r.backups) for r in one.rows.collect()] == [("N1", 1, ["System:BN"])]
    assert ask("failure_chain", plant="Nowhere").empty and ask("out_of_corpus").empty
    assert [(r.component, r.n_events, r.n_plants, r.n_links) for r in ask("shared_component_cause").rows.collect()] == [("Component:pump", 2, 2, 1)]
    assert [(r.a, r.b) for r in ask("shared_component_cause", component="Component:pump").rows.collect()] == [("N1", "N2")]
    assert {(r.component, r.event_key) for r in ask("system_components", system_code="BJ").rows.collect()} == {("Pump", "N1"), ("Pump", "N2"), ("Valve", "N3")}
    assert [(r.name, r.n) for r in ask("system_failure_modes", system_code="BJ").rows.collect()] == [("pump stuck", 3)]
    assert [(r.event_key, r.backups) for r in ask("mitigating_backups").rows.collect()] == [("N1", ["Spare"])]
    assert {(r.outcome, r.n, r.p) for r in ask("likely_outcome", component="pump").rows.collect()} == {("reactor-trip-or-scram", 2, 1.0)}
    assert [(r.cause, r.min_support) for r in ask("probable_path", system_code="BJ").rows.collect()] == [("Personnel Error", 2)]
    assert {(r.value, r.n) for r in ask("faceted_frequency", target="plants", filters=[{"facet": "duration", "op": ">=", "value": 3}]).rows.collect()} == {("North", 1), ("South", 2)}
    assert ask("subgraph", ler_key="N1").rows.count() > 0 and ask("weak_program_events").rows.count() == 2


def test_components_of_all_lines_against_union_find(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for r in lines:
        a, b = sorted((top(f"o{r.l_orderkey}"), top(f"p{r.l_partkey}")))
        above[b] = a  # the least node stays on top
    sizes = {}
    for x in list(above):
        sizes[top(x)] = sizes.get(top(x), 0) + 1
    got = {r.component: r["size"] for r in catalogue.QUERIES["whole_components"](spark, sf_dir).collect()}
    assert got == sizes and sum(got.values()) == len({r.l_orderkey for r in lines}) + len({r.l_partkey for r in lines})


def test_spines_of_small_and_large_reports(spark, monkeypatch):
    """Small reports need no contraction of all; larger ones are contracted, with the same rows."""
    nodes = [(f"r{k}", f"n{i:02d}", "System" if i else "LER", None) for k in range(1, 8) for i in range(3 * k)]
    edges = [(f"r{k}", f"n{i:02d}", f"n{i + k:02d}") for k in range(1, 8) for i in range(3 * k)]
    made = spark.createDataFrame(nodes, "ler_number string, gkey string, type string, stub boolean"), spark.createDataFrame(edges, "ler_number string, src string, dst string")
    rows = lambda **held: sorted(map(tuple, assemble.spines(*made, **held).collect()))
    both = rows(held=20)
    monkeypatch.setattr(graph, "labels", lambda _: 1 / 0)
    assert rows() == both and [r for r in both if r[0] == "r2"] == [("r2", "n00", 3, 2, True), ("r2", "n01", 3, 2, False)]


def test_declared_templates_store_nothing(spark, sf_dir, monkeypatch):
    """Templates over all reports compute the parts they name; the graph is not written for them."""
    monkeypatch.setattr(graph_store, "write_graph", lambda *_: 1 / 0)
    monkeypatch.setattr(engine_queries, "_stored", {})
    assert catalogue.QUERIES["engine_cause_distribution"](spark, sf_dir).count() == 5
    plan = catalogue.QUERIES["engine_weak_program_events"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_reach_is_the_same_in_one_pass_and_in_rounds(spark):
    ship(spark)
    draw = random.Random(5)
    pairs = [(f"d{draw.randrange(12)}", draw.randrange(9), draw.randrange(9)) for _ in range(150)]
    edges = spark.createDataFrame([*pairs, (None, 1, 2), ("d1", None, 3)], "doc string, src int, dst int")
    starts = spark.createDataFrame([*[(f"d{k}", k % 9) for k in range(10)], (None, 1)], "doc string, node int")
    want = {(None, 1)}
    for k in range(10):
        waiting = [k % 9]
        while waiting:
            node = waiting.pop()
            if (f"d{k}", node) not in want:
                want.add((f"d{k}", node))
                waiting += [dst for doc, src, dst in pairs if doc == f"d{k}" and src == node]
    for held in (graph.HELD, 12, 0):
        got = [(r.doc, r.node) for r in graph.reached(edges, starts, held=held).collect()]
        assert set(got) == want and len(got) == len(want)


def test_consequences_read_no_edges_and_ends_only_relations_of_their_type(spark, sf_dir):
    e = engine_queries.declared(spark, sf_dir)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "s_suppkey" not in plan(e.consequences()) and "p_brand" not in plan(e.consequences())
    assert "s_suppkey" not in plan(assemble.ends(e.edges, "Component")) and "o_custkey" not in plan(assemble.ends(e.edges, "Component"))
    by_edges = retrieval.Engine(spark, e.reports, e.nodes, e.edges, classify=e.classify)
    assert e.consequences().exceptAll(by_edges.consequences()).isEmpty() and by_edges.consequences().exceptAll(e.consequences()).isEmpty()


def test_consequence_places_order_as_their_names(spark):
    from causeway.plans import engine_queries as q

    numbers = [None, 0, 5, -5, 50, 55, 100, 60, 10, 1, -1, -10, -100, 2147483647, -2147483648]
    rows = spark.createDataFrame([(o, n) for o in q._CLASSES for n in numbers], "o string, n int")
    placed = rows.select(F.concat_ws("|", "o", F.col("n").cast("string")).alias("text"), q._placed(F.col("o"), F.col("n")).alias("place")).select("*", q._name(F.col("place")).alias("back")).collect()
    assert all(r.text == r.back for r in placed)
    assert [r.text for r in sorted(placed, key=lambda r: r.place)] == sorted(r.text for r in placed)


def test_reached_over_many_batches(spark):
    """Documents across batches, large ones among small ones, nulls and circles, with rows of other documents' names."""
    edges = [(f"d{i}", f"n{j}", f"n{j + 1}") for i in range(40) for j in range(i)] + [("d7", "n7", "n0"), ("d8", None, "x"), ("d8", "n8", None), (None, "n0", "n1")]
    starts = [(f"d{i}", "n2") for i in range(40)] + [(None, "n0")]
    want = {(f"d{i}", f"n{j}") for i in range(40) for j in range(2, max(i, 2) + 1)} | {("d7", "n0"), ("d7", "n1"), ("d8", None), (None, "n0")}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for held in (4096, 20, 3):
            got = graph.reached(spark.createDataFrame(edges, "doc string, src string, dst string"), spark.createDataFrame(starts, "doc string, node string"), None, held)
            assert {(r.doc, r.node) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_edges_of_a_few_hubs_are_chosen_before_they_are_dealt_out(spark):
    from causeway.operators import assemble

    edges = spark.range(100).select(F.concat(F.lit("LER:"), "id").alias("src"), F.lit("INVOLVES").alias("rel"), F.concat(F.lit("System:"), F.col("id") % 10).alias("dst"), F.col("id").cast("string").alias("ler_number")).repartition("ler_number").distinct()
    chosen = assemble.touching(edges, spark.createDataFrame([("System:3",)], "gkey string"))
    assert {r.ler_number for r in chosen.collect()} == {str(i) for i in range(3, 100, 10)}
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("Filter")
    many = spark.range(assemble.NAMED + 1).select(F.concat(F.lit("System:"), "id").alias("gkey"))
    assert assemble.touching(edges, many).count() == 100


def test_documents_stay_whole_where_both_sides_are_dealt_by_them(spark):
    """Many edges and few starts, each dealt by document already: partitions of either side are joined by its own size."""
    rows = spark.range(0, 40_000, 1, 4).select((F.col("id") % 4_000).alias("doc"), F.floor(F.col("id") / 4_000).alias("n"))
    edges = rows.repartition("doc").distinct().select("doc", F.col("n").alias("src"), (F.col("n") + 1).alias("dst"))
    starts = rows.repartition("doc").groupBy("doc").agg(F.min("n").alias("node"))
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(least)
    spark.conf.set(least, "40k")
    try:
        assert graph.reached(edges, starts).count() == 44_000
        nodes = starts.select(F.col("doc").cast("string").alias("k"), "node").repartition("k").distinct().select(F.col("k").alias("ler_number"), F.col("node").alias("gkey"), F.lit("System").alias("type"), F.lit(False).alias("stub"))
        more = nodes.unionAll(nodes.select("ler_number", F.col("gkey") + 1, "type", "stub"))
        drawn = rows.select(F.col("doc").cast("string").alias("k"), "n").repartition("k").distinct().select(F.col("k").alias("ler_number"), F.col("n").alias("src"), (F.col("n") + 1).alias("dst"))
        assert assemble.spines(more, drawn).count() == 4_000
    finally:
        spark.conf.set(least, before)


def test_templates_of_all_kinds_store_no_graph(spark, sf_dir, monkeypatch):
    """A vocabulary, a clarification, a neighbourhood and a chain are read from the graph as declared."""
    monkeypatch.setattr(graph_store, "write_graph", lambda *_: 1 / 0)
    for name in ("engine_vocabulary", "engine_clarify", "engine_subgraph_cause", "engine_failure_chain"):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("near", [3, 70])
def test_next_hop_is_asked_for_where_the_first_leaves_room(spark, near):
    nodes = spark.createDataFrame([("Cause:x", "Cause", "A")], "gkey string, type string, cause_code string")
    edges = spark.createDataFrame([(f"LER:{k}", "HAS_CAUSE", "Cause:x", str(k)) for k in range(near)] + [(f"LER:{k}", "INVOLVES", "System:a", str(k)) for k in range(near)], "src string, rel string, dst string, ler_number string")
    got = retrieval.Engine(spark, None, nodes, edges).ask(retrieval.QuerySpec("subgraph", {"cause_code": "A"})).rows
    want = graph.neighbourhood(edges, "Cause:x").orderBy("hop", "neighbor", "rel").limit(60).collect()
    assert got.collect() == want and len(want) == min(near + 1, 60)
