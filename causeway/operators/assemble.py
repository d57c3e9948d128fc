"""From validated reports to one merged property graph, and the graph's event tables."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from causeway.operators import graph
from causeway.operators.storage import dealt, materialize
from causeway.plans.shipping import ship
from causeway.sources import records


def build_graph(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): hubs merged over reports, cause bridges and links to unreached components added.

    Reports count in the order of their files; a later whole row replaces an earlier one, but a stub never a real one.
    """
    nodes = records.report_nodes(reports)
    place = lambda kind, pos: F.concat_ws("#", "source_file", F.lit(kind), F.lpad(pos.cast("string"), 6, "0")).alias("seq")
    edges = reports.select("ler_number", "source_file", F.posexplode("edges").alias("pos", "e")).select("ler_number", place("0", F.col("pos")), "e.*")
    drawn = graph.record_edges(nodes, edges).unionByName(graph.cause_bridges(nodes.withColumn("seq", place("1", F.col("pos")))))
    own = nodes.select("ler_number", "gkey", F.when((F.col("type") == "LER") & (F.col("key") != F.col("ler_number")), "Stub").otherwise(F.col("type")).alias("type"))
    apart = graph.unreached(own, drawn.select("ler_number", "src", "dst"))
    nothing = F.lit(None).cast("string")
    linked = apart.select(F.concat(F.lit("LER:"), "ler_number").alias("src"), F.lit("INVOLVES").alias("rel"), F.col("gkey").alias("dst"), "ler_number", nothing.alias("role"), nothing.alias("evidence"), F.lit(False).alias("structural"), F.lit(True).alias("synthesized"), F.lit("").alias("seq"))
    seq = F.concat_ws("#", "source_file", F.lpad(F.col("pos").cast("string"), 6, "0"))
    merged_nodes = graph.merge_nodes(nodes.withColumn("seq", seq))
    merged_edges = graph.merge_edges(drawn.unionByName(linked)).drop("seq")
    return merged_nodes, merged_edges


def events(nodes: DataFrame) -> DataFrame:
    """Real reports: the counting unit of all statistics."""
    return nodes.where((F.col("type") == "LER") & ~F.coalesce("stub", F.lit(False))).select(F.col("key").alias("event_key"))


def ends(edges: DataFrame, kind: str, rel: str | None = None) -> DataFrame:
    """(gkey, event_key), distinct: nodes of a type with the report of each edge (of a relation) that touches them.

    Where edges say the types of their ends (``src_type``, ``dst_type``), relations without such ends are never made; else keys begin with their type.
    """
    chosen = edges.where("ler_number IS NOT NULL") if rel is None else edges.where((F.col("rel") == rel) & F.col("ler_number").isNotNull())
    typed = "src_type" in edges.columns and "dst_type" in edges.columns
    side = lambda c: chosen.where(F.col(f"{c}_type") == kind if typed else F.col(c).startswith(f"{kind}:")).select(F.col(c).alias("gkey"), F.col("ler_number").alias("event_key"))
    return side("src").unionAll(side("dst")).distinct()


#: Types that events are counted for, with the relation that ties them to a report; components are tied by any.
TIED = {"System": "INVOLVES", "Component": None, "Cause": "HAS_CAUSE"}


#: Nodes that are named in a condition, at most.
NAMED = 64


def touching(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """``edges`` without such as touch none of a few ``hubs`` (gkey).

    A few hubs are looked up and named, so that edges are chosen where they are made and not after they are dealt out. Of more
    hubs than ``NAMED`` all edges are returned: whoever asks joins the hubs in any case.
    """
    some = [r[0] for r in hubs.select("gkey").where("gkey IS NOT NULL").distinct().limit(NAMED + 1).collect()]
    return edges.where(F.col("src").isin(some) | F.col("dst").isin(some)) if len(some) <= NAMED else edges


def of_node(edges: DataFrame, node: str) -> DataFrame:
    """``edges`` that touch a node, whose key begins with its type; where edges say the types of their ends, others are never made."""
    touch = lambda c: (F.col(c) == node) & (F.col(f"{c}_type") == node.split(":", 1)[0] if f"{c}_type" in edges.columns else F.lit(True))
    return edges.where(touch("src") | touch("dst"))


def tied_events(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(entity, event_key) of a type, distinct, by report: what is tied to real reports, whether or not it is a hub that counts.

    The join is an inner one, since a semi-join would be moved below the edges' own joins, which then deal out all rows once more.
    """
    return ends(edges, kind, TIED[kind]).join(events(nodes).distinct(), "event_key").select(F.col("gkey").alias("entity"), "event_key")


def hubs(nodes: DataFrame, kind: str) -> DataFrame:
    """(entity): the nodes of a type that events are counted for, of causes the coded ones."""
    return nodes.where((F.col("type") == kind) & (F.lit(kind != "Cause") | (F.col("category") != "provisional"))).select(F.col("gkey").alias("entity"))


def entity_events(nodes: DataFrame, edges: DataFrame, *kinds: str) -> DataFrame:
    """(entity_type, entity, event_key): systems by INVOLVES, components by any stamped edge, causes by the pinned bridge, coded ones only.

    Of the types named, or all.
    """
    one = lambda kind: tied_events(nodes, edges, kind).join(hubs(nodes, kind), "entity", "left_semi").select(F.lit(kind).alias("entity_type"), "entity", "event_key")
    return reduce(DataFrame.unionAll, [one(kind) for kind in kinds or TIED])


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of the graph without citations; a node without edges is a component by itself."""
    kept = nodes.where("type <> 'RegulatoryReference'").select("gkey")
    inner = edges.join(kept.select(F.col("gkey").alias("src")), "src", "left_semi").join(kept.select(F.col("gkey").alias("dst")), "dst", "left_semi")
    found = graph.labels(inner.select("src", "dst"))
    named = kept.join(found, kept.gkey == found.node, "left").select(F.coalesce("component", "gkey").alias("component"))
    return named.groupBy("component").agg(F.count("*").alias("size"))


#: Nodes and edges of a report that are held at once.
HELD = 4_096


def spines(nodes: DataFrame, edges: DataFrame, held: int = HELD) -> DataFrame:
    """(ler_number, component, size, n_components, spine) of each report by itself, stub reports and citations left out.

    ``nodes``: (ler_number, gkey, type, stub) of each report; ``edges``: (ler_number, src, dst). The spine is the largest component,
    the one with the least node among equal ones; a report with others beside it is split. Reports of at most ``held`` nodes and edges
    pass through a task each as a whole; larger ones are contracted together.
    """
    ship(nodes.sparkSession)
    kept = nodes.where((F.col("type") != "RegulatoryReference") & ~F.coalesce(F.col("stub"), F.lit(False))).select("ler_number", "gkey")
    rows = kept.select("ler_number", F.col("gkey").alias("src"), F.lit(None).cast(kept.schema["gkey"].dataType).alias("dst")).unionAll(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("ler_number", "src", "dst"))
    ordered = dealt(rows.where("ler_number IS NOT NULL"), "ler_number")
    key, node = (ordered.schema[c].dataType for c in ("ler_number", "src"))
    kinds = [to_arrow_type(key), to_arrow_type(node), pa.int64(), pa.int64(), pa.bool_()]
    names = ["ler_number", "component", "size", "n_components", "spine"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        each = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for report, own in itertools.groupby(each, key=lambda r: r[0]):
            some = [r[1:] for r in itertools.islice(own, held + 1)]
            if len(some) > held:
                yield report, None, None, None, None
                continue
            parts = _parts(some)
            best = min(parts, key=lambda first: (-parts[first], first), default=None)
            yield from ((report, first, size, len(parts), first == best) for first, size in parts.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = found(batches)
        while some := list(itertools.islice(out, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)], names)

    small = materialize(ordered.mapInArrow(run, f"ler_number {key.simpleString()}, component {node.simpleString()}, size long, n_components long, spine boolean"), "spines")
    large = small.where("size IS NULL").select("ler_number")
    if large.isEmpty():
        return small
    return small.where("size IS NOT NULL").unionAll(_large_spines(kept.join(large, "ler_number", "left_semi"), edges.join(large, "ler_number", "left_semi")))


def _parts(rows: list[tuple]) -> dict:
    """Least node and size of each component of one report's ``rows``: (node, null), and (src, dst) of edges, of which those between nodes count."""
    up = {src: src for src, dst in rows if dst is None and src is not None}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for src, dst in rows:
        if dst is not None and src in up and dst in up:
            a, b = sorted((root(src), root(dst)))
            up[b] = a
    return Counter(root(x) for x in up)


def _large_spines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``spines`` of ``nodes`` (ler_number, gkey), whatever their number."""
    own = lambda c: F.struct("ler_number", F.col(c).alias("node"))
    kept = nodes.select("ler_number", own("gkey").alias("at")).distinct()
    pairs = edges.select(own("src").alias("src"), own("dst").alias("dst"))
    for end in ("src", "dst"):
        pairs = pairs.join(kept.select(F.col("at").alias(end)), end, "left_semi")
    # documents and nodes are named by one text each; the length before it keeps names apart
    name = lambda c: F.concat(F.length(F.col(f"{c}.ler_number").cast("string")).cast("string"), F.lit("|"), F.col(f"{c}.ler_number").cast("string"), F.lit("|"), F.col(f"{c}.node").cast("string"))
    found = graph.labels(pairs.select(name("src").alias("src"), name("dst").alias("dst")))
    placed = kept.withColumn("node", name("at")).join(found, "node", "left").select("ler_number", F.coalesce("component", "node").alias("component"), F.col("at.node").alias("gkey"))
    sizes = placed.groupBy("ler_number", "component").agg(F.count("*").alias("size"), F.min("gkey").alias("first"))
    whole = sizes.groupBy("ler_number").agg(F.count("*").alias("n_components"), F.min(F.struct((-F.col("size")).alias("less"), "first")).alias("best"))
    return sizes.join(whole, "ler_number").select("ler_number", F.col("first").alias("component"), "size", "n_components", (F.col("first") == F.col("best.first")).alias("spine"))
