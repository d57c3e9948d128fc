"""Property-graph operators on node and edge tables: merging, pinned paths, neighbourhoods, reach, components.

Edges carry their document; a path never leaves it, because the document is part of every join key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from causeway.operators.components import components
from causeway.operators.storage import dealt, materialize, new_path, stored
from causeway.plans.shipping import ship


def merge_nodes(nodes: DataFrame, key: str = "gkey", seq: str = "seq", stub: str = "stub") -> DataFrame:
    """One row per key: a real row is never replaced by a stub, and among equals the last one wins whole."""
    order = Window.partitionBy(key).orderBy(F.coalesce(F.col(stub), F.lit(False)), F.desc(seq))
    return nodes.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def merge_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """The last edge of each (src, rel, ler_number, dst)."""
    order = Window.partitionBy("src", "rel", "ler_number", "dst").orderBy(F.desc(seq))
    return edges.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def record_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Local edge ends to storage keys within each report; a system's role moves onto its edge, the target's first."""
    side = lambda p: nodes.select("ler_number", F.col("id").alias(p), F.col("gkey").alias(f"{p}_key"), F.col("role").alias(f"{p}_role"))
    both = edges.join(side("source"), ["ler_number", "source"]).join(side("target"), ["ler_number", "target"])
    return both.select(F.col("source_key").alias("src"), F.col("relation").alias("rel"), F.col("target_key").alias("dst"), "ler_number", F.coalesce("target_role", "source_role").alias("role"), "evidence", F.lit(False).alias("structural"), F.lit(False).alias("synthesized"), "seq")


def cause_bridges(nodes: DataFrame) -> DataFrame:
    """A structural HAS_CAUSE edge from each report to each of its causes."""
    causes = nodes.where("type = 'Cause'")
    return causes.select(F.concat(F.lit("LER:"), "ler_number").alias("src"), F.lit("HAS_CAUSE").alias("rel"), F.col("gkey").alias("dst"), "ler_number", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("evidence"), F.lit(True).alias("structural"), F.lit(False).alias("synthesized"), "seq")


def symmetric(edges: DataFrame) -> DataFrame:
    swapped = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionAll(swapped)


def within(rows: DataFrame, documents: DataFrame | str | None) -> DataFrame:
    """``rows`` (doc, ...) of one document, of those of a table (doc), or all."""
    if documents is None:
        return rows
    return rows.join(documents.select("doc").distinct(), "doc", "left_semi") if isinstance(documents, DataFrame) else rows.where(F.col("doc") == documents)


def chains(edges: DataFrame, starts: DataFrame, documents: DataFrame | str | None = None) -> DataFrame:
    """(doc, origin, node, path, hops) for every node reached from a start along edges of its own document, no node twice.

    ``edges``: (doc, src, dst); ``starts``: (doc, node); hops run from 0. Only what is of ``documents`` is read. Each round takes the
    paths of the round before one step on and writes them, so a path may have any length and lost executors repeat one step.
    """
    spark = edges.sparkSession
    steps = materialize(within(edges.select("doc", "src", "dst"), documents), "steps")
    first = within(starts.select("doc", "node"), documents)
    level = first.select("doc", F.col("node").alias("origin"), "node", F.array("node").alias("path"), F.lit(0).alias("hops"))
    base = new_path(spark, "paths")
    for hop in itertools.count():
        reached = stored(level, f"{base}/{hop}")
        if reached.isEmpty():
            return spark.read.schema(level.schema).option("recursiveFileLookup", True).parquet(base)
        ahead = reached.join(steps.withColumnRenamed("doc", "own"), (F.col("doc") == F.col("own")) & (F.col("node") == F.col("src"))).where(~F.array_contains("path", F.col("dst")))
        level = ahead.select("doc", "origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("hops") + 1).alias("hops"))


#: Edges and starts of a document that are held at once.
HELD = 4_096


def reached(edges: DataFrame, starts: DataFrame, documents: DataFrame | str | None = None, held: int = HELD) -> DataFrame:
    """(doc, node): the distinct nodes of ``chains``, whose paths are never made.

    Documents of at most ``held`` edges and starts pass through a task each as a whole; larger ones go on in rounds together, each from
    new nodes only.
    """
    ship(edges.sparkSession)
    steps = within(edges.select("doc", "src", "dst"), documents)
    first = within(starts.select("doc", "node"), documents)
    rows = steps.select("doc", "src", "dst", F.lit(False).alias("start")).unionAll(first.select("doc", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True)))
    ordered = dealt(rows, "doc")
    key, node = (ordered.schema[c].dataType for c in ("doc", "dst"))
    kinds = [to_arrow_type(key), to_arrow_type(node), pa.bool_()]

    def made(rows: pa.Table, large: bool) -> Iterator[pa.RecordBatch]:
        doc = rows["doc"].slice(0, 1) if large else rows["doc"]
        found = (doc, pa.nulls(1, kinds[1])) if large else _reach(rows)
        yield from pa.table([*(c.cast(kind) for c, kind in zip(found, kinds, strict=False)), pa.repeat(large, len(found[0]))], ["doc", "node", "large"]).to_batches(1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, over = None, False  # rows of the last document so far; whether it is known to be large
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch)
            rows = rows if open_ is None else pa.concat_tables([open_, rows])
            own = _numbered(rows["doc"])
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sizes = np.diff(np.append(heads, len(own)))
            if over and len(heads) > 1:  # what is left of a large one, which has been named
                rows, heads, sizes, over = rows.slice(heads[1]), heads[1:] - heads[1], sizes[1:], False
            for first, size in zip(heads[:-1][sizes[:-1] > held], sizes[:-1][sizes[:-1] > held], strict=True):
                yield from made(rows.slice(first, size), True)
            small = np.repeat(np.append(sizes[:-1] <= held, False), sizes)
            if small.any():
                yield from made(rows.filter(pa.array(small)), False)
            open_ = rows.slice(heads[-1])
            if open_.num_rows > held:
                if not over:
                    yield from made(open_, True)
                open_, over = open_.slice(0, 1), True
        if open_ is not None and not over:
            yield from made(open_, False)

    small = materialize(ordered.mapInArrow(run, f"doc {key.simpleString()}, node {node.simpleString()}, large boolean"), "reached")
    large = small.where("large").select("doc")
    done = small.where("NOT large").select("doc", "node")
    if large.isEmpty():
        return done
    one = lambda df: df.join(large, df.doc.eqNullSafe(large.doc), "left_semi")
    return done.unionAll(_reached_in_rounds(one(steps), one(first)))


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers from 1; null is 0."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _reach(rows: pa.Table) -> tuple[pa.Array, pa.Array]:
    """(doc, node) reached within each document of (doc, src, dst, start), all documents a step on at a time.

    Without a document there are no steps, and none from null.
    """
    n, start = len(rows), rows["start"].combine_chunks().to_numpy(zero_copy_only=False)
    both = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks], rows["src"].type)
    doc, ends = _numbered(rows["doc"]), _numbered(both)
    place, at = np.unique(np.tile(doc, 2) * (ends.max(initial=0) + 1) + ends, return_inverse=True)
    some = np.zeros(len(place), np.int64)  # a row that holds it
    some[at] = np.arange(2 * n)
    seen = np.zeros(len(place), bool)
    seen[at[:n][start]] = True
    step = ~start & (doc > 0) & (ends[:n] > 0)
    src, dst = at[:n][step], at[n:][step]
    while len(src):
        now = seen[src]
        if not now.any():
            break
        seen[dst[now]] = True
        src, dst = src[~now], dst[~now]  # a step is taken once
    held = some[seen]
    return rows["doc"].take(pa.array(held % n)).combine_chunks(), both.take(pa.array(held)).combine_chunks()


def _reached_in_rounds(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``reached`` for documents of any size."""
    spark = edges.sparkSession
    steps = materialize(edges, "steps")
    new = starts.distinct()
    base = new_path(spark, "reached")
    for hop in itertools.count():
        last = stored(new, f"{base}/{hop}")
        seen = spark.read.schema(new.schema).option("recursiveFileLookup", True).parquet(base)
        if last.isEmpty():
            return seen
        ahead = last.join(steps.withColumnRenamed("doc", "own"), (F.col("doc") == F.col("own")) & (F.col("node") == F.col("src"))).select("doc", F.col("dst").alias("node"))
        new = ahead.distinct().join(seen, ["doc", "node"], "left_anti")


def free_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The same without the document in the join: for contrast only, since it runs through shared hubs."""
    return chains(edges.select(F.lit(0).alias("doc"), "src", "dst").distinct(), starts.select(F.lit(0).alias("doc"), "node").distinct())


def free_reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): what is reached when steps of all documents count, for contrast with ``reached``."""
    return reached(edges.select(F.lit(0).alias("doc"), "src", "dst").distinct(), starts.select(F.lit(0).alias("doc"), "node").distinct()).select("node")


def longest_free(edges: DataFrame, starts: DataFrame, prefix: str) -> DataFrame:
    """(path, hops) of the longest path from a start whose key begins with ``prefix``, through any documents; ties by the path."""
    found = free_chains(edges, starts.where(F.col("node").cast("string").startswith(prefix)))
    return found.select("path", "hops").orderBy(F.desc("hops"), F.array_join("path", ">")).limit(1)


def longest(paths: DataFrame, *keys: str) -> DataFrame:
    """The longest path of each key; ties by the path itself."""
    order = Window.partitionBy(*keys).orderBy(F.desc("hops"), F.col("path").cast("string"))
    return paths.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def neighbourhood(edges: DataFrame, anchor: str, document: str | None = None) -> DataFrame:
    """(anchor, hop, neighbor, rel) one and two hops from a node in either direction, no edge used twice.

    ``edges``: (src, rel, dst, ler_number). ``document`` pins both hops to it.
    """
    numbered = edges.where(F.col("ler_number") == document) if document else edges
    both = symmetric(numbered.withColumn("edge", F.struct("src", "rel", "dst", "ler_number")))
    one = both.where(F.col("src") == anchor).select(F.col("dst").alias("mid"), F.col("rel").alias("rel1"), F.col("edge").alias("edge1"))
    two = one.join(both, F.col("mid") == F.col("src")).where(F.col("edge") != F.col("edge1")).where(F.col("dst") != anchor)
    hops = one.select(F.lit(1).alias("hop"), F.col("mid").alias("neighbor"), F.col("rel1").alias("rel")).unionAll(two.select(F.lit(2), "dst", "rel"))
    return hops.distinct().select(F.lit(anchor).alias("anchor"), F.col("hop").cast("bigint").alias("hop"), "neighbor", "rel")


def neighbours(edges: DataFrame, anchor: str, document: str | None = None) -> DataFrame:
    """The first hop of ``neighbourhood``."""
    numbered = (edges.where(F.col("ler_number") == document) if document else edges).select("src", "rel", "dst")
    one = symmetric(numbered).where(F.col("src") == anchor)
    return one.select(F.lit(anchor).alias("anchor"), F.lit(1).cast("bigint").alias("hop"), F.col("dst").alias("neighbor"), "rel").distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge, stubs left out; a missing stub flag counts as false."""
    ends = edges.select(F.col("src").alias("gkey")).unionAll(edges.select("dst"))
    return nodes.where(~F.coalesce(F.col("stub"), F.lit(False))).join(ends, "gkey", "left_anti")


def shared_hubs(edges: DataFrame) -> DataFrame:
    """(hub, n_docs): nodes that edges of several documents touch."""
    ends = edges.select(F.col("src").alias("hub"), "ler_number").unionAll(edges.select("dst", "ler_number"))
    return ends.groupBy("hub").agg(F.countDistinct("ler_number").alias("n_docs")).where("n_docs > 1")


def labels(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, edges taken in both directions."""
    return components(edges, "src", "dst").withColumnRenamed("root", "component")


def unreached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that no edge of their own report connects to it: (ler_number, gkey).

    ``nodes``: (ler_number, gkey, type); ``edges``: (ler_number, src, dst). Reach is taken over document-qualified nodes.
    """
    name = lambda c: F.concat_ws("|", F.col("ler_number").cast("string"), F.col(c).cast("string"))
    found = labels(edges.select(name("src").alias("src"), name("dst").alias("dst")))
    home = nodes.where("type = 'LER'").select("ler_number", name("gkey").alias("node")).join(found, "node", "left").select("ler_number", F.coalesce("component", "node").alias("home"))
    parts = nodes.where("type = 'Component'").select("ler_number", "gkey", name("gkey").alias("node")).join(found, "node", "left")
    return parts.join(home, "ler_number").where(F.coalesce("component", "node") != F.col("home")).select("ler_number", "gkey")
