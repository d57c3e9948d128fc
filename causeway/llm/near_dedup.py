"""Operator 4, MinHash near-duplicates by fast similarity sketching.

A document's set holds its distinct word shingles. Sketches of ``BANDS * ROWS`` coordinates are filled in rounds: in each round
every shingle goes to one hashed bin, and later rounds send all shingles to one bin after the other, so every coordinate is
filled after at most twice as many rounds; a coordinate keeps the least (round, hash). Bands of coordinates make buckets.

Documents with equal sets are one class from the start, so a group of copies, however large, costs one representative. First
each class is compared with the centres of its buckets that come first in ``ORDERS`` fixed orders, which connects the bulk of a
group of near copies by a few pairs for each member. Then only classes that share a bucket and aren't connected yet are compared: a bucket of two gives a pair, a
larger one is dealt into blocks of ``BLOCK`` classes whose intersections are matrix products, emitting links only. So every two
classes that share a bucket are connected or have been compared on their full sets.

Defined results: null and wordless texts have empty sets and stand alone; a text of fewer words than a shingle is one shingle;
rows with equal sets always share a component, repeated rows and equal ids included; a component's id is its smallest id that isn't
null, and an unlinked row keeps its own; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.components import components, stars
from causeway.llm.kernel import NOT_SPACE, distinct_by, mix, pieces, salted, shingles_of, words_of
from causeway.llm.storage import free_name, materialize
from causeway.plans.shipping import ship

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 24, 5
BLOCK = 256
#: Orders in which classes are chosen as first centres.
ORDERS = 2
#: Pairs of sets unpacked at once.
HELD_PAIRS = 256
#: Columns of an incidence matrix at once.
COLUMNS = 1 << 13


def fill_sketches(owner: np.ndarray, hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    """Sketches of ``n`` sets given as (owner, hash) rows; the row of an empty set stays at the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(n * size, empty, np.uint64)
    for turn in range(2 * size):
        if not len(owner):
            break
        value = salted(hashes, turn)
        column = (value % np.uint64(size)).astype(np.int64) if turn < size else np.full(len(owner), turn - size)
        np.minimum.at(sketch, owner * size + column, (np.uint64(turn) << np.uint64(56)) | (value >> np.uint64(8)))
        if turn < 4 or turn % 4 == 0 or turn >= size:
            short = (sketch.reshape(n, size) == empty).any(axis=1)
            keep = short[owner]
            owner, hashes = owner[keep], hashes[keep]
    return sketch.reshape(n, size)


def sets_of(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    rolled, own = shingles_of(words_of(texts, NOT_SPACE), shingle)
    return distinct_by(own, rolled)


def sketch_table(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, text_key, n_shingles, key_a, key_b, bands); the two keys name the set."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                n = len(texts)
                own, hashes = sets_of(texts, shingle)
                counts = np.bincount(own, minlength=n)
                begin = np.concatenate([[0], np.cumsum(counts)])
                keys = []
                for salt in (1001, 1002):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted(hashes, salt))])
                    keys.append(mix(total[begin[1:]] - total[begin[:-1]] + counts.astype(np.uint64)).view(np.int64))
                filled = fill_sketches(own, hashes, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
                band = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C13) + filled[:, :, r])
                band += np.arange(BANDS, dtype=np.uint64)
                flat = pa.array(mix(band).ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "text_key", "n_shingles", "key_a", "key_b", "bands"])

    return rows.mapInArrow(sketch, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, key_a long, key_b long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (node, doc_id, text_key), from the whole text of one member each."""
    keyed = docs.select(F.col("doc_id").alias("own_id"), "text", F.xxhash64("text").alias("own_key"))
    texts = wanted.join(keyed, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).select("node", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own_texts in pieces(batch):
                own, hashes = sets_of(own_texts, shingle)
                cut = np.searchsorted(own, np.arange(1, len(own_texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in np.split(hashes, cut)], pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(build, "node long, shingles binary").dropDuplicates(["node"])


def _alike(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): components of the pairs (a, b, comp_a, comp_b) whose full sets are alike enough."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(first, "a").join(second, "b").select("comp_a", "comp_b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, HELD_PAIRS):  # few sets are Python objects at a time
                some = batch.slice(k, HELD_PAIRS)
                keep = [_alike(x, y, percent) for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True)]
                kept = some.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:2], ["u", "v"])

    return both.mapInArrow(verify, "u long, v long")


def _size_fits(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of their incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what only one set has is in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((int(left.sum()), int(right.sum())), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, width - a)), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        out += (part[left] @ part[right].T).astype(np.int64)
    return out


def _blocks(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between components inside each bucket of (bucket, node, size, comp), as (u, v).

    Members of a bucket's largest component need no comparing among themselves: the other members, in blocks, meet all
    members, in blocks.
    """
    largest = mixed.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("members"), F.max("n").alias("n_main"))
    largest = materialize(largest, "largest")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.ceil(n / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(n / BLOCK) - 1).cast("int")))
    placed = mixed.join(largest, "bucket").withColumn("rest", F.col("members") - F.col("n_main"))
    member = placed.select("bucket", "node", "size", "comp", block(F.col("members")).alias("i"), every(F.col("rest")).alias("j"), F.lit(False).alias("outside"))
    outside = placed.where("comp <> main").select("bucket", "node", "size", "comp", every(F.col("members")).alias("i"), block(F.col("rest")).alias("j"), F.lit(True).alias("outside"))
    dealt = member.unionAll(outside).join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        outside = group["outside"].to_numpy(zero_copy_only=False)
        comp, size = group["comp"].to_numpy(), group["size"].to_numpy()
        common = overlaps([np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()], ~outside, outside)
        m, o = np.flatnonzero(~outside), np.flatnonzero(outside)
        alike = (100 * common >= percent * (size[m][:, None] + size[o][None, :] - common)) & (comp[m][:, None] != comp[o][None, :])
        i, j = np.nonzero(alike)
        member, root = stars(comp[m][i], comp[o][j])  # connects the same components by fewer links than classes
        return pa.table({"u": pa.array(member, pa.int64()), "v": pa.array(root, pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row; kept marks one row of each component."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = materialize(sketch_table(rows, shingle), "sketches")
    full = sketched.where("n_shingles > 0")
    # equal sets are one node, named by the first key; a member's id and text hash lead back to a text
    nodes = materialize(
        full.groupBy("key_a", "key_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("member"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
        .select(F.col("key_a").alias("node"), "member", "bands", "size"), "nodes",
    )
    exploded = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    # what is joined to the members of buckets is a table by itself: then the join can split a bucket that very many classes share
    crowded = materialize(exploded.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowded")
    buckets = materialize(exploded.join(crowded, "bucket"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes, "node").select("node", "member.doc_id", "member.text_key")
    sets = materialize(_sets(rows, wanted, shingle), "sets")
    named = nodes.select("node", "member", F.col("node").alias("comp"))
    relabel = lambda df, links: df.join(components(links).select(F.col("node").alias("comp"), "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    # first each class meets the centres of its buckets that come first in fixed orders of all classes: members of one group
    # agree on them, whichever buckets they share
    first = [F.min(F.struct(F.xxhash64("node", F.lit(t)).alias("place"), "node", "size")).alias(f"first{t}") for t in range(ORDERS)]
    fits = lambda t: (F.col("node") != F.col(f"first{t}.node")) & _size_fits("size", f"first{t}.size", percent)
    met = buckets.join(materialize(buckets.groupBy("bucket").agg(*first), "first"), "bucket").select("node", "size", *[f"first{t}" for t in range(ORDERS)]).groupBy("node").agg(*[F.min(F.when(fits(t), F.col(f"first{t}"))).alias(f"first{t}") for t in range(ORDERS)])
    met = met.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"first{t}.node") for t in range(ORDERS)])))).alias("b"))
    links = materialize(_confirmed(met.select("a", "b", F.col("a").alias("comp_a"), F.col("b").alias("comp_b")), sets, percent), "links")
    placed = buckets.withColumn("comp", F.col("node"))
    if not links.isEmpty():
        placed, named = materialize(relabel(placed, links), "placed"), relabel(named, links)
    # then all that share a bucket and aren't connected yet: as a pair where it holds two, else block by block
    other = F.min_by(F.struct("node", "size", "comp"), "node").alias("centre")
    about = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), other).where("lo <> hi").select("bucket", "centre")
    mixed = materialize(placed.join(materialize(about, "about"), "bucket"), "mixed")
    pairs = mixed.where((F.col("crowd") == 2) & (F.col("node") != F.col("centre.node")) & _size_fits("size", "centre.size", percent))
    pairs = pairs.select(F.col("node").alias("a"), F.col("centre.node").alias("b"), F.col("comp").alias("comp_a"), F.col("centre.comp").alias("comp_b")).distinct()
    rest = mixed.where("crowd > 2").select("bucket", "node", "size", "comp")
    links = materialize(_confirmed(pairs, sets, percent).unionAll(_blocks(rest, sets, percent)), "links")
    if not links.isEmpty():
        named = relabel(named, links)
    least = named.groupBy("comp").agg(F.min(F.struct(F.col("member.doc_id").isNull().alias("none"), F.col("member.doc_id").alias("doc_id"), F.col("member.text_key").alias("text_key"))).alias("first"))
    by_node = named.join(least, "comp").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("kept_key"))
    joined = sketched.join(by_node, (F.col("key_a") == F.col("node")) & (F.col("n_shingles") > 0), "left")
    alone = F.col("node").isNull()
    return joined.select(
        "doc_id", "text_key", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("kept_key")))).alias("kept"),
    )


def deduplicate(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group. Wordless texts are all kept; of repeated rows one is kept."""
    own_id, own_key, again = (free_name(docs.columns, n) for n in ("kept_id", "kept_key", "kept_again"))
    kept = near_duplicates(spark, docs, shingle=shingle, percent=percent).where("kept")
    keys = kept.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("size"))
    keys = materialize(keys.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), ((F.col("copies") > 1) & (F.col("size") > 0)).alias(again)), "kept")
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_key))
    once = docs.join(keys.where(~F.col(again)), same, "left_semi")
    repeated = keys.where(again)
    if repeated.isEmpty():
        return once
    return once.unionAll(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))



_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every two classes of equal sets that have a shingle in common are compared; components are the closure of the links.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END)) AS g FROM d),
c AS (SELECT g, min(doc_id) AS id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT id, n, unnest(g) AS h FROM c),
p AS (SELECT a.id AS u, b.id AS v FROM x a JOIN x b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(id, other) AS (SELECT id, id FROM c UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.other),
l AS (SELECT c.g, min(r.other) AS component_id FROM r JOIN c USING (id) GROUP BY c.g)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM s LEFT JOIN l USING (g)
"""
