"""Exact vector search: a stated set of queries against all rows, in blocks.

Queries are collected a bounded block at a time; every task multiplies its rows with the block, a bounded tile of scores at a time, and
keeps its own top k for each query, so what is shuffled is tasks x queries x k rows. A block is bounded with what is kept for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.operators.vector_store import BLOCK_NUMBERS, Best, matrix


def top_k(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, label, score), best first; scores are rounded, ties go to the smaller id.

    ``queries``: (vec_id, embedding); ``rows``: (vec_id, embedding, label).
    """
    queries = queries.where("embedding IS NOT NULL")
    n, width = queries.count(), queries.select(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
    blocks = max(1, -(-n * (width + 3 * k) // BLOCK_NUMBERS))
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "embedding").toArrow()
        ids = block["vec_id"].to_numpy()
        shipped = rows.sparkSession.sparkContext.broadcast((ids, matrix(block["embedding"])))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            wanted, q = shipped.value
            best = Best(len(wanted), k)
            for batch in batches:
                if batch.num_rows and len(wanted):
                    label = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                    best.search(wanted, q, np.arange(len(wanted)), batch.column(0).to_numpy(), label, matrix(batch.column(1)), digits, exclude_self)
            some = np.isfinite(best.score)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(wanted, some.sum(axis=1))), pa.array(best.ids[some]), pa.array(best.label[some]), pa.array(best.score[some])], ["query_id", "vec_id", "label", "score"])

        one = rows.select("vec_id", "embedding", "label").where("embedding IS NOT NULL").mapInArrow(search, "query_id long, vec_id long, label long, score double")
        out = one if out is None else out.unionAll(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "label", "score")


def ranked_documents(hits: DataFrame) -> DataFrame:
    """(query_id, rank, doc, best): documents by their best hit, in order of first appearance."""
    best = hits.groupBy("query_id", F.col("label").alias("doc")).agg(F.max("score").alias("best"), F.min("rank").alias("first"))
    return best.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("bigint").alias("rank"), "doc", "best")


def retrieve(queries: DataFrame, rows: DataFrame, k: int, threshold: float, exclude_self: bool = False) -> DataFrame:
    """(query_id, top_score, empty, documents) for each query: its documents (doc, best, vec_ids) in the order of their first hits.

    A query whose first score is below the threshold, or that has no hits, is refused: ``empty``, without documents.
    """
    hits = top_k(queries, rows, k, exclude_self=exclude_self)
    first = hits.where("rank = 1").select("query_id", F.col("score").alias("top_score"))
    parts = hits.groupBy("query_id", F.col("label").alias("doc")).agg(F.min("rank").alias("first"), F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("own"))  # at most k
    each = F.struct("first", "doc", "best", F.col("own.vec_id").alias("vec_ids"))
    found = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(each)).alias("found"))
    every = queries.select(F.col("vec_id").alias("query_id")).join(first, "query_id", "left").join(found, "query_id", "left")
    empty = F.coalesce(F.col("top_score") < threshold, F.lit(True))
    documents = F.transform("found", lambda d: F.struct(d["doc"].alias("doc"), d["best"].alias("best"), d["vec_ids"].alias("vec_ids")))
    return every.select("query_id", "top_score", empty.alias("empty"), F.when(~empty, documents).otherwise(F.array()).alias("documents"))


def recall_at(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(query_id, k, recall): share of a query's true rows among its first k; null where it has none.

    ``truth``: (query_id, label, n_true): a hit is right if its label is the query's.
    """
    right = hits.join(truth, ["query_id", "label"])
    found = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"k{k}") for k in ks]
    counts = truth.select("query_id", "n_true").join(right.groupBy("query_id").agg(*found), "query_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.coalesce(F.col(f"k{k}"), F.lit(0)).alias("found")) for k in ks]))
    return counts.select("query_id", "n_true", each.alias("e")).select("query_id", "e.k", F.when(F.col("n_true") > 0, F.col("e.found") / F.col("n_true")).alias("recall"))


def score_ranges(first_scores: DataFrame) -> DataFrame:
    """(negative, n, lowest, highest) of the first scores of questions with and without an answer."""
    return first_scores.groupBy("negative").agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


def refusal_curve(first_scores: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, neg_refused, pos_retained) from (negative, score) of each query's first hit; one pass for all thresholds."""
    share = lambda hit, which: F.avg(F.when(which, F.when(hit, 1.0).otherwise(0.0)))
    made = [F.struct(F.lit(t).alias("threshold"), share(F.col("score") < t, F.col("negative")).alias("neg_refused"), share(F.col("score") >= t, ~F.col("negative")).alias("pos_retained")) for t in thresholds]
    return first_scores.agg(F.array(*made).alias("c")).select(F.explode("c").alias("c")).select("c.*")
