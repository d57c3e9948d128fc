"""Catalogue: vector search, evaluation, sinks and dimension joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import evaluation, retrieval, vector_store, vectors
from causeway.operators.storage import materialize, new_path
from causeway.plans import proxy
from causeway.plans.registry import query
from causeway.plans.shipping import ship
from causeway.sources import records

KS = (1, 2, 5, 10, 20, 50, 100)
THRESHOLDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
#: Vectors whose id is divisible by this are the queries, searched against all rows.
EVERY = 20

_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_SCORED = f"WITH s AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id, b.label, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


def _hits(spark, sf_dir, k: int):
    ship(spark)
    rows = proxy.table(spark, sf_dir, "embeddings")
    return vectors.top_k(rows.where(F.col("vec_id") % EVERY == 0), rows, k, exclude_self=True)


@query("vector_topk", _SCORED + " SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 8")
def vector_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 8).select("query_id", "rank", "vec_id", "score")


@query("vector_ranked_docs", _SCORED + ", d AS (SELECT query_id, label AS doc, max(score) AS best, min(rank) AS first FROM r WHERE rank <= 100 GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank, CAST(doc AS BIGINT) AS doc, best FROM d")
def vector_ranked_docs(spark, sf_dir):
    return vectors.ranked_documents(_hits(spark, sf_dir, 100))


@query("vector_recall_at_k", _SCORED + f", t AS (SELECT query_id, count(*) FILTER (WHERE label = own) AS n_true FROM s GROUP BY 1), k(k) AS (VALUES {', '.join(f'({k})' for k in KS)}) SELECT query_id, CAST(k AS BIGINT) AS k, CASE WHEN n_true > 0 THEN CAST(count(*) FILTER (WHERE rank <= k AND label = own) AS DOUBLE) / n_true END AS recall FROM r JOIN t USING (query_id), k GROUP BY query_id, k, n_true")
def vector_recall_at_k(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "embeddings")
    sizes = rows.groupBy("label").agg((F.count("*") - 1).alias("n_true"))
    truth = rows.where(F.col("vec_id") % EVERY == 0).join(sizes, "label").select(F.col("vec_id").alias("query_id"), F.col("label").cast("bigint").alias("label"), "n_true")
    return vectors.recall_at(_hits(spark, sf_dir, max(KS)), truth, KS)


#: Chunks that documents are ranked by.
POOL = 1_500


def _store(spark, sf_dir):
    """A store of the vectors, and its hits for every twentieth of them."""
    rows = proxy.table(spark, sf_dir, "embeddings")
    path = new_path(spark, "store")
    vector_store.write_store(rows.select("vec_id", "embedding", "label"), path)
    return rows, vector_store.search(rows.where(F.col("vec_id") % EVERY == 0), path, POOL, exclude_self=True)


_UNIT = "SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings"
_POOL = f"WITH v AS ({_UNIT}), s AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id, round(list_inner_product(a.u, b.u), 6) AS score FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


@query("vector_store_topk", _POOL + f" SELECT query_id, rank, vec_id FROM r WHERE rank <= {POOL}")
def vector_store_topk(spark, sf_dir):
    return _store(spark, sf_dir)[1][0].select("query_id", "rank", "vec_id")


@query("vector_pool_recall", _POOL + f""", h AS (SELECT query_id, vec_id // 4 AS doc, min(rank) AS first FROM r WHERE rank <= {POOL} GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM h),
t AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id // 4 AS doc FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % {EVERY} = 0), k(k) AS (VALUES {', '.join(f'({k})' for k in KS)})
SELECT t.query_id, CAST(k AS BIGINT) AS k, count(*) AS n_true, CAST(count(d.doc) FILTER (WHERE place <= k) AS DOUBLE) / count(*) AS recall FROM t LEFT JOIN d ON d.query_id = t.query_id AND d.doc = t.doc, k GROUP BY ALL""")
def vector_pool_recall(spark, sf_dir):
    """Documents of four vectors each, ranked by their best one among the first 1,500; those with a vector of the query's label are wanted."""
    rows, (hits, _) = _store(spark, sf_dir)
    owners = rows.select("vec_id", F.floor(F.col("vec_id") / 4).alias("doc"), "label")
    asked = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    truth = asked.join(owners.select("doc", "label").distinct(), "label").select("query_id", "doc")
    return vector_store.prefix_recall(hits, owners.select("vec_id", "doc"), truth, KS)


@query("vector_retrieve", _SCORED + ", d AS (SELECT query_id, label, min(rank) AS first, max(score) AS best FROM r WHERE rank <= 10 GROUP BY ALL) SELECT query_id, max(best) AS top_score, max(best) < 0.5 AS empty, CASE WHEN max(best) < 0.5 THEN 0 ELSE count(*) END AS n_docs, CASE WHEN max(best) >= 0.5 THEN string_agg(CAST(label AS VARCHAR), ',' ORDER BY first) ELSE '' END AS docs FROM d GROUP BY query_id")
def vector_retrieve(spark, sf_dir):
    ship(spark)
    rows = proxy.table(spark, sf_dir, "embeddings")
    got = vectors.retrieve(rows.where(F.col("vec_id") % EVERY == 0), rows, 10, 0.5, exclude_self=True)
    return got.select("query_id", "top_score", "empty", F.size("documents").cast("bigint").alias("n_docs"), F.array_join(F.transform("documents", lambda d: d["doc"].cast("string")), ",").alias("docs"))


@query("latest_filings", """WITH s AS (SELECT o_orderkey AS pos, CAST(o_custkey AS VARCHAR) AS report, CAST(o_orderkey % 997 AS VARCHAR) AS accession, o_orderkey % 5 AS revision FROM orders),
n AS (SELECT *, min(pos) OVER (PARTITION BY report) AS f, row_number() OVER (PARTITION BY report ORDER BY revision DESC, pos) AS k FROM s), a AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY f) AS j FROM n WHERE k = 1)
SELECT pos, report, accession, revision FROM a WHERE j = 1""")
def latest_filings(spark, sf_dir):
    o = proxy.table(spark, sf_dir, "orders")
    return records.latest_filings(o.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("report"), (F.col("o_orderkey") % 997).cast("string").alias("accession"), (F.col("o_orderkey") % 5).alias("revision")))


@query("vector_refusal_curve", _SCORED + f", f AS (SELECT own % 2 = 1 AS negative, score FROM r WHERE rank = 1), t(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) SELECT threshold, avg(CASE WHEN score < threshold THEN 1.0 ELSE 0.0 END) FILTER (WHERE negative) AS neg_refused, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT negative) AS pos_retained FROM f, t GROUP BY threshold")
def vector_refusal_curve(spark, sf_dir):
    own = proxy.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2 == 1).alias("negative"))
    return vectors.refusal_curve(_hits(spark, sf_dir, 1).join(own, "query_id").select("negative", "score"), THRESHOLDS)


@query("vector_score_ranges", _SCORED + " SELECT own % 2 = 1 AS negative, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM r WHERE rank = 1 GROUP BY 1")
def vector_score_ranges(spark, sf_dir):
    own = proxy.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2 == 1).alias("negative"))
    return vectors.score_ranges(_hits(spark, sf_dir, 1).join(own, "query_id").select("negative", "score"))


_SETS = "WITH pred AS (SELECT DISTINCT l_returnflag AS type, l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_tax >= 0.02), gold AS (SELECT DISTINCT l_returnflag AS type, l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 10)"
_PRF = 'CAST(tp AS DOUBLE) / pred AS p, CAST(tp AS DOUBLE) / "true" AS r, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * (CAST(tp AS DOUBLE) / pred) * (CAST(tp AS DOUBLE) / "true") / (CAST(tp AS DOUBLE) / pred + CAST(tp AS DOUBLE) / "true") END AS f1'


def _pred_gold(spark, sf_dir):
    li = proxy.table(spark, sf_dir, "lineitem")
    pick = lambda cond: li.where(cond).select(F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    return pick("l_tax >= 0.02D"), pick("l_quantity >= 10")


@query("prf_exact", _SETS + f", c AS (SELECT type, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a) AS pred, count(*) FILTER (WHERE b) AS \"true\" FROM (SELECT coalesce(pred.type, gold.type) AS type, pred.o IS NOT NULL AS a, gold.o IS NOT NULL AS b FROM pred FULL JOIN gold USING (type, o, p)) GROUP BY type) SELECT type, tp, pred, \"true\", {_PRF} FROM c")
def prf_exact(spark, sf_dir):
    return evaluation.compare_sets(*_pred_gold(spark, sf_dir), ["type"])


@query("edge_prf", _SETS + f", c AS (SELECT (SELECT count(*) FROM (SELECT * FROM pred INTERSECT SELECT * FROM gold)) AS tp, (SELECT count(*) FROM pred) AS pred, (SELECT count(*) FROM gold) AS \"true\") SELECT tp, pred, \"true\", {_PRF} FROM c")
def edge_prf(spark, sf_dir):
    pred, gold = _pred_gold(spark, sf_dir)
    return evaluation.compare_sets(pred.withColumn("all", F.lit(1)), gold.withColumn("all", F.lit(1)), ["all"]).drop("all")


_RULE = "WITH x AS (SELECT CAST(quality AS BIGINT) AS gold, CAST(n_chars >= 800 AS BIGINT) AS pred, n_chars < 100 AS unsure FROM labels LEFT JOIN documents USING (doc_id))"


def _rule(spark, sf_dir):
    docs, marks = proxy.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), proxy.table(spark, sf_dir, "labels")
    return marks.join(docs, "doc_id", "left").select(F.col("quality").cast("bigint").alias("gold"), (F.col("n_chars") >= 800).cast("bigint").alias("pred"), (F.col("n_chars") < 100).alias("unsure"))


@query("confusion_matrix", _RULE + " SELECT gold, pred, count(*) AS n FROM x GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_rule(spark, sf_dir), "gold", "pred")


@query("classifier_accuracy", _RULE + " SELECT count(*) AS n, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (WHERE unsure) AS gated FROM x")
def classifier_accuracy(spark, sf_dir):
    right = F.avg(F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0))
    return _rule(spark, sf_dir).agg(F.count("*").alias("n"), right.alias("accuracy"), F.sum(F.when(F.col("unsure"), 1).otherwise(0)).alias("gated"))


@query("boundary_accuracy", """WITH x AS (SELECT CAST(quality AS BIGINT) AS gold, CAST(n_chars >= 800 AS BIGINT) AS pred, least(n_chars / 1000.0, 1.0) AS confidence FROM labels LEFT JOIN documents USING (doc_id))
SELECT count(*) AS n, coalesce(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 0.0) AS accuracy, count(*) FILTER (WHERE confidence < 0.5) AS gated, count(*) FILTER (WHERE gold = 1) AS boundary_n,
avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) FILTER (WHERE gold = 1) AS boundary_accuracy FROM x WHERE pred IS NOT NULL""")
def boundary_accuracy(spark, sf_dir):
    docs, marks = proxy.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), proxy.table(spark, sf_dir, "labels")
    rows = marks.join(docs, "doc_id", "left").select(F.col("quality").cast("bigint").alias("gold"), (F.col("n_chars") >= 800).cast("bigint").alias("pred"), F.least(F.col("n_chars") / 1000, F.lit(1.0)).alias("confidence"))
    return evaluation.accuracy(rows, [1], 0.5)


def _any(phrases):
    return "(" + " OR ".join(f"contains(t, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


@query("answer_framing", f"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, {_any(evaluation.OF_CORPUS)} AND {_any(evaluation.OBSERVED)} AS corpus, {_any(evaluation.COUNTED)} AS counts, {_any(evaluation.NO_RATE)} AS declines FROM a""")
def answer_framing(spark, sf_dir):
    return proxy.table(spark, sf_dir, "documents").select("doc_id", evaluation.framing(F.col("text")).alias("f")).select("doc_id", "f.*")


_ALIGNED = """WITH l AS (SELECT l_orderkey AS record, CAST(l_linenumber AS VARCHAR) AS key, min(l_returnflag) AS flag, min(l_linestatus) AS eiis_code, min(l_quantity) <= 20 AS hit FROM lineitem GROUP BY 1, 2),
g AS (SELECT record, key, CASE WHEN flag = 'N' THEN 'CorrectiveAction' ELSE 'Component' END AS type, eiis_code, eiis_code = 'O' AS provisional, hit FROM l)"""


def _aligned(spark, sf_dir):
    li = proxy.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record"), F.col("l_linenumber").cast("string").alias("key"))
    lines = li.agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("eiis_code"), (F.min("l_quantity") <= 20).alias("hit"))
    kind = F.when(F.col("flag") == "N", "CorrectiveAction").otherwise("Component")
    gold = lines.select("record", "key", kind.alias("type"), "eiis_code", (F.col("eiis_code") == "O").alias("provisional"), "hit")
    return gold.drop("hit"), gold.where("hit").select("record", "key")


@query("node_scores_excused", _ALIGNED + """, c AS (SELECT record, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE eiis_code = 'O' OR hit) AS pred, count(*) FILTER (WHERE NOT hit AND type = 'CorrectiveAction' AND provisional) AS excused, count(*) AS gold FROM g GROUP BY record),
d AS (SELECT record, tp, pred, gold - excused AS "true", excused, CASE WHEN pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pred END AS p, CASE WHEN gold = excused THEN 0.0 ELSE CAST(tp AS DOUBLE) / (gold - excused) END AS r FROM c)
SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM d""")
def node_scores_excused(spark, sf_dir):
    gold, matched = _aligned(spark, sf_dir)
    extracted = gold.where("eiis_code = 'O'").select("record", "key").union(matched).distinct()
    return evaluation.node_scores(extracted, gold, matched)


@query("unresolved_coded", _ALIGNED + " SELECT record, key, eiis_code FROM g WHERE NOT hit AND type = 'Component' AND eiis_code <> ''")
def unresolved_coded(spark, sf_dir):
    gold, matched = _aligned(spark, sf_dir)
    return evaluation.missed_nodes(gold, matched).where("unresolved").select("record", "key", "eiis_code")


_SPECS = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, ['negative', 'lookup-id', 'lookup-content', 'multi-hop', 'cross-doc', 'risk'][1 + o_orderkey % 6] AS bucket, o_orderstatus <> 'P' AS answerable, o_totalprice > 1000 AS fact FROM orders),
l AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 7)) AS surfaced, list_sort(list(DISTINCT l_partkey % 7) FILTER (WHERE l_returnflag = 'A')) AS cites, list_sort(list(DISTINCT l_suppkey % 7) FILTER (WHERE l_returnflag = 'R')) AS expected FROM lineitem GROUP BY 1),
s AS (SELECT o.*, coalesce(surfaced, []) AS surfaced, coalesce(cites, []) AS cites, coalesce(expected, []) AS expected FROM o LEFT JOIN l USING (k))"""


def _specs(spark, sf_dir):
    """Questions, one for each order: what its lines' suppliers surface, parts cite, and returned lines' suppliers are wanted."""
    o, li = proxy.table(spark, sf_dir, "orders"), proxy.table(spark, sf_dir, "lineitem")
    buckets = F.array(*[F.lit(b) for b in ("negative", "lookup-id", "lookup-content", "multi-hop", "cross-doc", "risk")])
    found = lambda cond, c: F.collect_set(F.when(cond, (F.col(c) % 7).cast("string")))
    flag = F.col("l_returnflag")
    sets = li.groupBy(F.col("l_orderkey").alias("k")).agg(found(F.lit(True), "l_suppkey").alias("surfaced"), found(flag == "A", "l_partkey").alias("cites"), found(flag == "R", "l_suppkey").alias("expected"))
    rows = o.select(F.col("o_orderkey").alias("k"), F.get(buckets, (F.col("o_orderkey") % 6).cast("int")).alias("bucket"), (F.col("o_orderstatus") != "P").alias("answerable"), (F.col("o_totalprice") > 1000).alias("fact"), F.col("o_custkey").alias("u")).join(sets, "k", "left")
    nothing = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, nothing) for c in ("surfaced", "cites", "expected")})


_GROUNDED = "list_has_all(surfaced, cites)"
_CITED = "list_has_all(cites, expected)"


@query("golden_judge", _SPECS + f""" SELECT k AS id, CAST(CASE bucket WHEN 'negative' THEN NOT answerable AND len(cites) = 0 WHEN 'lookup-id' THEN answerable AND {_GROUNDED} AND {_CITED} AND fact WHEN 'lookup-content' THEN answerable AND {_GROUNDED} AND fact
WHEN 'multi-hop' THEN answerable AND {_GROUNDED} AND {_CITED} WHEN 'cross-doc' THEN len(expected) > 0 AND len(list_intersect(expected, surfaced)) >= 0.8 * len(expected) ELSE false END AS DOUBLE) AS correct FROM s""")
def golden_judge(spark, sf_dir):
    return evaluation.judged(_specs(spark, sf_dir)).select(F.col("k").alias("id"), "correct")


_KINDS = ("clarify", "intent", "negative", "payoff", "risk", "honesty", "lookup", "showcase", "general")


@query("judged_by_kind", _SPECS + f""", j AS (SELECT *, {list(_KINDS)}[1 + u % 9] AS kind, k % 4 = 0 AS clarified, k % 5 > 0 AS routed, CASE WHEN k % 3 = 0 THEN k % 10 END AS total, CASE WHEN u % 2 = 0 THEN 3 END AS least,
 'In this corpus we observed ' || k || CASE WHEN k % 2 = 0 THEN ' events' ELSE ' things' END || CASE WHEN k % 7 < 4 THEN ', not a failure rate.' ELSE '.' END AS answer FROM s),
a AS (SELECT *, len(surfaced) = 0 AS none, len(expected) = 0 OR len(list_intersect(expected, surfaced)) >= 0.8 * len(expected) AS found FROM j)
SELECT kind, count(*) FILTER (WHERE ok) AS passed, count(*) AS total FROM (SELECT kind, CASE WHEN clarified THEN CASE kind WHEN 'lookup' THEN true WHEN 'clarify' THEN routed AND coalesce(total, 0) >= coalesce(least, 2) AND (list_contains(surfaced, 3) OR coalesce(total, 0) > len(surfaced)) ELSE false END
 ELSE CASE kind WHEN 'clarify' THEN false WHEN 'intent' THEN routed WHEN 'negative' THEN NOT answerable AND len(cites) = 0 WHEN 'payoff' THEN routed AND NOT none AND answerable WHEN 'risk' THEN NOT none AND routed AND answerable AND k % 2 = 0
 WHEN 'honesty' THEN routed AND answerable AND k % 7 < 4 WHEN 'lookup' THEN CASE WHEN answerable THEN {_GROUNDED} ELSE len(cites) = 0 END
 ELSE routed AND found AND answerable AND {_GROUNDED} AND len(surfaced) >= coalesce(least, 0) AND (kind <> 'showcase' OR {_CITED}) END END AS ok FROM a) GROUP BY kind""")
def judged_by_kind(spark, sf_dir):
    """Outcomes of questions by the rule of their kind, the reports found being those surfaced."""
    k = F.col("k")
    kinds = F.array(*[F.lit(x) for x in _KINDS])
    answer = F.concat(F.lit("In this corpus we observed "), k.cast("string"), F.when(k % 2 == 0, " events").otherwise(" things"), F.when(k % 7 < 4, ", not a failure rate.").otherwise("."))
    rows = _specs(spark, sf_dir).select(
        F.get(kinds, (F.col("u") % 9).cast("int")).alias("kind"), F.lit("asked").alias("intent"), F.when(k % 5 > 0, "asked").otherwise("other").alias("routed"), F.lit(None).cast("array<string>").alias("ok_intents"),
        (k % 4 == 0).alias("clarified"), F.coalesce(F.when(k % 3 == 0, k % 10), F.lit(0)).alias("total"), F.col("surfaced").alias("offered"), F.when(F.col("u") % 2 == 0, 3).alias("least"), F.lit("3").alias("must_include"), answer.alias("answer"),
        "answerable", "cites", F.col("surfaced").alias("reports"), F.col("surfaced").alias("nodes"), F.col("expected").alias("want_reports"), F.array().cast("array<string>").alias("want_nodes"),
    )
    return evaluation.judged_by_kind(rows).groupBy("kind").agg(F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("passed"), F.count("*").alias("total"))


@query("same_sets", _SPECS + " SELECT bucket, count(*) FILTER (WHERE list_sort(surfaced) = list_sort(expected)) AS same, count(*) FILTER (WHERE list_has_all(surfaced, expected)) AS within FROM s GROUP BY bucket")
def same_sets(spark, sf_dir):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("surfaced"), F.col("expected")
    twice = F.concat(b, b)  # repeated members count once
    return _specs(spark, sf_dir).groupBy("bucket").agg(count(evaluation.same_set(a, twice)).alias("same"), count(evaluation.subset(b, a)).alias("within"))


@query("gate_of_records", """WITH g AS (SELECT o_orderstatus AS status, bool_and(o_custkey % 2 = 0 AND o_orderkey > 0 AND o_totalprice >= 0.85) AS passed FROM orders GROUP BY 1) SELECT 'all' AS side, bool_and(passed) AS passed FROM g UNION ALL SELECT 'even', true""")
def gate_of_records(spark, sf_dir):
    """All orders, of which some fail, and those with an even customer, of which none does."""
    o = proxy.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 2 == 0).alias("identity_ok"), (F.col("o_orderkey") >= 0).alias("cause_ok"), F.col("o_totalprice").alias("edge_f1"))
    side = lambda rows, name: evaluation.gate(rows).select(F.lit(name).alias("side"), "passed")
    return side(o, "all").unionAll(side(o.where("identity_ok AND edge_f1 >= 0.85D"), "even"))


@query("bucket_win_tie_loss", """WITH x AS (SELECT source AS bucket, CAST(quality AS DOUBLE) AS g, CAST(toxic AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id))
SELECT bucket, count(*) AS n, count(*) FILTER (WHERE g - v > 0.05) AS win, count(*) FILTER (WHERE abs(g - v) <= 0.05) AS tie, count(*) FILTER (WHERE g - v < -0.05) AS loss,
CASE WHEN round(avg(g) - avg(v), 9) > 0.05 THEN 'win' WHEN round(avg(g) - avg(v), 9) < -0.05 THEN 'loss' ELSE 'tie' END AS verdict FROM x GROUP BY bucket""")
def bucket_win_tie_loss(spark, sf_dir):
    docs, marks = proxy.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("bucket")), proxy.table(spark, sf_dir, "labels")
    rows = marks.join(docs, "doc_id").select("bucket", F.col("quality").cast("double").alias("g"), F.col("toxic").cast("double").alias("v"))
    return evaluation.win_tie_loss(rows, "bucket", "g", "v")


@query("pass_by_kind", "SELECT coalesce(lang, 'all') AS kind, count(*) FILTER (WHERE quality = 1) AS passed, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def pass_by_kind(spark, sf_dir):
    docs, marks = proxy.table(spark, sf_dir, "documents").select("doc_id", "lang"), proxy.table(spark, sf_dir, "labels")
    rows = marks.join(docs, "doc_id").rollup("lang").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("passed"), F.count("*").alias("total"))
    return rows.select(F.coalesce("lang", F.lit("all")).alias("kind"), "passed", "total")


@query("snapshot_identity", """WITH f AS (SELECT o_orderstatus AS status, o_custkey % 50 AS c FROM orders), s AS (SELECT CASE WHEN o_totalprice > 5000 AND o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END, o_custkey % 50 FROM orders WHERE o_orderkey % 13 <> 0)
SELECT 'same' AS run, 0 AS only_left, 0 AS only_right UNION ALL SELECT 'changed', (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM f)), (SELECT count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s))""")
def snapshot_identity(spark, sf_dir):
    """A written table against a fresh reading, unchanged and with rows changed and missing."""
    o = proxy.table(spark, sf_dir, "orders")
    rows = lambda status, df: df.select(status.alias("status"), (F.col("o_custkey") % 50).alias("c"))
    fresh = rows(F.col("o_orderstatus"), o)
    changed = F.when((F.col("o_totalprice") > 5000) & (F.col("o_orderkey") % 9 == 0), "X").otherwise(F.col("o_orderstatus"))
    sides = {"same": materialize(fresh.repartition(3), "snapshot"), "changed": materialize(rows(changed, o.where("o_orderkey % 13 <> 0")), "snapshot")}
    made = [evaluation.identical(stored, fresh).select(F.lit(run).alias("run"), "only_left", "only_right") for run, stored in sides.items()]
    return made[0].unionAll(made[1])


@query("dedupe_latest_revision", "SELECT l_orderkey AS key, CAST(max(l_linenumber) AS BIGINT) AS revision FROM lineitem GROUP BY 1")
def dedupe_latest_revision(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("bigint").alias("revision"))
    return records.latest(rows, ["key"], F.desc("revision"))


@query("append_set_difference", "SELECT DISTINCT s_nationkey AS key FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def append_set_difference(spark, sf_dir):
    there = proxy.table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("key"))
    return records.missing_rows(proxy.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")), there)


@query("manifest_upsert", "SELECT p_partkey AS key, 'old ' || p_name AS value FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, 'new ' || p_brand FROM part WHERE p_size % 3 = 0")
def manifest_upsert(spark, sf_dir):
    part = proxy.table(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("old "), "p_name").alias("value"))
    new = part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("key"), F.concat(F.lit("new "), "p_brand").alias("value"))
    return records.upsert(old, new, ["key"])


@query("reconciliation", """SELECT o_orderpriority <> '1-URGENT' AS rest, count(*) AS requested, count(*) FILTER (WHERE o_orderstatus = 'F') AS written, count(*) FILTER (WHERE o_orderstatus = 'O') AS cached, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT') AS failed,
written + cached + failed AS accounted, accounted = requested AS ok FROM orders GROUP BY 1""")
def reconciliation(spark, sf_dir):
    """Statuses of orders; those of urgent ones that are open nobody accounts for."""
    o = proxy.table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "written").when(F.col("o_orderstatus") == "O", "cached").when(F.col("o_orderpriority") != "1-URGENT", "failed")
    rows = o.select((F.col("o_orderpriority") != "1-URGENT").alias("rest"), state.alias("status"))
    made = [evaluation.reconciled(rows.where(F.col("rest") == side), "status").select(F.lit(side).alias("rest"), "*") for side in (True, False)]
    return made[0].unionAll(made[1])


@query("cost_projection", """WITH u AS (SELECT sum(l_quantity) * 3.0 / 1e6 * 0.5 + sum(l_linenumber) * 15.0 / 1e6 * 0.5 AS spent, count(DISTINCT l_orderkey) AS n_done FROM lineitem)
SELECT round(spent, 9) AS spent, n_done, round(spent / n_done, 12) AS each, round(spent / n_done * (SELECT count(*) FROM orders), 6) AS projected FROM u""")
def cost_projection(spark, sf_dir):
    asked = proxy.table(spark, sf_dir, "orders").count()
    made = evaluation.cost(proxy.table(spark, sf_dir, "lineitem"), {"l_quantity": 3.0, "l_linenumber": 15.0}, 0.5, "l_orderkey", asked)
    return made.select(F.round("spent", 9).alias("spent"), "n_done", F.round("each", 12).alias("each"), F.round("projected", 6).alias("projected"))


@query("plant_dimension_join", "SELECT o_orderkey AS event_key, n_name AS plant, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def plant_dimension_join(spark, sf_dir):
    nation, region = proxy.table(spark, sf_dir, "nation"), proxy.table(spark, sf_dir, "region")
    where = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left").select(F.col("n_name").alias("plant"), F.col("r_name").alias("region"))
    return proxy.events(spark, sf_dir).join(F.broadcast(where), "plant", "left").select("event_key", "plant", "region")


@query("provenance_lookup", "SELECT d AS key, coalesce(source, 'retrieval') AS source FROM (SELECT DISTINCT item_id * 37 AS d FROM benchmark) LEFT JOIN (SELECT doc_id, min(s) AS source FROM (SELECT doc_id, coalesce(source, 'zz') AS s FROM documents UNION ALL SELECT doc_id, 'm' FROM labels) GROUP BY 1) ON d = doc_id")
def provenance_lookup(spark, sf_dir):
    """Where documents come from: of several sources the first by name; what is unknown was found by retrieval."""
    asked = proxy.table(spark, sf_dir, "benchmark").select((F.col("item_id") * 37).alias("key"))
    known = proxy.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("zz")).alias("source"))
    marked = proxy.table(spark, sf_dir, "labels").select("doc_id", F.lit("m"))
    return retrieval.provenance(asked, known.unionAll(marked))


@query("edge_integrity", """WITH n AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE p_size > 45) AS gone, count(*) FILTER (WHERE p_size = 13) AS odd FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS record, CASE WHEN o_custkey % 10 = 0 THEN 'unreadable' WHEN odd > 0 THEN 'unknown type' WHEN gone > 0 THEN 'edge without node' END AS reason FROM orders LEFT JOIN n ON k = o_orderkey""")
def edge_integrity(spark, sf_dir):
    """Orders as reports: large parts are no nodes of their reports but have edges, parts of one size have a type nobody knows."""
    li, part, o = (proxy.table(spark, sf_dir, n) for n in ("lineitem", "part", "orders"))
    own = li.join(part, li.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("p_size") <= 45, F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") == 13, "Gadget").otherwise("Component").alias("type")))).alias("parts"),
        F.collect_set(F.struct(F.lit("l").alias("source"), F.lit("INVOLVES").alias("relation"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("target"))).alias("edges"),
    )
    root = F.array(F.struct(F.lit("l").alias("id"), F.lit("LER").alias("type")))
    rows = o.join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    number = F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderkey").cast("string"))
    reports = rows.select(F.col("o_orderkey").alias("record"), number.alias("ler_number"), F.concat(root, F.coalesce("parts", F.array().cast("array<struct<id:string,type:string>>"))).alias("nodes"), F.coalesce("edges", F.array().cast("array<struct<source:string,relation:string,target:string>>")).alias("edges"), F.lit(None).cast("string").alias("_corrupt_record"))
    good, bad = records.validated(reports)
    return good.select("record", F.lit(None).cast("string").alias("reason")).unionAll(bad.select("record", "reason"))


@query("events_trend", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_trend(spark, sf_dir):
    ev = proxy.table(spark, sf_dir, "events")
    return ev.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour"), "event_type").agg(F.count("*").alias("n"))
