"""Evaluation: precision and recall, confusion, recall of retrieval, win/tie/loss, golden judging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two means closer than this are a tie.
EPS = 0.05
#: A corpus-wide answer needs this recall.
GOLDEN_RECALL = 0.8


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(tp: Column, pred: Column, true: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; every zero denominator gives 0."""
    p, r = ratio(tp, pred), ratio(tp, true)
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def compare_sets(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, pred, true, p, r, f1) of two tables with equal columns, whose repeated rows count once; one aggregation over their union."""
    both = pred.withColumn("_p", F.lit(1)).withColumn("_g", F.lit(0)).unionByName(gold.withColumn("_p", F.lit(0)).withColumn("_g", F.lit(1)))
    rows = both.groupBy(*pred.columns).agg(F.max("_p").alias("_p"), F.max("_g").alias("_g"))
    counts = rows.groupBy(*by).agg(F.sum(F.col("_p") * F.col("_g")).alias("tp"), F.sum("_p").alias("pred"), F.sum("_g").alias("true"))
    p, r, f = prf(F.col("tp"), F.col("pred"), F.col("true"))
    return counts.select(*by, "tp", "pred", "true", p.alias("p"), r.alias("r"), f.alias("f1"))


def set_recall(full: Column, got: Column) -> Column:
    return F.when(F.size(full) > 0, F.size(F.array_intersect(full, got)) / F.size(full))


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, answerable, cites, surfaced, expected, fact) with ``correct``.

    Citations must be surfaced; a negative question wants no answer and no citation, a lookup by number the cited report and the
    fact, a lookup by content the fact, and a multi-hop question the cited reports.
    """
    grounded, cited = subset(F.col("cites"), F.col("surfaced")), subset(F.col("expected"), F.col("cites"))
    b = F.col("bucket")
    right = (
        F.when(b == "negative", ~F.col("answerable") & (F.size("cites") == 0))
        .when(b == "lookup-id", F.col("answerable") & grounded & cited & F.col("fact"))
        .when(b == "lookup-content", F.col("answerable") & grounded & F.col("fact"))
        .when(b == "multi-hop", F.col("answerable") & grounded & cited)
        .when(b == "cross-doc", F.coalesce(set_recall(F.col("expected"), F.col("surfaced")) >= GOLDEN_RECALL, F.lit(False)))
        .otherwise(False)
    )
    return rows.withColumn("correct", F.when(right, 1.0).otherwise(0.0))


def win_tie_loss(rows: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """(by, n, win, tie, loss, verdict): rows and means of two scores, ties within EPS."""
    gap = F.round(F.col(left) - F.col(right), 9)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    means = F.round(F.avg(left) - F.avg(right), 9)
    verdict = F.when(means > EPS, "win").when(means < -EPS, "loss").otherwise("tie")
    return rows.groupBy(by).agg(F.count("*").alias("n"), count(gap > EPS).alias("win"), count(F.abs(gap) <= EPS).alias("tie"), count(gap < -EPS).alias("loss"), verdict.alias("verdict"))


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows of one table and not the other, as bags."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.join(F.broadcast(right))


def gate(rows: DataFrame, least_edge_f1: float = 0.85) -> DataFrame:
    """Whether all records pass: exact identity and cause fields and a high enough edge F1."""
    return rows.agg(F.bool_and(F.col("identity_ok") & F.col("cause_ok") & (F.col("edge_f1") >= least_edge_f1)).alias("passed"))


# Phrases that frame an answer.
OF_CORPUS = ("this corpus", "2020")
OBSERVED = ("observed", "reportable", "frequenc", "not a certified", "not certified", "selection", "most-represented", "most represented")
COUNTED = ("%", "percent", "event", "n=", "out of")
NO_RATE = ("not a failure rate", "not a rate", "no exposure", "reactor-year", "reactor year", "cannot give a rate", "can't give a rate", "not a certified rate", "observed frequency", "isn't a rate", "is not a rate", "rather than a rate")


def mentions(answer: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(p) for p in phrases))


def framing(answer: Column) -> Column:
    """(corpus, counts, declines): speaks of observations of this corpus, shows counts, declines to give a rate."""
    return F.struct((mentions(answer, OF_CORPUS) & mentions(answer, OBSERVED)).alias("corpus"), mentions(answer, COUNTED).alias("counts"), mentions(answer, NO_RATE).alias("declines"))


def retrieval_scores(rows: DataFrame) -> DataFrame:
    """``rows`` (want_nodes, nodes, want_reports, reports) with recall of both and what is missing; no recall where nothing is wanted."""
    missing = lambda want, got: F.array_sort(F.array_except(want, got))
    return rows.withColumns({"node_recall": set_recall(F.col("want_nodes"), F.col("nodes")), "report_recall": set_recall(F.col("want_reports"), F.col("reports")), "missing_nodes": missing("want_nodes", "nodes"), "missing_reports": missing("want_reports", "reports")})


def judged_by_kind(rows: DataFrame) -> DataFrame:
    """``rows`` of outcomes with ``ok`` by the rule of their kind.

    ``clarified`` tells a question back, with ``total`` candidates of which ``offered`` are shown, from an answer with ``reports`` and
    ``nodes`` as evidence. ``ok_intents`` may be null; ``least`` is the least number of candidates or of reports, and may be null.
    """
    c = F.col
    scored = retrieval_scores(rows)
    routed = c("routed") == c("intent")
    among = F.coalesce(F.array_contains("ok_intents", c("routed")), routed)
    frame, empty = framing(c("answer")), (F.size("nodes") == 0) & (F.size("reports") == 0)
    grounded = subset(c("cites"), c("reports"))
    enough = lambda recall: recall.isNull() | (recall >= GOLDEN_RECALL)
    shown = c("must_include").isNull() | F.array_contains("offered", c("must_include")) | (c("total") > F.size("offered"))
    asked_back = F.when(c("kind") == "lookup", True).when(c("kind") == "clarify", routed & (c("total") >= F.coalesce("least", F.lit(2))) & shown).otherwise(False)
    cited = (c("kind") != "showcase") | subset(c("want_reports"), c("cites"))
    rules = {
        "clarify": F.lit(False),
        "intent": routed,
        "negative": ~c("answerable") & (F.size("cites") == 0),
        "payoff": routed & ~empty & c("answerable"),
        "risk": ~empty & among & c("answerable") & frame["corpus"] & frame["counts"],
        "honesty": routed & c("answerable") & frame["declines"] & frame["corpus"],
        "lookup": F.when(c("answerable"), grounded).otherwise(F.size("cites") == 0),
    }
    broad = F.size(F.array_distinct("reports")) >= F.coalesce("least", F.lit(0))
    general = routed & enough(c("node_recall")) & enough(c("report_recall")) & c("answerable") & grounded & broad & cited
    answered = F.coalesce(*[F.when(c("kind") == kind, rule) for kind, rule in rules.items()], general)
    return scored.withColumn("ok", F.when(c("clarified"), asked_back).otherwise(answered))


def accuracy(rows: DataFrame, boundary: list, least: float) -> DataFrame:
    """(n, accuracy, gated, boundary_n, boundary_accuracy) of ``rows`` (gold, pred, confidence); rows without a prediction don't count."""
    right, hard = F.when(F.col("gold") == F.col("pred"), 1.0).otherwise(0.0), F.col("gold").isin(boundary)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return rows.where("pred IS NOT NULL").agg(F.count("*").alias("n"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), count(F.col("confidence") < least).alias("gated"), count(hard).alias("boundary_n"), F.avg(F.when(hard, right)).alias("boundary_accuracy"))


def missed_nodes(gold: DataFrame, matched: DataFrame) -> DataFrame:
    """Gold nodes (record, key, type, eiis_code, provisional) no extracted node matches, with ``excused`` and ``unresolved``.

    A provisional corrective action is excused; a system or component that has a code is unresolved.
    """
    rest = gold.join(matched.select("record", "key").distinct(), ["record", "key"], "left_anti")
    coded = F.col("type").isin("System", "Component") & (F.coalesce("eiis_code", F.lit("")) != "")
    return rest.withColumns({"excused": (F.col("type") == "CorrectiveAction") & F.coalesce("provisional", F.lit(False)), "unresolved": coded})


def node_scores(pred: DataFrame, gold: DataFrame, matched: DataFrame) -> DataFrame:
    """(record, tp, pred, true, excused, p, r, f1) per record; excused nodes don't count as true."""
    part = lambda rows, name: rows.groupBy("record").agg(F.count("*").alias(name))
    excused = missed_nodes(gold, matched).where("excused")
    sides = part(gold, "gold").join(part(pred, "pred"), "record", "full").join(part(matched, "tp"), "record", "left").join(part(excused, "excused"), "record", "left").na.fill(0)
    counts = sides.withColumn("true", F.col("gold") - F.col("excused"))
    p, r, f = prf(F.col("tp"), F.col("pred"), F.col("true"))
    return counts.select("record", "tp", "pred", "true", "excused", p.alias("p"), r.alias("r"), f.alias("f1"))


def reconciled(rows: DataFrame, status: str, written: str = "written", cached: str = "cached", failed: str = "failed") -> DataFrame:
    """(requested, written, cached, failed, accounted, ok) of one row for each thing requested; a null or other status is unaccounted for."""
    count = lambda name: F.sum(F.when(F.col(status) == name, 1).otherwise(0))
    counts = rows.agg(F.count("*").alias("requested"), *[F.coalesce(count(n), F.lit(0)).alias(k) for k, n in (("written", written), ("cached", cached), ("failed", failed))])
    total = F.col("written") + F.col("cached") + F.col("failed")
    return counts.withColumns({"accounted": total, "ok": total == F.col("requested")})


def cost(usage: DataFrame, prices: dict[str, float], discount: float, done: str, target: Column | int) -> DataFrame:
    """(spent, n_done, each, projected) of ``usage``: sums of its columns at ``prices`` a million, discounted, and as much for ``target`` things.

    ``done`` names what was paid for; nothing done projects nothing.
    """
    paid = reduce(lambda a, b: a + b, (F.coalesce(F.sum(c), F.lit(0)) * price for c, price in prices.items())) / 1e6 * discount
    spent = usage.agg(paid.alias("spent"), F.countDistinct(done).alias("n_done"))
    each = F.when(F.col("n_done") > 0, F.col("spent") / F.col("n_done"))
    return spent.withColumn("each", each).withColumn("projected", F.col("each") * (target if isinstance(target, Column) else F.lit(target)))
