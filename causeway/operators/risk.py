"""Distinct-event outcome statistics, ranking, sensitivity and most probable paths.

Inputs are narrow tables: consequences (event_key, outcome, sure), entity events (entity, event_key) and causes. Everything counts
distinct events; an event has one outcome, its worst sure one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.functions.taxonomy import OUTCOMES, SMALL_SAMPLE, severity, weight

KEYS = [k for k, _ in OUTCOMES]


def worst_outcomes(consequences: DataFrame) -> DataFrame:
    """(event_key, worst, n_consequences, n_gated); worst is null where nothing passes the gate. One combinable aggregation."""
    known = consequences.where(F.col("outcome").isin(KEYS))
    best = F.max(F.when(F.col("sure"), weight(F.col("outcome"))))
    name = F.create_map(*[F.lit(x) for i, (k, s) in enumerate(OUTCOMES) for x in (s * 100 - i, k)])
    grouped = known.groupBy("event_key").agg(best.alias("w"), F.count("*").alias("n_consequences"), F.sum(F.when(F.col("sure"), 0).otherwise(1)).alias("n_gated"))
    return grouped.select("event_key", name[F.col("w")].alias("worst"), "n_consequences", "n_gated")


def entity_outcomes(entity_events: DataFrame, worst: DataFrame, *keys: str) -> DataFrame:
    """(keys, outcome, n) over distinct events; outcome is null for unclassified events."""
    keys = keys or ("entity",)
    distinct = entity_events.select(*keys, "event_key").distinct()
    return distinct.join(worst.select("event_key", "worst"), "event_key", "left").groupBy(*keys, F.col("worst").alias("outcome")).agg(F.count("*").alias("n"))


def stats(counts: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """(keys, n_events, n_classified, mass, modal, ``more``, expected_severity, small_sample, coverage) from entity outcome counts."""
    keys = keys or ("entity",)
    classed = F.col("outcome").isNotNull()
    mass = F.sum(F.when(classed, F.col("n") * severity(F.col("outcome"))).otherwise(0))
    n_classified = F.sum(F.when(classed, F.col("n")).otherwise(0))
    modal = F.max_by("outcome", F.when(classed, F.struct(F.col("n"), weight(F.col("outcome")))))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("n_events"), n_classified.alias("n_classified"), mass.cast("bigint").alias("mass"), modal.alias("modal"), *more)
    return out.withColumn("expected_severity", F.when(F.col("n_classified") == 0, 0.0).otherwise(F.col("mass") / F.col("n_classified"))).withColumns({"small_sample": F.col("n_classified") <= SMALL_SAMPLE, "coverage": F.col("n_classified") / F.col("n_events")})


def distribution(entity_events: DataFrame, worst: DataFrame) -> DataFrame:
    """One entity's outcomes with shares, totals, expected severity, the modal class and the small-sample flag."""
    counts = entity_outcomes(entity_events.withColumn("entity", F.lit(1)), worst)
    whole = stats(counts, more=(F.collect_list(F.struct("outcome", "n")).alias("each"),))  # a few classes: events are counted once
    return whole.select("*", F.inline("each")).where(F.col("outcome").isNotNull()).select(
        "outcome", severity(F.col("outcome")).cast("bigint").alias("severity"), "n", (F.col("n") / F.col("n_classified")).alias("p"), "n_events", "n_classified",
        "expected_severity", (F.col("outcome") == F.col("modal")).alias("is_modal"), "small_sample",
    )


def materialized(counts: DataFrame, version: str, as_of: str, *keys: str) -> DataFrame:
    """Statistics as they are stamped on hubs: counts and shares as maps, figures to 4 places, with the version and time of the stamp."""
    keys = keys or ("entity",)
    classed = F.col("outcome").isNotNull()
    pairs = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(classed, F.struct("outcome", "n")))).alias("counts"))  # eight classes at most
    both = stats(counts, *keys).join(pairs, list(keys))
    ordered = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))  # noqa: E731  equal statistics are equal texts
    shares = F.transform_values("counts", lambda _, n: F.round(n / F.col("n_classified"), 4))
    return both.select(*keys, "n_events", "n_classified", F.round("expected_severity", 4).alias("expected_severity"), F.col("mass").alias("contribution"), "small_sample", F.to_json(ordered("counts")).alias("counts_json"), F.to_json(ordered(shares)).alias("dist_json"), F.lit(version).alias("version"), F.lit(as_of).alias("materialized_at"))


def read_stats(table: DataFrame) -> DataFrame:
    """Stamped statistics with their counts as maps again."""
    return table.where("contribution IS NOT NULL").withColumn("counts", F.from_json("counts_json", "map<string,bigint>")).drop("counts_json", "dist_json")


def ranked(table: DataFrame, top: int, least: int = 1) -> DataFrame:
    """The ``top`` entities by severity mass; ties by name. The limit comes first, so the window sees a few rows."""
    best = table.where(F.col("n_classified") >= least).orderBy(F.desc("mass"), "entity").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mass"), "entity")).cast("bigint"))


def sensitivity(spark: SparkSession, counts: DataFrame, candidates: int = 40, top: int = 3) -> DataFrame:
    """(n_worlds, frac_top3_stable, frac_rank1_stable, robust): every severity moved by -1, 0 or 1, clamped to 1..5.

    6,561 worlds are 3**8 digits of a range; the candidate table is bounded by ``candidates``, so it is broadcast.
    """
    total = stats(counts).where("n_classified >= 1")
    chosen = total.orderBy(F.desc("n_classified"), "entity").limit(candidates).select("entity", F.col("mass").alias("base"))
    per_class = [F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, k in enumerate(KEYS)]
    wide = counts.join(F.broadcast(chosen), "entity").groupBy("entity", "base").agg(*per_class)
    digit = lambda i: (F.floor(F.col("id") / 3**i) % 3) - 1
    moved: Column = F.lit(0)
    for i, (_, s) in enumerate(OUTCOMES):
        moved = moved + F.col(f"c{i}") * F.greatest(F.lit(1), F.least(F.lit(5), F.lit(s) + digit(i)))
    worlds = spark.range(3 ** len(OUTCOMES)).join(F.broadcast(wide)).select("id", "entity", "base", moved.alias("mass"))
    place = worlds.withColumn("now", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("mass"), F.desc("base"), "entity")))
    place = place.withColumn("was", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("base"), "entity")))
    by_world = place.groupBy("id").agg(F.min(F.when((F.col("now") <= top) != (F.col("was") <= top), 0).otherwise(1)).alias("same"), F.max(F.when((F.col("now") == 1) & (F.col("was") == 1), 1).otherwise(0)).alias("first"))
    return by_world.agg(F.count("*").alias("n_worlds"), F.avg("same").alias("frac_top3_stable"), F.avg("first").alias("frac_rank1_stable"), (F.avg("same") >= 0.95).alias("robust"))


def coded(causes: DataFrame, provisional: str) -> DataFrame:
    """(event_key, cause): one coded category for each event, the least by name if there are several."""
    return causes.where(F.col("category") != provisional).groupBy("event_key").agg(F.min("category").alias("cause"))


def event_chains(events: DataFrame, entity_events: DataFrame, cause_of: DataFrame, worst: DataFrame) -> DataFrame:
    """(event_key, entities, cause, worst) of every event: what transitions are summed from. Entities are sorted and may be none."""
    entities = entity_events.groupBy("event_key").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    rows = events.select("event_key").distinct().join(entities, "event_key", "left").join(cause_of.select("event_key", "cause"), "event_key", "left").join(worst.select("event_key", "worst"), "event_key", "left")
    return rows.select("event_key", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "cause", "worst")


def transitions(rows: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, n, total, p) from distinct (event_key, source, target)."""
    counts = rows.select("event_key", source, target).distinct().groupBy(source, target).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(source))
    return counts.select(source, target, "n", total.alias("total"), (F.col("n") / total).alias("p"))


def probable_paths(entity_events: DataFrame, cause_of: DataFrame, worst: DataFrame) -> DataFrame:
    """Per entity its most probable cause and outcome: argmax of p(cause | entity) * p(outcome | cause).

    Three layers make the shortest-path search a join and an argmax. Ties: larger joint (to 12 places), outcome by name, larger p(cause), cause.
    """
    first = transitions(entity_events.select("entity", "event_key").distinct().join(cause_of, "event_key"), "entity", "cause")
    second = transitions(cause_of.join(worst.where("worst IS NOT NULL"), "event_key").select("event_key", "cause", F.col("worst").alias("outcome")), "cause", "outcome")
    first = first.select("entity", "cause", F.col("n").alias("n1"), F.col("p").alias("p_cause"))
    # causes and outcomes are small vocabularies: at most a few dozen rows
    second = second.select(F.col("cause").alias("via"), "outcome", F.col("n").alias("n2"), F.col("p").alias("p_outcome"))
    paths = first.join(second, F.col("cause") == F.col("via")).withColumn("joint", F.round(F.col("p_cause") * F.col("p_outcome"), 12))
    order = Window.partitionBy("entity").orderBy(F.desc("joint"), "outcome", F.desc("p_cause"), "cause")
    best = paths.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("entity", "cause", "p_cause", "outcome", "p_outcome", "joint", F.least("n1", "n2").alias("min_support"))
