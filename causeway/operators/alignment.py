"""Extracted records against curated ones: nodes are aligned one to one, then edges and fields are compared.

Nodes: (record, pos, type, match_key, display_name, eiis_code, provisional), ``pos`` being the order within a record. Nodes with a key
that a code gives are matched by it, the first of each side; others by their names, best score first. Edges: (record, src, rel, dst) with match keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import fuzzy, text
from causeway.operators.evaluation import prf
from causeway.operators.storage import materialize
from causeway.plans.shipping import ship

# Types whose nodes have names and no codes.
NAMED = ("FailureMode", "Consequence", "CorrectiveAction", "RegulatoryReference")
CODED = ("System", "Component")
#: Least score of two names.
CUTOFF = 85.0
#: Nodes of a record, of both sides, that are aligned in one pass.
HELD = 256
# The fields of a record that are compared.
IDENTITY_FIELDS = ("event_date", "report_date", "operating_mode", "power_level", "status", "revision", "ens_number", "ens_date", "ens_time")


def by_name(kind: Column, code: Column) -> Column:
    """Whether a node is matched by its name."""
    return kind.isin(*NAMED) | (kind.isin(*CODED) & code.isNull())


def _best_first(pairs: Iterable[tuple[float, list, list]]) -> list[tuple[int, int]]:
    """(pred, gold) of one record and type: best score first, then the first predicted, then the first curated node; each node once.

    ``pairs``: (score, preds, golds), two names with the places of their nodes, in the order of their scores. Copies of a name make no
    pairs of nodes, and what is held is what has been used.
    """
    used_pred: set = set()
    used_gold: set = set()
    out = []
    for _, tied in itertools.groupby(pairs, key=lambda r: r[0]):
        classes = [(sorted(p), sorted(g)) for _, p, g in tied]
        wanted: dict = {}
        for k, (preds, _) in enumerate(classes):
            for p in preds:
                wanted.setdefault(p, []).append(k)
        ahead = [0] * len(classes)
        for p in sorted(wanted):
            if p in used_pred:
                continue
            best = None
            for k in wanted[p]:
                golds = classes[k][1]
                while ahead[k] < len(golds) and golds[ahead[k]] in used_gold:
                    ahead[k] += 1
                if ahead[k] < len(golds) and (best is None or golds[ahead[k]] < best):
                    best = golds[ahead[k]]
            if best is not None:
                used_pred.add(p)
                used_gold.add(best)
                out.append((p, best))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))


def _matches(found: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches of (record, pred, gold)."""
    while some := list(itertools.islice(found, 1 << 14)):
        record, pred, gold = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(record, kind), pa.array(pred, pa.int64()), pa.array(gold, pa.int64())], ["record", "pred", "gold"])


def _kind(df: DataFrame) -> tuple[pa.DataType, str]:
    name = df.schema["record"].dataType.simpleString()
    return (pa.int64() if name == "bigint" else pa.string()), f"record {name}, pred long, gold long"


def _greedy(pairs: DataFrame) -> DataFrame:
    """(record, pred, gold) of ``pairs`` (record, type, score, preds, golds), which stream through a task record by record."""
    ordered = pairs.repartition("record", "type").sortWithinPartitions("record", "type", F.desc("score")).select("record", "type", "score", "preds", "golds")
    kind, schema = _kind(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = itertools.groupby(_rows(batches), key=lambda r: r[:2])
        return _matches(((record, p, g) for (record, _), own in groups for p, g in _best_first(r[2:] for r in own)), kind)

    return ordered.mapInArrow(run, schema)


def _of_record(rows: list[tuple], cutoff: float) -> Iterator[tuple[int, int]]:
    """(pred, gold) of one record's ``rows`` (type, text, curated, pos); a row without a type goes by its key."""
    sides: dict = {}
    for kind, text_, curated, pos in rows:
        sides.setdefault(kind, ({}, {}))[curated].setdefault(text_, []).append(pos)
    for kind, (preds, golds) in sides.items():
        if kind is None:
            yield from ((min(own), min(golds[key])) for key, own in preds.items() if key in golds)
            continue
        scored = [(fuzzy.token_set_ratio(a, b), p, g) for a, p in preds.items() for b, g in golds.items()]
        yield from _best_first(sorted((s for s in scored if s[0] >= cutoff), key=lambda s: -s[0]))


def _small(nodes: DataFrame, cutoff: float, held: int) -> DataFrame:
    """(record, pred, gold) of records of at most ``held`` nodes, and a row without places for every larger one."""
    ordered = nodes.repartition("record").sortWithinPartitions("record").select("record", "type", "text", "curated", "pos")
    kind, schema = _kind(ordered)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for record, own in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            some = [r[1:] for r in itertools.islice(own, held + 1)]
            if len(some) > held:
                yield record, None, None
            else:
                yield from ((record, p, g) for p, g in _of_record(some, cutoff))

    return ordered.mapInArrow(lambda batches: _matches(found(batches), kind), schema)


def _large(nodes: DataFrame, cutoff: float) -> DataFrame:
    """(record, pred, gold) by joins: keys, and names by their grams."""
    sides = [nodes.where(F.col("curated") == c) for c in (0, 1)]
    first = [df.where("type IS NULL").groupBy("record", F.col("text").alias("key")).agg(F.min("pos").alias(name)) for df, name in zip(sides, ("pred", "gold"), strict=True)]
    exact = first[0].join(first[1], ["record", "key"]).select("record", "pred", "gold")
    named = [df.where("type IS NOT NULL").select("record", "type", F.col("text").alias("name"), "pos") for df in sides]
    close = fuzzy.scored(fuzzy.candidates(*[df.select("record", "type", "name") for df in named], ["record", "type"], cutoff), "token_set", cutoff)
    places = [df.groupBy("record", "type", F.col("name").alias(c)).agg(F.collect_list("pos").alias(p)) for df, c, p in zip(named, ("a", "b"), ("preds", "golds"), strict=True)]
    pairs = close.join(places[0], ["record", "type", "a"]).join(places[1], ["record", "type", "b"])
    return exact.unionAll(_greedy(pairs))


def align(pred: DataFrame, gold: DataFrame, cutoff: float = CUTOFF, held: int = HELD) -> DataFrame:
    """(record, pred, gold): places of nodes matched one to one; ``record`` is a text or a whole number.

    Records of at most ``held`` nodes on both sides pass through a task each as a whole, so one shuffle aligns them; the nodes of larger ones are joined.
    """
    ship(pred.sparkSession)
    named = F.coalesce(by_name(F.col("type"), F.col("eiis_code")), F.lit(False))
    text_ = F.when(named, F.lower("display_name")).otherwise(text.tolerant_key(F.col("match_key")))
    sides = [df.select("record", F.when(named, F.col("type")).alias("type"), text_.alias("text"), F.lit(c).alias("curated"), F.col("pos").cast("bigint").alias("pos")) for c, df in enumerate((pred, gold))]
    nodes = sides[0].unionAll(sides[1]).where("record IS NOT NULL AND pos IS NOT NULL AND text IS NOT NULL AND (type IS NULL OR trim(text) <> '')")
    found = materialize(_small(nodes, cutoff, held), "aligned")
    small = found.where("pred IS NOT NULL")
    large = found.where("pred IS NULL").select("record")
    if large.isEmpty():
        return small
    return small.unionAll(materialize(_large(nodes.join(large, "record", "left_semi"), cutoff), "aligned"))


def differences(pred: DataFrame, gold: DataFrame, *columns: str) -> DataFrame:
    """(columns, side) of the rows one side alone has, as bags: ``missed`` are curated, ``spurious`` extracted. One pass over both."""
    both = pred.select(*columns, F.lit(1).alias("n")).unionAll(gold.select(*columns, F.lit(-1).alias("n")))
    left = both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "spurious").otherwise("missed")
    return left.withColumn("side", side).select(*columns, "side", F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("_copy")).drop("_copy")


def node_lists(pred: DataFrame, gold: DataFrame, matches: DataFrame) -> DataFrame:
    """(record, side, key, type, excused, unresolved) of every node without a match.

    A missed provisional corrective action is excused; a missed system or component with a code is unresolved.
    """
    rest = []
    for df, place, side in ((pred, "pred", "spurious"), (gold, "gold", "missed")):
        own = df.join(matches.select("record", F.col(place).alias("pos")), ["record", "pos"], "left_anti")
        rest.append(own.select("record", F.lit(side).alias("side"), F.col("match_key").alias("key"), "type", "eiis_code", "provisional"))
    both = rest[0].unionByName(rest[1])
    missed = F.col("side") == "missed"
    excused = missed & (F.col("type") == "CorrectiveAction") & F.coalesce("provisional", F.lit(False))
    unresolved = missed & F.col("type").isin(*CODED) & (F.coalesce("eiis_code", F.lit("")) != "")
    return both.select("record", "side", "key", "type", excused.alias("excused"), unresolved.alias("unresolved"))


def _counts(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def node_scores(pred: DataFrame, gold: DataFrame, matches: DataFrame, by: tuple[str, ...] = ("record",)) -> DataFrame:
    """(by, tp, pred, true, excused, p, r, f1) for records, or types, of the curated side; only whole records excuse nodes."""
    keys = list(by)
    hit = gold.join(matches.select("record", F.col("gold").alias("pos")), ["record", "pos"], "left_semi")
    excused = node_lists(pred, gold, matches).where("excused")
    sides = _counts(pred, keys, "pred").join(_counts(gold, keys, "gold"), keys, "full").join(_counts(hit, keys, "tp"), keys, "left").join(_counts(excused, keys, "excused"), keys, "left").na.fill(0)
    true = F.col("gold") - F.when(F.lit(keys == ["record"]), F.col("excused")).otherwise(0)
    scores = prf(F.col("tp"), F.col("pred"), F.col("true"))
    return sides.withColumn("true", true).select(*keys, "tp", "pred", "true", "excused", *[c.alias(n) for c, n in zip(scores, ("p", "r", "f1"), strict=True)])


def aligned_edges(edges: DataFrame, pred: DataFrame, gold: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct (record, src, rel, dst) of extracted edges in the curated side's keys, where their nodes have a match.

    Of several nodes of a key, the last one's match counts.
    """
    key = lambda c: text.tolerant_key(F.col(c))
    left = pred.select("record", F.col("pos").cast("bigint").alias("pred"), F.col("match_key").alias("key"))
    right = gold.select("record", F.col("pos").cast("bigint").alias("gold"), key("match_key").alias("to"))
    names = matches.join(left, ["record", "pred"]).join(right, ["record", "gold"]).groupBy("record", "key").agg(F.max_by("to", "pred").alias("to"))
    out = edges.select("record", "src", "rel", "dst")
    for end in ("src", "dst"):
        out = out.join(names.select("record", F.col("key").alias(end), F.col("to").alias(f"{end}_to")), ["record", end], "left").withColumn(end, F.coalesce(f"{end}_to", key(end))).drop(f"{end}_to")
    return out.select("record", "src", "rel", "dst").distinct()


def edge_lists(pred_edges: DataFrame, gold_edges: DataFrame) -> DataFrame:
    """(record, src, rel, dst, side) of the edges one side alone has; both sides in the same keys and distinct."""
    return differences(pred_edges, gold_edges, "record", "src", "rel", "dst")


def field_checks(pred: DataFrame, gold: DataFrame, fields: tuple[str, ...] = IDENTITY_FIELDS) -> DataFrame:
    """(record, field, ok) of records with ``identity``, ``reporting_basis`` and ``cause``: one row for each field.

    Two nulls are equal; citations are compared as sets; a cause whose curated code is TBD is excused, with a null ``ok``.
    """
    both = pred.select("record", F.struct("identity", "reporting_basis", "cause").alias("p")).join(gold.select("record", F.struct("identity", "reporting_basis", "cause").alias("g")), "record")
    same = lambda path: F.col(f"p.{path}").eqNullSafe(F.col(f"g.{path}"))
    cited = [F.array_sort(F.array_distinct(F.coalesce(F.col(f"{s}.reporting_basis.reported_under"), F.array().cast("array<string>")))) for s in ("p", "g")]
    cause = F.when(~F.coalesce(F.col("g.cause.cause_code") == "TBD", F.lit(False)), same("cause.cause_code") & same("cause.category"))
    checks = {f: same(f"identity.{f}") for f in fields} | {"reported_under": cited[0] == cited[1], "ssff": same("reporting_basis.ssff"), "cause": cause}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), ok.alias("ok")) for f, ok in checks.items()]))
    return both.select("record", each.alias("c")).select("record", "c.field", "c.ok")
