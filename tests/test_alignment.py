"""Alignment of records against a plain version of its rules, record by record."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from causeway.functions.fuzzy import token_set_ratio
from causeway.operators import alignment
from causeway.plans import alignment_queries

NODE = "record {}, pos long, type string, match_key string, display_name string, eiis_code string, provisional boolean"
tolerant = lambda key: key.replace("Component:ISV", "Component:V")


def plain(pred, gold, cutoff=alignment.CUTOFF):
    """Matches of one record, in the order they are made."""
    named = lambda n: n.type in alignment.NAMED or (n.type in alignment.CODED and n.eiis_code is None)
    out, used = [], set()
    first = {}
    for g in gold:
        if not named(g):
            first.setdefault(tolerant(g.match_key), g)
    for e in pred:
        g = None if named(e) else first.get(tolerant(e.match_key))
        if g is not None and g.pos not in used:
            out.append((e, g))
            used.add(g.pos)
    pairs = [(token_set_ratio(e.display_name.lower(), g.display_name.lower()), e, g) for e in pred if named(e) for g in gold if named(g) and e.type == g.type]
    taken = set()
    for score, e, g in sorted(pairs, key=lambda p: -p[0]):
        if score >= cutoff and e.pos not in taken and g.pos not in used:
            out.append((e, g))
            taken.add(e.pos)
            used.add(g.pos)
    return out


def by_record(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.record), r.pos)):
        out[r.record].append(r)
    return out


def check(pred, gold):
    got = sorted(map(tuple, alignment.align(pred, gold).collect()), key=str)
    p, g = by_record(pred.collect()), by_record(gold.collect())
    want = sorted(((k, e.pos, h.pos) for k in p for e, h in plain(p[k], g.get(k, []))), key=str)
    assert got == want
    return p, g


def test_all_records_of_the_tables(spark, sf_dir):
    pred, gold = (df.cache() for df in alignment_queries.records(spark, sf_dir))
    p, g = check(pred, gold)
    scores = {r.type: (r.tp, r.pred, r.true) for r in alignment.node_scores(pred, gold, alignment.align(pred, gold), ("type",)).collect()}
    hits = Counter(h.type for k in p for _, h in plain(p[k], g[k]))
    count = lambda side: Counter(n.type for rows in side.values() for n in rows)
    assert scores == {t: (hits[t], count(p)[t], count(g)[t]) for t in count(g)}
    assert 0.5 < sum(hits.values()) / sum(count(p).values()) <= 1


def test_copies_and_ties(spark):
    """Many nodes of few names in one record: ties go to the first of each side."""
    draw = random.Random(4)
    names = ["pump failed", "Pump failed to start", "pump", "breaker tripped", "tripped breaker open", "failed", "valve stuck", "valves stuck"]

    def nodes(n):
        out = []
        for record in ("r1", "r2", None):
            for pos in range(n if record else 3):
                kind = draw.choice(["FailureMode", "FailureMode", "Consequence", "System", "Component"])
                code = draw.choice([None, "BJ", "ISV", "V"]) if kind in alignment.CODED else None
                name = draw.choice(names)
                out.append((record, pos, kind, f"{kind}:{code or name}", name, code, draw.random() < 0.5))
        return spark.createDataFrame(out, NODE.format("string")).where("record IS NOT NULL").cache()

    check(nodes(60), nodes(45))


def test_lists_and_edges(spark):
    made = lambda rows, kind="string": spark.createDataFrame(rows, NODE.format(kind))
    gold = made([("r", 0, "LER", "LER:1", "1", None, False), ("r", 1, "Component", "Component:V|1", "valve", "V", False), ("r", 2, "FailureMode", "FailureMode:pump-failed", "pump failed", None, False), ("r", 3, "CorrectiveAction", "CorrectiveAction:x", "repair", None, True), ("r", 4, "System", "System:BJ", "hpci", "BJ", False), ("s", 0, "LER", "LER:2", "2", None, False)])
    pred = made([("r", 0, "LER", "LER:1", "1", None, False), ("r", 1, "Component", "Component:ISV|1", "valve", "ISV", False), ("r", 2, "FailureMode", "FailureMode:failed-pump", "Failed pump", None, False), ("r", 3, "System", "System:ZZ", "other", "ZZ", False)])
    matches = alignment.align(pred, gold)
    assert sorted(map(tuple, matches.collect())) == [("r", 0, 0), ("r", 1, 1), ("r", 2, 2)]
    lists = {(r.record, r.side, r.key, r.excused, r.unresolved) for r in alignment.node_lists(pred, gold, matches).collect()}
    assert lists == {("r", "spurious", "System:ZZ", False, False), ("r", "missed", "CorrectiveAction:x", True, False), ("r", "missed", "System:BJ", False, True), ("s", "missed", "LER:2", False, False)}
    (row,) = alignment.node_scores(pred, gold, matches).where("record = 'r'").collect()
    assert (row.tp, row.pred, row.true, row.excused, row.p, row.r) == (3, 4, 4, 1, 0.75, 0.75)
    edge = "record string, src string, rel string, dst string"
    have = spark.createDataFrame([("r", "FailureMode:failed-pump", "LEADS_TO", "Component:ISV|1"), ("r", "LER:1", "INVOLVES", "System:ZZ"), ("r", "LER:1", "INVOLVES", "System:ZZ")], edge)
    want = spark.createDataFrame([("r", "FailureMode:pump-failed", "LEADS_TO", "Component:V|1"), ("r", "LER:1", "INVOLVES", "System:BJ")], edge)
    moved = alignment.aligned_edges(have, pred, gold, matches)
    assert {tuple(r) for r in alignment.edge_lists(moved, want).collect()} == {("r", "LER:1", "INVOLVES", "System:ZZ", "spurious"), ("r", "LER:1", "INVOLVES", "System:BJ", "missed")}


def test_differences_are_of_bags(spark):
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "k string")
    got = alignment.differences(rows("a", "a", "b", "c", None), rows("a", "c", "c", "d", None), "k").collect()
    assert sorted((r.k, r.side) for r in got) == [("a", "spurious"), ("b", "spurious"), ("c", "missed"), ("d", "missed")]


def test_nothing_on_one_side(spark):
    one = spark.createDataFrame([(1, 0, "FailureMode", "FailureMode:x", "x y", None, False)], NODE.format("long"))
    assert alignment.align(one, one.limit(0)).count() == alignment.align(one.limit(0), one).count() == 0
    assert alignment.align(one, one.withColumn("display_name", F.lit(None).cast("string"))).count() == 0


def test_small_records_make_no_grams(spark, monkeypatch):
    """Names of small records are compared in one pass; those of larger records are joined, with the same matches."""
    draw = random.Random(7)
    words = "pump valve breaker failed tripped stuck open closed".split()
    rows = [(r, p, "FailureMode", f"FailureMode:{p}", " ".join(draw.sample(words, 3)), None, False) for r in range(12) for p in range(1 + 3 * r)]
    pred, gold = (spark.createDataFrame(rows[k:], NODE.format("long")).cache() for k in (0, 5))
    wide = sorted(map(tuple, alignment.align(pred, gold, held=20).collect()))
    monkeypatch.setattr(alignment.fuzzy, "candidates", lambda *_: 1 / 0)
    assert sorted(map(tuple, alignment.align(pred, gold).collect())) == wide
    check(pred, gold)
