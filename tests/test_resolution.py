import pytest
from pyspark.sql import functions as F

from causeway.operators import evaluation, resolution

DIMENSION = """eiis_code,type,canonical_name,acronyms
BN,system,Reactor Core Isolation Cooling System,RCIC
AC,system,Reactor Core System,
BO,system,Residual Heat Removal/Low Pressure Coolant Injection System,RHR | LPCI
ZZ,system,Another System,RHR
ISV,component,Isolation Valve,MSIV
"""
NODE = "display_name string, eiis_code string"


@pytest.fixture
def dimension(spark, tmp_path):
    (tmp_path / "d.csv").write_text(DIMENSION)
    return resolution.read_dimension(spark, f"{tmp_path}/d.csv")


def test_systems(spark, dimension):
    rows = [("anything (RHR)", " bj "), ("Heat removal (RHR)", None), ("Reactor Core Isolation Cooling (XYZ) System", ""), ("Core Spray", None), ("Automatic Depressurization {ADS)", None), ("Odd Thing (QQ)", None), (None, None)]
    done = resolution.systems(spark.createDataFrame(rows, NODE), dimension)
    got = {r.read_name: (r.eiis_code, r.resolved_by, r.display_name, r.non_eiis) for r in done.collect()}
    assert got["anything (RHR)"] == ("BJ", "read", "anything (RHR)", False)
    assert got["Heat removal (RHR)"][:2] == ("BO", "acronym")  # the first row with the acronym
    assert got["Reactor Core Isolation Cooling (XYZ) System"][:2] == ("BN", "name")
    assert got["Core Spray"][:2] == ("BM", "name")
    assert got["Automatic Depressurization {ADS)"] == (None, None, "Automatic Depressurization System", True)
    assert got["Odd Thing (QQ)"] == (None, None, "Odd Thing", True) and got[None][0] is None
    assert [tuple(r) for r in resolution.learned_acronyms(done).collect()] == [("XYZ", "BN", "reactor core isolation cooling")]
    assert [tuple(r) for r in resolution.unknown_acronyms(done).collect()] == [("QQ", "Odd Thing (QQ)")]


def test_components_and_manufacturers(spark, dimension):
    rows = [("valve (MSIV)", None), ("a PCIV", None), ("outer isolation valve", " v "), ("cannon plug", "")]
    got = {r.display_name: (r.eiis_code, r.inferred_code) for r in resolution.components(spark.createDataFrame(rows, NODE), dimension).collect()}
    assert got == {"valve (MSIV)": ("ISV", False), "a PCIV": ("ISV", True), "outer isolation valve": ("V", False), "cannon plug": (None, False)}
    makers = spark.createDataFrame([("C770", None), ("C770", "own"), ("X1", ""), (None, None)], "code string, display_name string")
    assert [(r.display_name, r.unknown_code) for r in resolution.manufacturers(makers).collect()] == [("Eaton / QualTech NP", False), ("own", False), ("", True), (None, False)]


OUTCOME = """kind string, intent string, ok_intents array<string>, routed string, clarified boolean, total long, offered array<string>, must_include string, least long,
answerable boolean, answer string, cites array<string>, reports array<string>, nodes array<string>, want_reports array<string>, want_nodes array<string>"""
FRAMED = "Observed within this corpus: 3 events; this is not a rate."


@pytest.mark.parametrize("change, ok", [
    ({}, True), ({"routed": "b"}, False), ({"cites": ["z"]}, False), ({"want_nodes": ["n", "m"]}, False), ({"least": 3}, False), ({"answerable": False}, False),
    ({"kind": "showcase", "want_reports": ["r", "s"], "cites": ["r"]}, False), ({"kind": "aggregation", "want_reports": ["r", "s"], "cites": ["r"]}, True),
    ({"kind": "negative"}, False), ({"kind": "negative", "answerable": False, "cites": []}, True), ({"kind": "intent", "answerable": False}, True),
    ({"kind": "risk"}, False), ({"kind": "risk", "answer": FRAMED}, True), ({"kind": "risk", "answer": FRAMED, "routed": "b", "ok_intents": ["a", "b"]}, True),
    ({"kind": "risk", "answer": FRAMED, "nodes": [], "reports": [], "cites": []}, False), ({"kind": "honesty", "answer": FRAMED}, True), ({"kind": "honesty", "answer": "3 events"}, False),
    ({"kind": "payoff"}, True), ({"kind": "lookup", "answerable": False}, False), ({"kind": "lookup", "cites": ["z"]}, False), ({"kind": "lookup", "clarified": True}, True),
    ({"kind": "clarify"}, False), ({"kind": "clarify", "clarified": True}, True), ({"kind": "clarify", "clarified": True, "total": 1}, False), ({"clarified": True}, False),
    ({"kind": "clarify", "clarified": True, "must_include": "k"}, False), ({"kind": "clarify", "clarified": True, "must_include": "k", "total": 9}, True),
])
def test_judged_by_kind(spark, change, ok):
    base = dict(kind="xdoc", intent="a", ok_intents=None, routed="a", clarified=False, total=2, offered=["x", "y"], must_include=None, least=None, answerable=True, answer="yes", cites=["r"], reports=["r", "s"], nodes=["n"], want_reports=["r"], want_nodes=[])
    names = [part.strip().split(" ")[0] for part in OUTCOME.replace("\n", " ").split(",")]
    row = {**base, **change}
    assert evaluation.judged_by_kind(spark.createDataFrame([tuple(row[n] for n in names)], OUTCOME)).first().ok is ok


def test_accuracy_of_nothing(spark):
    empty = spark.createDataFrame([("a", None, 0.1)], "gold string, pred string, confidence double")
    assert tuple(evaluation.accuracy(empty, ["a"], 0.5).first()) == (0, 0.0, 0, 0, None)


def test_missed_nodes(spark):
    gold = spark.createDataFrame([(1, "a", "CorrectiveAction", None, True), (1, "b", "Component", "V", None), (1, "c", "System", "", False), (2, "d", "System", "BJ", False)], "record long, key string, type string, eiis_code string, provisional boolean")
    hits = spark.createDataFrame([(2, "d"), (2, "d")], "record long, key string")
    assert {(r.key, r.excused, r.unresolved) for r in evaluation.missed_nodes(gold, hits).collect()} == {("a", True, False), ("b", False, True), ("c", False, False)}
    assert evaluation.missed_nodes(gold, gold.where(F.lit(True))).count() == 0
