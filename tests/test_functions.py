import random

import pytest
from pyspark.sql import functions as F

from causeway.functions import fuzzy, text
from causeway.operators import facets
from causeway.operators.facets import FacetQuery, Filter
from causeway.sources import forms, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [("10 CFR 50.73(a)(2)(iv)(A)", "10-cfr-50-73-a-2-iv-a"), ("  ", ""), ("A--b", "a-b")])
def test_slug(spark, given, wanted):
    assert one(spark, text.slug(F.lit(given))) == wanted


def test_keys(spark):
    none = F.lit(None).cast("string")
    key = text.match_key(F.lit("Cause"), F.lit("x"), none, none, none, F.lit("provisional"))
    assert one(spark, text.storage_key(F.lit("Cause"), key, F.lit(True), F.lit("424-2025-001-00"))) == "Cause:provisional:424-2025-001-00"
    assert one(spark, text.storage_key(F.lit("System"), F.lit("System:BJ"), F.lit(True), F.lit("r"))) == "System:BJ"


def test_block_tokens(spark):
    rows = lambda s: one(spark, records.component_failures(F.split(F.lit(s), " ")))
    assert [(r.cause, r.system, r.reportable) for r in rows("TBD BJ TBD TBD y TBD BJ TBD TBD y")] == [("TBD", "BJ", "Y")] * 2
    assert [(r.cause, r.system, r.component, r.reportable) for r in rows("B BJ Yes")] == [("B", "BJ", None, "Y")]
    assert [(r.cause, r.manufacturer) for r in rows("B BJ V n/a y n/a")] == [("B", None)]


def test_chunks(spark):
    words = " ".join(f"w{k}" for k in range(10))
    assert [c for c in one(spark, text.chunks(F.lit(words), 4, 1))] == [["w0", "w1", "w2", "w3"], ["w3", "w4", "w5", "w6"], ["w6", "w7", "w8", "w9"]]
    sizes = [len(c) for c in one(spark, text.chunks(F.lit(" ".join("x" * 400)), 180, 27))]
    assert sizes == [180, 180, 94]
    assert one(spark, text.chunks(F.lit(None).cast("string"), 4, 1)) == []


def test_ratios():
    """Worked by hand: twice the common subsequence over both lengths, weights 0.95, 0.9 and 0.6."""
    near = lambda got, want: abs(got - want) < 1e-9
    assert near(fuzzy.indel_ratio("abcd", "abce"), 75) and fuzzy.indel_ratio("", "") == 100 and fuzzy.indel_ratio("", "x") == 0
    assert fuzzy.token_set_ratio("reactor core", "reactor core isolation cooling") == 100 and fuzzy.token_set_ratio("", "x") == 0
    assert near(fuzzy.token_set_ratio("heat pump", "heat fan"), 200 * 4 / 12) and near(fuzzy.token_sort_ratio("pump a", "a pump"), 100)
    assert near(fuzzy.weighted_ratio("pump a", "a pump"), 95) and near(fuzzy.weighted_ratio("abcd", "abce"), 75)
    assert near(fuzzy.weighted_ratio("reactor core", "reactor core isolation cooling"), 90)  # a window at 0.9
    assert near(fuzzy.weighted_ratio("core spray", "spray x core isolation and cooling"), 85.5)  # common words at 0.95 * 0.9
    assert near(fuzzy.weighted_ratio("ab", "ab " + "xyz " * 8), 60)  # more than eight times as long
    assert near(fuzzy.weighted_ratio("valve", "the valves are"), 90) and fuzzy.weighted_ratio("reactor core", "reactor core") == 100
    assert fuzzy.weighted_ratio("", "x") == 0
    assert near(fuzzy.partial_ratio("abcx", "zzabc"), 200 * 3 / 7)  # a window cut off at the end


def test_common_subsequence():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("abcé") for _ in range(draw.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.common(a, b) == table[-1][-1]


@pytest.mark.parametrize(("ratio", "cutoff"), [("weighted", 88.0), ("token_set", 80.0), ("token_set", 100.0)])
def test_matching_against_every_term(spark, ratio, cutoff):
    draw = random.Random(9)
    words = "core spray reactor heat removal residual pump valve pumps emergency diesel generator a b low pressure injection".split()
    terms = [(" ".join(draw.choices(words, k=draw.randint(1, 5))), f"T{k}", k) for k in range(120)] + [("", "E", 900), ("core spray", "late", 901)]
    asked = [None, "", " ", "nothing alike qqq"]
    for name, _, _ in terms:
        for _ in range(3):
            cut = draw.randrange(len(name) + 1)
            asked += [draw.choice([name, name[:cut] + name[cut + 1 :], name[:cut] + "x" + name[cut:], " ".join(draw.sample(name.split(), len(name.split()))), name + " unit two", "old " + name])]
    got = fuzzy.best_matches(spark.createDataFrame([(a, 1) for a in asked], "asked string, score_ int"), "asked", spark.createDataFrame(terms, "name string, code string, pos int"), ratio, cutoff)
    measure = fuzzy.RATIOS[ratio]

    def best(name):
        found = [(-measure(name, t), pos, code) for t, code, pos in terms if name and name.strip() and t and measure(name, t) >= cutoff]
        return (min(found)[2], -min(found)[0]) if found else (None, None)

    rows = got.collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert (r.match, r.score) == best(r.asked), r.asked
    with pytest.raises(ValueError):
        fuzzy.best_matches(got, "asked", got, ratio, 60.0)


def test_facet_filters(spark):
    rows = spark.createDataFrame([(1, ["HPCI [bj]"], "Urgent", 95.0), (2, [], None, None)], "event_key long, systems array<string>, causes string, power_level double")
    hits = lambda *f: [r.event_key for r in facets.matched(rows, FacetQuery("systems", f)).collect()]
    assert hits(Filter("system", "HPCI")) == [1]
    assert hits(Filter("power", "90%", "=>")) == [1]
    assert hits(Filter("power", "many")) == []
    assert hits(Filter("cause", "urgent"), Filter("nothing", 1)) == []
    assert facets.usable({"facet": "cause", "value": ""}) == ()


def test_unwrap(spark):
    doc = '{"DocketNumber":["05000352"],"DocumentTitle":"t","LicenseeEventReport":"LER 2022-001-00","content":"c"}'
    rows = spark.createDataFrame([(f'{{"document":{doc}}}',), (f'{{"results":[{{"document":{doc}}}]}}',)], "reply string")
    assert {(r.ler_number, r.title) for r in records.unwrap_documents(rows).collect()} == {("352-2022-001-00", "t")}


def test_regions_of_a_form(spark):
    whole = "Dear Sir\nSubject: LER 2024-001, \"Pump\n trip\"\n\nbody NRC FORM 366 head\n16. Abstract (text)\nshort story NRC FORM 366A long story"
    rows = spark.createDataFrame([(1, whole), (2, "no form here"), (3, None), (4, "")], "id int, t string")
    got = {r.id: r.s for r in rows.select("id", text.segments(F.col("t")).alias("s")).collect()}
    assert got[1].cover.endswith("body ") and got[1].header.startswith("NRC FORM 366 head") and got[1].abstract == "short story " and got[1].narrative == "NRC FORM 366A long story"
    assert tuple(got[2]) == ("no form here", "", None, "") and tuple(got[3]) == tuple(got[4]) == ("", "", None, "")
    titles = rows.select("id", text.title(text.segments(F.col("t"))["cover"], F.lit("LER 1 for North, Unit 2, Valve stuck ")).alias("v")).collect()
    assert {r.id: r.v for r in titles} == {1: "Pump trip", 2: "Valve stuck", 3: "Valve stuck", 4: "Valve stuck"}


def test_notification_takes_the_nearest(spark):
    cases = {
        1: ("It was restored at 0915 EST on March 3, 2024. The NRC was told at 10:15 CST on 3/4/24 (ENS 57001), and the state some two hours later, again at 23:59 on May 9, 2024.", ("57001", "2024-03-04", "10:15 CST")),
        2: ("See report number 56123 made on 11/17/25 at 18:09.", ("56123", "2025-11-17", "18:09")),
        3: ("Event notification (4455) " + "x" * 300 + " at 10:00 on 1/1/20", ("4455", None, None)),
        4: ("nothing", None), 5: (None, None),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "id int, t string")
    got = {r.id: r.n and tuple(r.n) for r in rows.select("id", text.notification(F.col("t")).alias("n")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_short_rows_and_upserts(spark):
    tokens = spark.createDataFrame([(["B", "NO"],), (["B", "BJ", "NO"],), (["X", "BN"],)], "t array<string>")
    got = [[tuple(x) for x in r.f] for r in tokens.select(records.component_failures(F.col("t")).alias("f")).collect()]
    assert got == [[("B", None, None, None, "N")], [("B", "BJ", None, None, "N")], [("X", "BN", None, None, None)]]
    old, new = spark.createDataFrame([(1, "o", 0), (2, "o", 0)], "k int, v string, at int"), spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in records.upsert(old, new, ["k"], F.desc("at")).collect()) == [(1, "b"), (2, "o")]


def test_block_of_failures(spark):
    """A line that begins the block belongs to what is before it; the next block's line ends it only after a first line."""
    named = "Complete One Line for EACH Component Failure x"
    cases = {
        f"a\n{named}\nB BJ\n  14. next\nz": ["B BJ"], f"{named}\n14. kept\nmore\n14.": ["14. kept", "more"], f"{named}\n\n14.": [""], f"{named}\nB\nno end": [], "14. only\nnothing": [],
        f"{named}\n{named}\nB\n14.\n{named}\nC\n14.": [named, "B"], named: [], "": [], None: [],
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "id int, t string")
    got = {r.id: r.f for r in rows.select("id", forms.failure_lines(F.col("t")).alias("f")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    form = forms.form_fields(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert all(r.form.block_13 == [] and r.form.cause_code == "TBD" and r.form.status == "final" and r.form.power_level is None for r in form)


def test_furniture_ends_lines_at_newlines_and_words_as_in_sql(spark):
    """A letter beyond ASCII ends a word of the furniture, a carriage return ends no line, and blanks of all scripts are trimmed."""
    rows = [(1, "noñez a\nb"), (2, "I\r\nb"), (3, " 　12 \nb"), (4, "year_x\nb")]
    made = spark.createDataFrame(rows, "k long, t string").select("k", text.prose_lines(F.col("t")).alias("p"))
    assert {r.k: r.p for r in made.collect()} == {1: ["b"], 2: ["I\r", "b"], 3: ["b"], 4: ["year_x", "b"]}
