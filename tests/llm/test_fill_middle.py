"""Operator 11 against a plain version, round trips on odd texts, and its plan."""

import hashlib
import re

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from causeway.llm import fill_middle as fim

ODD = [
    (0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "  lead and trail \r\n"), (5, "a <P> b"), (6, "holds <M>"), (7, "<S>"),
    (8, "half <P and S> and <"), (9, "\U0001f600 astral é  nbsp"), (10, "x" * 200_000 + " " * 200_000 + "y"), (11, "$1 \\ $2 back\\slash " * 30),
    (12, "same same same"), (12, "same same same"), (None, "no id at all"), (None, None), (14, "<" * 50 + " " + "<" * 50),
]


def plain(key, text, s=fim.Settings()):
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    digest = hashlib.sha256(f"{s.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in (s.prefix, s.suffix, s.middle)) or h[2] % 100 >= s.rearranged:
        return (key, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < s.suffix_first:
        return (key, n, "spm", len(pre), len(mid), s.suffix + suf + s.prefix + pre + s.middle + mid)
    return (key, n, "psm", len(pre), len(mid), s.prefix + pre + s.suffix + suf + s.middle + mid)


order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[5]))


@pytest.mark.parametrize("settings", [fim.Settings(), fim.Settings(seed=7, rearranged=100, suffix_first=50), fim.Settings(rearranged=100, prefix="[pre$1]", suffix="(s.*)", middle="\\M|")])
def test_equals_plain_version(docs, settings):
    rows = ODD + [(100 + i, f"w{i} " * (i % 9) + "tail\n" * (i % 3)) for i in range(120)]
    got = fim.arrange(docs(rows), settings=settings)
    assert order(got.collect()) == order(plain(k, t, settings) for k, t in rows)
    again = got.select("doc_id", fim.restored(F.col("output"), F.col("form"), settings).alias("text")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, again), key=key) == sorted(((k, t or "") for k, t in rows), key=key)


def test_sentinels_that_clash_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>")):
        with pytest.raises(ValueError):
            fim.Settings(prefix=bad[0], suffix=bad[1], middle=bad[2])


def test_empty_table_and_other_columns(spark, docs):
    assert fim.arrange(docs([]).limit(0)).count() == 0
    named = spark.createDataFrame([(1, "a b c d e f", "u")], "units long, output string, form string")
    assert fim.arrange(named, "units", "output").first()[1] == 6


def test_one_scan_without_python_or_exchange(spark, sf_dir):
    plan = fim.op11_fill_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_query(spark, sf_dir):
    got = fim.op11_fill_middle(spark, sf_dir)
    assert_same(got, connect(sf_dir), fim.ORACLE)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
