import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect

from causeway.llm import secret_scan
from causeway.llm.automaton import compile_rules
from causeway.llm.kernel import texts_of

KINDS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(KINDS.items()):
        for m in rx.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = ["token", "secret", "password", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "x", "hunter22", ".", "deadbeef" * 4, "\n", "\0", "secre", "ghp_", "A" * 40]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), max_size=6))
def test_base_spans_against_re(texts):
    found = secret_scan.scanner().spans(texts_of(pa.array(texts, pa.string())))
    assert [[s for s in spans if s[1] < 3] for spans in found] == [brute(t) for t in texts]


def test_long_texts_cross_stretches():
    text = "z" * 250 + "password = " + "k" * 5000 + " " + "0a" * 3000 + "AKIA" + "B" * 700
    assert [s for s in secret_scan.scanner().spans(texts_of(pa.array([text])))[0] if s[1] < 3] == brute(text)


def test_automaton_is_minimal():
    one = compile_rules(["ab|ab", "a(b|b)"])
    assert len(one.accept) == 3 and one.accept.max() == 3


def test_rows_and_redaction(spark, docs):
    rows = [(1, "é token = abcdef123 end"), (2, None), (3, ""), (4, "clean"), (4, "clean"), (5, "secret=" + "0123456789abcdef" * 2 + "!")]
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.secrets)) for r in secret_scan.scan(spark, docs(rows)).collect()}
    assert got == {(1, (("assign", 2, 19),)), (2, ()), (3, ()), (4, ()), (5, (("assign", 0, 39), ("hex", 7, 39)))}
    safe = secret_scan.redact(spark, docs(rows).withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["x"]).length("text")))
    assert {(r.doc_id, r.text, r.n_chars) for r in safe.collect()} == {(1, "é [assign] end", 14), (2, None, None), (3, "", 0), (4, "clean", 5), (5, "[assign]!", 9)}
    assert safe.count() == len(rows)
    assert secret_scan.scan(spark, docs([])).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = secret_scan.op7_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r.doc_id])
        said = ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_query_against_sql(spark, sf_dir):
    assert_same(secret_scan.op7_secrets(spark, sf_dir), connect(sf_dir), secret_scan.ORACLE)


def test_redacting_leaves_other_columns(spark):
    rows = spark.createDataFrame([(1, "password=hunter22 x", 5), (2, None, None), (2, "fine", 4)], "doc_id long, text string, n_chars int").selectExpr("*", "'s' AS secrets", "'r' AS redacted", "'_' AS _redacted")
    got = secret_scan.redact(spark, rows)
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "[assign] x", 10, "s", "r", "_"), (2, None, None, "s", "r", "_"), (2, "fine", 4, "s", "r", "_")], key=str)
