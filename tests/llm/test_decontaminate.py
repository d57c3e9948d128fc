import random
import re

import duckdb
import pytest
from oracle import assert_same, connect

from causeway.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, x in items:
            v = words(x)
            n = min(size, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found |= {str(name)} - {"None"}
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 24, 100])
def test_against_brute_force(spark, docs, block):
    random.seed(4)
    gen = lambda n: " ".join(random.choice(["a", "b", "Cé", "d9"]) for _ in range(n))
    items = [(k, gen(random.choice([1, 2, 3, 9, 10, 11, 14]))) for k in range(12)] + [(90, None), (91, " - "), (92, "solo"), (None, gen(4))]
    rows = [(k, gen(random.randint(0, 60))) for k in range(30)] + [(30, None), (31, ""), (32, "Solo!"), (33, "solo"), (33, "solo"), (34, items[5][1] + " tail " + items[6][1])]
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = decontaminate.find_leaks(spark, docs(rows), bench, block_bytes=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(rows, items)
    kept = decontaminate.decontaminate(spark, docs(rows), bench, block_bytes=block)
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, n, _ in brute(rows, items) if n == 0)


def test_longest_matches(spark, docs):
    passage = " ".join(f"w{k}" for k in range(25))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    row = decontaminate.find_leaks(spark, docs([(1, "x y " + " ".join(passage.split()[3:20]) + " z")]), bench).first()
    assert [tuple(m) for m in row.matches] == [("1", 2, 3, 17)] and row.n_hit == 17


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.find_leaks(spark, docs([(1, "a b")]), none).collect()] == [0]
    assert decontaminate.find_leaks(spark, docs([]), none).count() == 0


def test_query(spark, sf_dir):
    assert_same(decontaminate.op2_decontamination(spark, sf_dir), connect(sf_dir), decontaminate.ORACLE)


def test_null_item_as_in_the_sql(spark, docs, tmp_path):
    rows, items = [(1, "one two three four five"), (2, "one two")], [(None, "two three four"), (7, "nothing")]
    docs(rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert_same(decontaminate.op2_decontamination(spark, str(tmp_path)), con, decontaminate.ORACLE)
    assert [r.doc_id for r in decontaminate.decontaminate(spark, docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()] == [2]


def test_very_long_text(spark, docs):
    random.seed(7)
    words_ = ["w%d" % random.randrange(10**7) for _ in range(600_000)]
    bench = spark.createDataFrame([(k, " ".join(words_[a : a + 30])) for k, a in enumerate(range(1000, 500_000, 50_000))], "item_id long, text string")
    row = decontaminate.find_leaks(spark, docs([(1, " ".join(words_))]), bench).first()
    assert (row.n_words, row.n_hit, len(row["items"])) == (600_000, 300, 10)
