import pytest
from oracle import assert_same, connect

from causeway.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert_same(df, connect(sf_dir), catalogue.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_slug_covers_whole_texts(spark, tmp_path):
    rows = [(1, "A " * 5000 + "x"), (2, "A " * 5000 + "y"), (3, "--A " * 5000 + "Y!"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_chars, r.digest) for r in catalogue.QUERIES["slug_whole_keys"](spark, str(tmp_path)).collect()}
    assert got[1][0] == got[2][0] == 10001 and got[1] != got[2] == got[3] and got[4] == (None, None) and got[5][0] == 0
