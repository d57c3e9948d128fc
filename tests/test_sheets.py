from causeway.operators import vectors
from causeway.sources import records


def test_sheet_dates(spark, tmp_path):
    (tmp_path / "s.csv").write_text("accession,event_date\nA,1/2/24\nA, 3/4/2023 10:00\nB,none\nB,13/1/2024\n,1/1/2024\n")
    assert [tuple(r) for r in records.read_sheet_dates(spark, f"{tmp_path}/s.csv").collect()] == [("A", "2023-03-04")]


def test_order_is_that_of_files_and_lines(spark, tmp_path):
    """Files are read largest first and cut into parts, whose numbers say nothing of their order."""
    (tmp_path / "a.txt").write_text("x1\n \nx2\nx1\n")
    (tmp_path / "b.txt").write_text("\n".join(f"y{k}" for k in range(4000)) + "\nx2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    got = [r.accession for r in records.read_accessions(spark, f"{tmp_path}/*.txt").orderBy("pos").collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == ["x1", "x2", *[f"y{k}" for k in range(4000)]]


def test_latest_filings(spark):
    rows = [(1, "x", "A", 0), (2, "y", "A", 0), (3, "x", "B", 1), (4, "z", "A", 0), (5, "x", "C", 1), (6, "", "D", 0), (7, "w", None, 0)]
    got = records.latest_filings(spark.createDataFrame(rows, "pos long, report string, accession string, revision long"))
    assert {(r.report, r.accession) for r in got.collect()} == {("x", "B"), ("y", "A")}
    assert got.columns == ["pos", "report", "accession", "revision"]


def test_retrieve(spark):
    kind = "vec_id long, embedding array<double>, label long"
    rows = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.9, 0.1], 8), (3, [0.8, 0.0], 7), (4, [0.0, 1.0], 9), (5, None, 9)], kind)
    asked = spark.createDataFrame([(10, [1.0, 0.0], 0), (11, [0.0, 0.2], 0), (12, None, 0)], kind)
    got = {r.query_id: (r.top_score, r.empty, [(d.doc, d.best, d.vec_ids) for d in r.documents]) for r in vectors.retrieve(asked, rows, 3, 0.5).collect()}
    assert got == {10: (1.0, False, [(7, 1.0, [1, 3]), (8, 0.9, [2])]), 11: (0.2, True, []), 12: (None, True, [])}
