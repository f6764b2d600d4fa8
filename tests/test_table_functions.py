"""Table functions of SQL against the DataFrame forms and a loop."""

import pytest
from pyspark.errors import AnalysisException

from ledgerlark.functions.tables import delimiter_of, register_tables
from ledgerlark.operators.ledger import read_ledgers

FILES = [
    ("a.csv", b"Spend over 500\nSupplier Name,Payment Date,Amount\nX,01/02/2020,12.50\nY,03/02/2020,(1.00)\n", 1),
    ("b.csv", "Payee;Date;Net Amount\nCafé;2020-01-02;3,5\n".encode("utf-16"), 1),
    ("c.csv", b"", 1), ("d.csv", None, 1), ("e.zip", b"PK\x03\x04 no table", 1), ("f.csv", b"only words here\n", 1),
    ("g.csv", b"id\tname\n1\tx\n\n2\ty\tmore\n3\tz\n", 1),
]


@pytest.fixture(scope="module")
def files(spark):
    df = spark.createDataFrame(FILES, "path string, content binary, row int")
    df.createOrReplaceTempView("landed_files")
    register_tables(spark)
    return df


def test_ledger_rows_equal_the_data_frame_form(spark, files):
    got = spark.sql("SELECT * FROM ledger_rows(TABLE(landed_files) PARTITION BY path)")
    want = read_ledgers(files)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT * FROM ledger_rows(TABLE(SELECT * FROM landed_files WHERE false))").collect() == []


def test_table_cells(spark, files):
    got = spark.sql("SELECT * FROM table_cells(TABLE(SELECT content, path FROM landed_files WHERE path = 'g.csv') PARTITION BY (path), 2) ORDER BY row, column").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, "id", "1"), (0, 1, "name", "x"), (1, 0, "id", "2"), (1, 1, "name", "y"), (1, 2, None, "more")]
    every = spark.sql("SELECT path, count(DISTINCT row) AS n FROM table_cells(TABLE(landed_files)) GROUP BY path")
    assert {r["path"]: r["n"] for r in every.collect()} == {"a.csv": 3, "b.csv": 1, "g.csv": 3}


def test_other_tables_are_refused_when_analysed(spark, files):
    with pytest.raises(AnalysisException, match="path and content"):
        spark.sql("SELECT * FROM ledger_rows(TABLE(SELECT 1 AS x))")


def test_delimiters():
    assert delimiter_of(["a;b", "1,5;2"]) == ";" and delimiter_of(["a,b", '"x;y",2']) == "," and delimiter_of(["words"]) == "," and delimiter_of([]) == ","
