"""Queries that take every word and every record of their tables."""

import duckdb

from ledgerlark import registry
from ledgerlark.session import table


def test_porter_stems_has_every_word(spark, sf):
    import ledgerlark.plans  # noqa: F401

    words = {r["word"]: r["y"] for r in registry.QUERIES["porter_stems"](spark, sf).collect()}
    assert {len(w) for w in words} >= {1, 2, 3} and any(w.endswith("s") for w in words)
    assert {y for w, y in words.items() if len(w) > 2 and not w.endswith(("s", "ie"))} == {True}


def test_platform_labels_has_every_part(spark, sf):
    import ledgerlark.plans  # noqa: F401

    assert registry.QUERIES["platform_labels"](spark, sf).count() == table(spark, sf, "part").count()


def test_platform_labels_takes_every_name_and_label(spark, sf, tmp_path):
    import ledgerlark.plans  # noqa: F401

    names = ["OpenDataNI", " greater  LONDON–authority!", "Marine Environmental Data Information Network", "Greater London Authority Council", "MARİNE environmental data information network", "--", None]
    rows = [(k, n, s) for k in (None, -5, -4, -1, 0, 1, 2, 3) for n in names for s in (None, -1, 0, 1, 2)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    for d, files in ((tmp_path, f"{tmp_path}/part.parquet/*.parquet"), (sf, f"{sf}/part.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{files}'")
        want = con.sql(registry.ORACLE["platform_labels"]).fetchall()
        found = registry.QUERIES["platform_labels"](spark, str(d)).collect()
        assert sorted(str(tuple(r)) for r in found) == sorted(map(str, want))
    got = [r.asDict() for r in registry.QUERIES["platform_labels"](spark, str(tmp_path)).collect()]
    north, cefas, london = "opendatani|daera_ni|agol_daera_agol|causeway_coast|mid_ulster", "cefas", "london_datastore"
    assert all({r["own"] for r in got if r["p_partkey"] == k} == {north, cefas, london, ""} for k in (None, -5, 0, 1, 2, 3))
    assert {r["p_partkey"]: r["y"] for r in got} == {0: north, -4: north, 1: london, 2: "", 3: "", -1: "", -5: "", None: ""}
    assert {r["spelled"] for r in got} == {north, cefas, london, ""}
