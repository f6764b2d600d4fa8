"""Search queries over words that look like stems or hold marks, against their SQL; ranks of rounded scores."""

import shutil

import duckdb
import pytest

from ledgerlark import plans, registry  # noqa: F401
from ledgerlark.functions.text import fold
from ledgerlark.operators.index import SearchIndex, term_of

ODD = ["general public licensed under a roof", "gener public licensed under a roof", "general public licens under a roof", "gener licens alone", "ge҃neral pub⃝lic licensed undér it", "generals publics licensing unders", "underou nation 7", "licens", "gener"]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    shutil.copytree(sf, at, dirs_exist_ok=True)
    (at / "documents.parquet").unlink()
    # Those of one rest by 36 and by 10 have a box that holds the point.
    texts = [(180 * i + 12, x) for i, x in enumerate(ODD)] + [(180 * i + 13, "by the road") for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", texts)
    con.execute(f"COPY (SELECT doc_id, text, 'en' AS lang, 'web' AS source, CAST(length(text) AS BIGINT) AS n_chars FROM d) TO '{at}/documents.parquet' (FORMAT parquet)")
    return at


@pytest.mark.parametrize("name", ["geo_arm", "topic_and_publisher", "bm25_topk", "rare_term"])
def test_words_spelled_as_a_stem_are_not_its_forms(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    want = con.sql(registry.ORACLE[name]).fetchall()
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tables)).collect()]
    assert want and (got == want if "ORDER BY bm25 DESC, doc_id LIMIT" in registry.ORACLE[name] else sorted(got) == sorted(want))


def test_a_word_spelled_as_a_stem_has_a_term_of_its_own():
    forms = {"gener": ("general",)}
    assert term_of("general", forms) == "gener" != term_of("gener", forms) and term_of("gener") == "gener"
    assert fold("A҃b⃝́ःc") == "abc"


def test_ranks_of_rounded_scores_have_ties_by_key(spark, tmp_path):
    docs = spark.createDataFrame([(1, "under a long bridge of stone"), (2, "under a bridge of stone"), (3, "under a bridge")] + [(k, "no such word here") for k in range(4, 40)], "key long, text string")
    SearchIndex.build(docs, "key", {"text": 1.0}, f"file://{tmp_path}/index")
    index = SearchIndex(spark, f"file://{tmp_path}/index", "key", {"text": 1.0})
    keys = lambda df: [r["key"] for r in df.collect()]
    arm = lambda **how: keys(index.matches(["under"]).geo_arm(["under"], docs.select("key"), 2, **how).orderBy("rank"))
    assert arm() == [3, 2] and arm(digits=-1) == [1, 2] and keys(index.top(["under"], 2)) == [3, 2] and keys(index.top(["under"], 2, -1)) == [1, 2]
    blocks = f"file://{tmp_path}/blocks"
    SearchIndex.build(docs, "key", {"text": 1.0}, blocks, block=2)
    assert keys(SearchIndex(spark, blocks, "key", {"text": 1.0}).top(["under"], 2, -1)) == [1, 2]
