"""Words that a stemmer takes for one that they are not, where a stem's words are stated."""

import pytest

from ledgerlark.functions.text import stem
from ledgerlark.operators.index import SearchIndex, term_of

FORMS = {"under": ("under", "unders")}
TEXTS = [(1, "under a bridge"), (2, "unders and under"), (3, "underou stands alone"), (4, "by the road, under all"), (5, "nothing of it"), (6, "no word"), (7, "more words"), (8, "and more")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('forms')}/index"
    docs = spark.createDataFrame([(k, x, x) for k, x in TEXTS], "key long, text string, publisher string")
    SearchIndex.build(docs, "key", {"text": 1.0, "publisher": 2.0}, path, "publisher", forms=FORMS)
    return SearchIndex(spark, path, "key", {"text": 1.0, "publisher": 2.0}, FORMS)


def test_only_stated_words_share_a_stem(built):
    assert stem("underou") == "under"
    assert [term_of(w, FORMS) for w in ("under", "Unders", "underou", "roads")] == ["under", "under", "underou", "road"]
    assert {r["key"] for r in built.top(["under"]).collect()} == {1, 2, 4}
    assert [r["key"] for r in built.top(["underou"]).collect()] == [3]


def test_the_geo_arm_has_only_stated_words(spark, built):
    inside = spark.createDataFrame([(k,) for k, _ in TEXTS], "key long")
    got = built.matches(["under"]).geo_arm(["under"], inside)
    assert {r["key"] for r in got.collect()} == {1, 2, 4}


def test_topic_and_publisher_have_only_stated_words(built):
    m = built.matches(["under"], "publisher")
    assert m.found == {"under": (3, 3)}
    assert {r["key"] for r in m.rows.where(m.topic(["under"])).collect()} == {1, 2, 4}
    assert {r["key"] for r in m.rows.where(m.publisher(["under"])).collect()} == {1, 2, 4}


def test_scores_are_multiplied_in_the_order_of_the_sql(spark):
    from pyspark.sql import functions as F

    from ledgerlark.operators import retrieval as R

    f, t = F.lit(False), F.lit(True)
    rows = spark.range(300).select("id", (1.0 / (61 + F.col("id"))).alias("s"))
    got = rows.select("id", R.multiplier(t, f, f, f, F.lit("data"), F.lit(0), t, F.col("s")).alias("x")).collect()
    assert all(r["x"] == 1.0 / (61 + r["id"]) * 1.3 * 1 * 1 * 1 * 1.15 * 0.5 for r in got)
