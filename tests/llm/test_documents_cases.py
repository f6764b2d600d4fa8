"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns, for every operator on documents."""

import hashlib

import pytest

from ledgerlark.llm import decontaminate, language_id, licenses, ngram_join, packing, pii, quality

CLASH = "n long, s1 long, rep long, a long, b long, k string, h long, hot string, w string, text_key string, score double, best long, chunk long, rank long, x string, declared string, bad_id long"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LONG = " ".join(f"word{i % 5000}x{i % 7}" for i in range(120_000))


def documents(spark, rows):
    names = [c.split()[0] for c in CLASH.split(", ")]
    full = [(*r, "en" if r[1] and len(r[1]) < 1000 else None, None, *([None] * len(names))) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, {CLASH}")


ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (6, "Short."), (None, "one two three four five six"), (7, LONG), (8, LONG + " tail"), (9, "short."), (10, "é" * 5000)]
RUN = {
    "op1": lambda s, d: ngram_join.jaccard_components(d),
    "op2": lambda s, d: decontaminate.contamination(d, s.createDataFrame([(1, "one two three"), (2, None), (3, ""), (3, "five six")], "item_id long, text string")),
    "op3": lambda s, d: licenses.scan_licenses(d),
    "op4": lambda s, d: pii.find_personal_data(d),
    "op8": lambda s, d: language_id.document_languages(d),
    "op9": lambda s, d: quality.score_quality(d, s.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")),
    "op10": lambda s, d: packing.pack(d),
}


@pytest.mark.parametrize("name", RUN)
def test_odd_rows_and_empty_table(spark, name):
    got = RUN[name](spark, documents(spark, ROWS)).collect()
    if name != "op10":
        assert len(got) == len(ROWS)
    ids = [r["doc_id"] for r in got]
    assert set(ids) == {r[0] for r in ROWS}
    assert RUN[name](spark, documents(spark, ROWS).limit(0)).collect() == []


def test_op1_defined_results(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(documents(spark, ROWS)).collect()]
    by = {g[0]: g[1:] for g in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[4] == (2, 4) and by[5] == (2, 4) and by[None] == (2, None)
    assert by[6] == (1, 6) and by[9] == (1, 6)
    assert by[8][1] == 7 and by[7][1] == 7


def test_op2_defined_results(spark):
    got = {r["doc_id"]: r for r in RUN["op2"](spark, documents(spark, ROWS)).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items_sha256"], got[1]["contaminated"]) == (0, 0, EMPTY_SHA, False)
    four = got[4]
    assert (four["n_words"], four["n_hit"], four["n_items"], four["contaminated"]) == (6, 5, 2, True)
    assert four["items_sha256"] == hashlib.sha256(b"1,3").hexdigest()
    assert got[None]["n_hit"] == 5


def test_op4_defined_results(spark):
    got = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, ROWS)).collect()}
    assert got[1]["base_sha256"] == EMPTY_SHA and got[1]["spans"] == ""


def test_op8_rejects_only_what_is_no_language(spark):
    got = {r["doc_id"]: r for r in language_id.document_languages(documents(spark, ROWS)).collect()}
    assert not got[1]["accepted"] and got[1]["language"] == "und" and not got[2]["accepted"]
    assert got[4]["accepted"] and got[4]["language"] == "en"


def test_filters_keep_clean_rows_and_all_columns(spark):
    docs = documents(spark, ROWS)
    for f in (language_id.keep_language, pii.redact, lambda d: decontaminate.clean_documents(d, spark.createDataFrame([(1, "nothing like this is here")], "item_id long, text string"))):
        out = f(docs)
        assert out.columns == docs.columns
        assert {4, 5, 6, 9, None} <= {r["doc_id"] for r in out.select("doc_id").collect()}
