"""License scans against every template at every position, and the wordings that a block may hold."""

import pytest
import zstandard

from ledgerlark.llm import licenses
from ledgerlark.llm.licenses import scan, wording

TEXT = {name: x for name, _, x in licenses.TEMPLATES}


@pytest.fixture(scope="module")
def tools():
    return licenses.compiled(), zstandard.ZstdCompressor(level=3)


def names(tools, text):
    return [g[2] for g in scan(text, *tools)[1]]


def least_edits(words, want, keys):
    """Edits between the template and the nearest run of words, one cell at a time."""
    row = [0] * (len(words) + 1)
    for w in want:
        lost = 10**6 if w in keys else 1
        new = [row[0] + lost]
        for j, v in enumerate(words, 1):
            new.append(min(row[j] + lost, row[j - 1] + (0 if v == w else lost), new[j - 1] + 1))
        row = new
    return min(row)


def test_the_table_equals_every_template_at_every_position(spark, sf, tools):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    templates, held = licenses.compiled(), 0
    for r in rows:
        text = r["text"] or ""
        words = [w for w, _, _ in wording(text)]
        near = set()
        for t in templates:
            allowed = int(licenses.EDITS * len(t.words))
            if t.keys <= set(words) and least_edits(words, t.words, t.keys) <= allowed:
                near.add(t.name)
        mine = set(filter(None, got[r["doc_id"]]["licenses"].split(",")))
        held += len(mine)
        assert mine == near
        for span, differs in zip(filter(None, got[r["doc_id"]]["spans"].split(",")), got[r["doc_id"]]["differences"].split(",")):
            name, a, b = span.rsplit(":", 2)
            own = {t.name: t for t in templates if t.name == name and [w for w, _, _ in wording(text[int(a) : int(b)])] == t.words}
            assert own or differs
    assert held > 0


def test_two_licenses_in_one_block_are_both_found(tools):
    assert names(tools, TEXT["apache-2.0-notice"] + " " + TEXT["mit-notice"]) == ["apache-2.0-notice", "mit-notice"]
    assert names(tools, TEXT["cc0-1.0"] + " " + TEXT["mit-notice"]) == ["cc0-1.0", "mit-notice"]
    assert names(tools, TEXT["gpl-3.0"] + " " + TEXT["apache-2.0-notice"]) == ["gpl-3.0", "apache-2.0-notice"]
    assert names(tools, TEXT["mit-notice"] + " One. Two. " + TEXT["apache-2.0-notice"]) == ["mit-notice", "apache-2.0-notice"]
    assert names(tools, "Licensed under CC BY 4.0. Released under the MIT License.") == ["cc-by-4.0", "mit"]


def test_common_forms(tools):
    assert names(tools, "Licensed under the MIT license") == ["mit"]
    assert names(tools, "// SPDX-License-Identifier: MIT\nint x;") == ["mit"]
    assert names(tools, "This work: Creative Commons Attribution 4.0 International") == ["cc-by-4.0"]
    assert names(tools, "Licensed under the Apache\nLicense, Version 2.0") == ["apache-2.0"]
    assert names(tools, TEXT["bsd-3-clause-text"]) == ["bsd-3-clause-text"] and names(tools, TEXT["bsd-2-clause-text"]) == ["bsd-2-clause-text"]


def test_differences_are_the_edits_of_the_wording(tools):
    changed = TEXT["mit-notice"].replace("to whom the Software is furnished", "to whom it is handed") + " End."
    (a, b, name, place), = scan(changed, *tools)[1]
    assert name == "mit-notice" and place.missing == ["the", "software", "furnished"] and place.inserted == ["it", "handed"]
    assert changed[a:b].startswith("Permission is hereby") and changed[a:b].endswith("of the Software")
    assert names(tools, TEXT["apache-2.0-notice"].replace("2.0", "1.1")) == []


def test_many_notices_in_a_row_are_all_found_in_linear_time(tools):
    import time

    began = time.time()
    got = names(tools, " ".join([TEXT["mit-text"], TEXT["bsd-3-clause-text"]] * 40))
    assert got == ["mit-text", "bsd-3-clause-text"] * 40 and time.time() - began < 60


@pytest.mark.parametrize("text", [None, "", " ", "license", "the license is ours " * 20_000, "😀 licence İ" * 3])
def test_odd_texts(tools, text):
    assert scan(text or "", *tools)[1] == []
