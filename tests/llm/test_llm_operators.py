"""Operators against brute force, round trips and held-out accuracy."""

import gzip
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerlark.llm import decontaminate, licenses, packing, pii, quality, rp_forest, url_rules, warc
from ledgerlark.llm import queries as q


def oracle(sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.sql(q.ORACLE[name])
    return sorted(map(repr, (dict(sorted(zip(r.columns, row))) for row in r.fetchall())))


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_equals_oracle_sql(spark, sf, name):
    got = q.QUERIES[name](spark, sf)
    assert sorted(map(repr, (dict(sorted(r.asDict().items())) for r in got.collect()))) == oracle(sf, name)


def test_decontamination_beyond_the_size_that_is_sent(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a = decontaminate.contamination(docs, bench).collect()
    b = decontaminate.contamination(docs, bench, sent_bytes=0).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_decontamination_of_a_large_benchmark_shuffles_no_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text").union(spark.sql("SELECT CAST(null AS LONG), 'a b c d w1 w2 w3 w4 w5'").union(spark.sql("SELECT CAST(-1 AS LONG), 'a b c d w1 w2 w3 w4 w5'")))
    bench = spark.range(20_000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(0, 15), i -> concat('w', (id * 7 + i) % 20000)))  AS text")
    bench = bench.union(docs.selectExpr("100000 + doc_id", "substring(text, 1, 300)")).union(spark.sql("SELECT 7L, 'w1 w2 w3'"))
    a = decontaminate.contamination(docs, bench).collect()
    b = decontaminate.contamination(docs, bench, sent_bytes=0).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and sum(r["n_hit"] > 0 for r in a) > 100
    odd = [r for r in a if r["n_words"] == 9 and r["doc_id"] in (None, -1)]
    assert [(r["n_hit"], r["n_items"]) for r in odd] == [(9, 3)] * 2


# ---- licenses ------------------------------------------------------------------------------------


def test_every_template_is_found_alone_and_wording_is_exact():
    import zstandard

    t, plain = licenses.compiled(), zstandard.ZstdCompressor(level=3)
    for name, _, text in licenses.wordings():
        _, got = licenses.scan("Some words come first.\n" + text + "\nMore words.", t, plain)
        assert [g[2] for g in got] == [name]
    wrong = "Licensed under the Apache License, Version 1.1. Released under the BSD License. This licence is mine."
    assert licenses.scan(wrong, t, plain)[1] == []
    two = "Released under the MIT License.\nX.\nLicensed under CC BY-NC 4.0."
    _, got = licenses.scan(two, t, plain)
    assert [two[a:b] for a, b, *_ in got] == ["Released under the MIT License", "Licensed under CC BY-NC 4.0"]


# ---- personal data -------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(x):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k != 1 or all(int(n) <= 255 for n in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_plain_regular_expressions():
    r = random.Random(0)
    for _ in range(20_000):
        x = "".join(r.choice("aB1234567890.@-+ (%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(x) == plain_spans(x)
    for x in ("4111 1111 1111 1111", "me@a.b and 1.2.3.4 or 300.1.1.1", "+1 (988) 555-2485", "a" * 50_000, "1" * 50_000, "1." * 20_000, "@" * 20_000):
        if len(x) < 100:
            assert pii.base_spans(x) == plain_spans(x)
        else:
            pii.base_spans(x)


def test_field_finds_its_rows_and_viterbi_is_exact():
    field = pii.train()
    right = 0
    for row in pii.LABELLED:
        plain = re.sub("</?[nas]>", "", row)
        want = [w.strip("\"'().,;:") for w in re.findall("<[nas]>(.*?)</", row)]
        right += want == [plain[a:b] for a, _, b in pii.field_spans(field, pa.array([plain]))[0]]
    assert right >= len(pii.LABELLED) - 1
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 7))
        e = r.normal(0, 4, (n, 4))
        e[:, 0] += 3
        edge = np.zeros(n, bool)
        edge[0] = True
        best = max(np.ndindex(*(4,) * n), key=lambda y: sum(e[i, v] for i, v in enumerate(y)) + sum(field.step[y[i - 1], y[i]] for i in range(1, n)))
        assert tuple(pii.decode(field, e, edge)) == best


def test_spans_are_code_points_and_redaction_takes_effect(spark):
    text = "é Ünï me@mail.example.com, password=5aaa9ac60bfe74b24b x"
    d = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n long")
    row = pii.find_personal_data(d).first()
    spans = [s.split(":") for s in row["spans"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "me@mail.example.com"), ("secret", "5aaa9ac60bfe74b24b")]
    assert pii.redact(d).first()["text"] == "é Ünï [EMAIL], password=[SECRET] x"


# ---- archives ------------------------------------------------------------------------------------


def test_salvage_recovers_all_but_what_is_damaged():
    records = [warc.record(i, f"http://x/{i}", bytes([65 + i]) * (100 * i)) for i in range(8)]
    for pack in (warc.member, lambda b: b):
        parts = [pack(r) for r in records]
        whole = warc.salvage(b"".join(parts))
        assert len(whole.records) == 8 and not whole.gaps
        bad = bytearray(b"".join(parts))
        at = len(b"".join(parts[:3])) + len(parts[3]) - 12
        bad[at] ^= 0xFF
        got = warc.salvage(bytes(bad))
        assert [h["warc-record-id"] for _, _, h, _ in got.records] == [f"<urn:x-page:{i}>" for i in range(8) if i != 3]
        assert got.gaps[0][:2] == (len(b"".join(parts[:3])), len(b"".join(parts[:4])))
        cut = warc.salvage(b"junk" + b"".join(parts)[:-5])
        # of a member only the checksum is cut: the record is whole by its own digest
        assert len(cut.records) == (8 if pack is warc.member else 7) and len(cut.gaps) == 2 and cut.gaps[0][:2] == (0, 4)
    assert warc.salvage(b"").records == [] and warc.salvage(b"nothing").gaps == [(0, 7, "version line")]
    assert len(warc.salvage(gzip.compress(records[1]) + records[2]).records) == 2


def test_pages_round_trip_with_odd_rows(spark):
    rows = [(1, "http://a/\r\nb", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (None, "v", ""), (None, None, "alone"), (5, "w", "x" * 300_000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, k long")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(d).collect()), key=repr)
    want = [(1, 9, "revisit", 3), (2, 0, "response", None), (3, 9, "response", None), (3, 9, "response", None), (5, 300_000, "response", None), (None, 0, "revisit", 2), (None, 5, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(d.limit(0)).collect() == []


# ---- url rules -----------------------------------------------------------------------------------


def test_rules_by_index_equal_all_rules_in_turn():
    r = random.Random(3)
    index = url_rules.Index(url_rules.RULES, {"org": 5, "example": 9})
    hosts = ["example.org", "a.Example.org", "notexample.org", "x.com", "ads.x.net", "free-bets.example.com", "", "casino"]
    for _ in range(5000):
        url = r.choice(["http://", "://", "", "x"]) + r.choice(hosts) + r.choice(["", "/", "/es/", "/es", "/en/1", "/en/12?x=/fr/", "/fr/a", "/de/#q", "?q", "/a/casino/b"])
        host, path = url_rules.split_url(url)
        fit = [x for x in url_rules.RULES if host + path and re.search(x.pattern, host + path)]
        named = max((x for x in fit if x.rank), key=lambda x: x.rank, default=None)
        verdict = named.verdict if named else "allow" if any(x.verdict == "allow" for x in fit) else "block" if fit else "allow"
        assert index.judge(url) == (host, path, named.name if named else None, verdict)
    assert index.judge(None) == ("", "", None, "allow")


# ---- embeddings ----------------------------------------------------------------------------------


def test_forest_recall_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "BUCKET_AIM", 200)
    monkeypatch.setattr(rp_forest, "BUCKET_ROWS", 400)
    r = np.random.default_rng(1)
    base = r.normal(size=(150, 32))
    x = np.concatenate([b + r.normal(size=(12, 32)) * s for b, s in zip(base, np.linspace(0.1, 0.5, 150))]).astype(np.float32)
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    odd = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 32, 1), (9004, [float("nan")] * 32, 1), (9005, [None] * 32, 1), (9006, [1.0] * 16, 1), (9007, x[0].tolist(), 1), (None, x[0].tolist(), 1)]
    got = {g["vec_id"]: g for g in rp_forest.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    every = np.concatenate([x, x[:1]]).astype(np.float64)
    every /= np.sqrt((every**2).sum(1))[:, None]
    n = (every @ every.T >= 0.9).sum(1) - 1
    found = [got[i]["n_links"] for i in range(len(x))] + [got[9007]["n_links"]]
    assert all(f <= m for f, m in zip(found, n)) and sum(found) >= 0.97 * n.sum() > 0
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9001, 9007))
    assert got[9007]["component_id"] == got[0]["component_id"] and got[None]["component_id"] is None
    assert rp_forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# ---- quality -------------------------------------------------------------------------------------


def test_flattened_trees_score_held_out_rows():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    p = m.scores(x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.95 and p.min() >= 0 and p.max() <= 1
    one = quality.fit(x[:10], np.ones(10))
    assert np.allclose(one.scores(x[:3]), one.scores(x[:1])[0])


def test_quality_reads_no_held_out_label(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    held = [i for i, r in a.items() if r["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    b = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert b == {i: r["score"] for i, r in a.items()}


# ---- packing -------------------------------------------------------------------------------------


def best_fit_decreasing(lengths, window=1024):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(window - n)
    return sorted(left)


def test_plan_equals_one_by_one_best_fit():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.choice([r.randint(1, 1024), r.choice([700, 324, 300, 512, 100])]) for _ in range(r.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        left, ends = {}, {}
        for n, rank, many, first, offset in packing.plan(counts):
            for i in range(many):
                ends.setdefault(first + i, []).append((offset, n))
        for s, parts in ends.items():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
            left[s] = 1024 - sum(n for _, n in parts)
        assert sorted(left.values()) == best_fit_decreasing(lengths)


def test_pieces_hold_every_id_once_in_gapless_windows(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(100_001, "<|endoftext|> x <|endoftext|>"), (100_002, "日本語 \U0001f600   \t\n\n  ok"), (100_003, " " * 5000 + "a" * 5000), (100_004, None), (100_005, "ǅ ꙮ ①²½")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).union(spark.createDataFrame(extra, "doc_id long, text string")).cache()
    ids = {r["doc_id"]: np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    seen, windows = {}, {}
    for p in packing.pack(docs).collect():
        own = ids[p["doc_id"]]
        part = own[p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(own) and len(part) == p["length"] and p["ids_crc32"] == zlib.crc32(part.tobytes())
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(seen) == set(ids)
    for i, parts in [*((k, v) for k, v in seen.items()), *((k, v) for k, v in windows.items())]:
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
    assert all(sum(n for _, n in w) <= 1024 for w in windows.values())
    docs.unpersist()


# ---- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    once = c.near_duplicates(spark, docs, sf)
    assert once.columns == docs.columns
    kept = {r["doc_id"] for r in once.collect()}
    comp = {r["doc_id"]: r["component_id"] for r in q.op1(spark, sf).collect()}
    assert kept == {i for i, k in comp.items() if i == k}
    bad = {r["doc_id"] for r in q.op2(spark, sf).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in c.benchmarks(spark, docs, sf).collect()} == set(rows) - bad
    clean = c.personal_data(spark, docs, sf).collect()
    assert all(not pii.base_spans(r["text"]) or pii.base_spans(rows[r["doc_id"]]) for r in clean) and all(r["n_chars"] == len(r["text"]) for r in clean)
    assert pq.read_table(f"{sf}/documents.parquet").num_rows == len(rows)
    assert c.run(spark, sf).count() > 0
