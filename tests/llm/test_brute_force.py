"""Whole tables of the queries that SQL can't state, against plain versions that look at one thing at a time."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.llm import language_id, packing, pii, quality
from ledgerlark.llm import queries as q
from tests_plain import best_fit_decreasing, plain_spans


def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# ---- op4 -----------------------------------------------------------------------------------------


def test_op4_equals_plain_patterns_and_a_field_run_alone(spark, sf):
    got = {r["doc_id"]: r for r in q.op4(spark, sf).collect()}
    field, rows = pii.train(), texts(spark, sf)
    assert set(got) == set(rows)
    names = ("email", "ip", "card", "phone")
    for i, text in rows.items():
        base = plain_spans(text)
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        n = Counter(k for _, k, _ in base)
        assert [got[i][f"n_{x}"] for x in names] == [n[k] for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in got[i]["spans"].split(",") if s]
        assert {(names[k], str(a), str(b)) for a, k, b in base} <= set(spans)
        ((_, alone),) = pii.all_spans(field, pa.array([text]))
        assert got[i]["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in alone)


# ---- op8 -----------------------------------------------------------------------------------------


def plain_grams(text):
    """Buckets of trigrams with two letters together, byte by byte."""
    b = text.encode()
    letter = []
    for i, x in enumerate(b):
        if i and b[i - 1] == 0xC3 and 0x80 <= x <= 0x9E:
            x += 0x20
        letter.append(x - 64 if 65 <= x <= 90 else x - 96 if 97 <= x <= 122 else x - 100 if x >= 128 else 0)
    out = []
    for x, y, z in zip(letter, letter[1:], letter[2:]):
        if y and (x or z):
            out.append(((((x * 160 + y) * 160 + z) * 0x9E3779B1) >> 7) & (language_id.BUCKETS - 1))
    return out


def plain_languages(rows):
    """id, language, posterior of (id, text, declared, host, suffix), by counting in dictionaries."""
    grams = {i: plain_grams(x or "") for i, x, *_ in rows}
    names = sorted({r[2] for r in rows if r[2]})
    seen = {n: Counter() for n in names}
    for i, _, said, *_ in rows:
        if said:
            seen[said].update(grams[i])
    size = {n: sum(seen[n].values()) + 0.05 * language_id.BUCKETS for n in names}
    logs = lambda n, b: math.log((seen[n][b] + 0.05) / size[n])
    flat = -math.log(language_id.BUCKETS)
    text, best, known = {}, {}, {}
    for i, x, *_ in rows:
        mean = {n: sum(logs(n, b) for b in grams[i]) / max(1, len(grams[i])) for n in names}
        text[i] = {n: mean[n] * min(len(grams[i]), language_id.FULL_TEXT) for n in names}
        best[i] = max(names, key=lambda n: (text[i][n], -names.index(n)))
        letters = re.search("[A-Za-z]", x or "") or any(b >= 128 for b in (x or "").encode())
        known[i] = bool(letters) and (len(grams[i]) < language_id.JUDGED or max(mean.values()) > flat - language_id.WORSE)
    told = [r for r in rows if known[r[0]]]
    total = Counter(best[r[0]] for r in told)
    every = sum(total.values()) + len(names)
    share = {n: (total[n] + 1) / every for n in names}
    by = lambda at: {v: Counter(best[r[0]] for r in told if r[at] == v) for v in {r[at] for r in told if r[at] is not None}}
    pull = language_id.PULL
    suffix = {s: {n: (c[n] + pull * share[n]) / (sum(c.values()) + pull) for n in names} for s, c in by(4).items()}
    suffix_of = defaultdict(set)
    for r in told:
        if r[3] is not None and r[4] is not None:
            suffix_of[r[3]].add(r[4])
    host = {}
    for h, c in by(3).items():
        prior = suffix[max(suffix_of[h])] if suffix_of[h] else share
        host[h] = {n: math.log((c[n] + pull * prior[n]) / (sum(c.values()) + pull)) for n in names}
    said = Counter((r[2], best[r[0]]) for r in told if r[2])
    overall = {v: (sum(said[v, n] for n in names) + 1) / (sum(said.values()) + len(names)) for v in names}
    given = {(v, n): math.log((said[v, n] + pull * overall[v]) / (sum(said[w, n] for w in names) + pull)) for v in names for n in names}
    out = {}
    for i, _, declared, h, _ in rows:
        score = {n: text[i][n] + (host[h][n] if h in host else math.log(share[n])) + (given[declared, n] if declared else 0.0) for n in names}
        top = max(score.values())
        p = 1 / sum(math.exp(s - top) for s in score.values())
        out[i] = (max(names, key=lambda n: score[n]), p) if known[i] else ("und", 0.0)
    return out


@pytest.mark.parametrize("kind", ["documents", "pages"])
def test_languages_equal_counts_in_dictionaries(spark, sf, kind):
    table = spark.read.parquet(f"{sf}/{kind}.parquet")
    evidence = language_id.evidence_of_documents(table) if kind == "documents" else language_id.evidence_of_pages(table)
    want = plain_languages([tuple(r) for r in evidence.collect()])
    run, key = (q.op8, "doc_id") if kind == "documents" else (q.pages_language, "page_id")
    got = {r[key]: (r["language"], r["posterior"]) for r in run(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (name, p) in want.items():
        assert got[i][0] == name and got[i][1] == pytest.approx(p, abs=2e-3), (i, got[i], want[i])


# ---- op9 -----------------------------------------------------------------------------------------

CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", None, " \t", "\n\r", ".", ",;:", "!?", "|", "#$%&*@^~+=", "-_/\\", "()[]{}<>'\"`"]


def plain_class(x):
    return 3 if x >= 128 else next((k for k, s in enumerate(CLASSES) if s and chr(x) in s), 13)


def plain_statistics(text):
    b = text.encode()
    cls = [plain_class(x) for x in b]
    n, words, lines = max(1, len(b)), re.findall(rb"[^\x20\x09-\x0D]+", b), re.findall(rb"[^\n]+", b)
    m = max(1, len(words))
    folded = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in words]
    count = Counter(folded)
    ratio = lambda some: sum(some) / m
    return [
        *(cls.count(k) / n for k in range(14)), math.log1p(len(b)), math.log1p(len(words)), sum(c not in (4, 5) for c in cls) / m, len(count) / m if words else 0, max(count.values()) / m if words else 0,
        math.log1p(len(lines)), len(set(lines)) / len(lines) if lines else 0, len(words) / max(1, len(lines)), ratio(plain_class(w[0]) == 0 for w in words), ratio(plain_class(w[-1]) in (6, 8, 10) for w in words),
        sum(x != y for x, y in zip(cls, cls[1:])) / n, max((math.log1p(len(w)) for w in words), default=0), ratio(len(w) <= 3 for w in words), ratio(x == y for x, y in zip(folded, folded[1:])),
    ]


def test_statistics_equal_plain_ones(spark, sf):
    some = [*texts(spark, sf).values(), "", "A", "a a a\n\n\nb|c!?", "é É \r\n x.", "\x0b\x0c w"]
    got = quality.statistics(pa.array(some))
    assert got.shape[1] == len(quality.FEATURES)
    for text, row in zip(some, got):
        assert row == pytest.approx(plain_statistics(text), abs=1e-9), text[:60]


def test_op9_equals_trees_walked_one_by_one(spark, sf):
    import zlib

    rows = texts(spark, sf)
    x = {i: np.array(plain_statistics(t), np.float32).astype(np.float64) for i, t in rows.items()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows}
    known = sorted(i for i in label if i in x and not held[i] and label[i] in (0, 1))
    model = quality.fit(np.array([x[i] for i in known]), np.array([float(label[i]) for i in known]))

    def walk(v):
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if v[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    got = {r["doc_id"]: r for r in q.op9(spark, sf).collect()}
    assert set(got) == set(rows)
    for i in rows:
        assert got[i]["held_out"] == held[i] and got[i]["score"] == pytest.approx(walk(x[i]), abs=1e-6) and got[i]["predicted"] == (got[i]["score"] >= 0.3)


# ---- op10 ----------------------------------------------------------------------------------------


def test_op10_fills_windows_as_placing_all_pieces_one_by_one_does(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for text in texts(spark, sf).values():
        n = len(code.encode(text, add_special_tokens=False).ids) + 1
        pieces += [1024] * (n // 1024) + ([n % 1024] if n % 1024 else [])
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(r["length"] for r in rows) == sorted(pieces)
    full = Counter()
    for r in rows:
        full[r["sequence_id"]] += r["length"]
    assert sorted(1024 - n for n in full.values()) == best_fit_decreasing(pieces)


# ---- op7 -----------------------------------------------------------------------------------------


def test_op7_equals_all_pairs(spark, sf):
    e = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(e)
    x = np.stack([e[i] / np.sqrt((e[i] ** 2).sum()) for i in ids])
    n = dict(zip(ids, ((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    assert {r["vec_id"]: r["n_links"] for r in q.op7(spark, sf).collect()} == n


# ---- the pipeline --------------------------------------------------------------------------------


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    import corpus_pipeline as c

    good = "the river runs down from the hills to the sea and all its water comes with the rain of spring"
    other = "a council of the town met in the evening to hear what had been said about the new bridge"
    rows = [(1, good, "en", "s", 1), (1, good, "en", "t", 2), (1, other + " one", "en", "s", 3), (2, good, "en", "s", 4), (None, other, "en", "s", 5), (None, None, None, None, 6), (3, "", "en", "s", 7), (4, "12345 67890", "en", "s", 8), (5, " ".join(f"word{i % 700} of" for i in range(60_000)), "en", "s", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k long").withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["length"]).length("text").cast("long"))
    folder = f"file://{tmp_path}"
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "no such words at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, ids = d, []
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == d.columns
        ids.append(sorted(((r["doc_id"], r["k"]) for r in out.collect()), key=str))
    first = [(1, 1), (1, 2), (1, 3), (2, 4), (5, 9), (None, 5)]
    assert ids[0] == first
    assert ids[1] == ids[2] == ids[3] == [(1, 1), (1, 3), (5, 9), (None, 5)]
    packed = c.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {1, 5, None}
    none = tmp_path / "none"
    d.limit(0).write.parquet(f"file://{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{none}/benchmark.parquet")
    assert c.run(spark, f"file://{none}").collect() == []
