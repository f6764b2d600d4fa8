"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import queries as q
from ledgerlark.llm import spelling as S
from ledgerlark.llm.scratch import Scratch

_LOW = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(_LOW)
            if i is not None:
                h = zlib.crc32(f"{i}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    near = defaultdict(set)
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    for size, own in by.items():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
            for b in by.get(size + 1, ()):
                if one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    return near


def plain_rows(counts, share=5):
    near = plain_near(counts)
    form = {}
    for w in counts:
        best = min(((-counts[o], o) for o in near[w]), default=None)
        if best and -best[0] >= share * counts[w]:
            form[w] = best[1]
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def test_op12_equals_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = {w: n for w, n in plain_counts(rows).items() if n >= 5}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in q.op12(spark, sf).collect()}
    assert got == plain_rows(counts)


@pytest.mark.parametrize("most", [0, 2, 16, 10**9])
def test_common_segments_lose_no_pair(spark, most):
    """All words of six letters over a small alphabet that begin alike, and longer ones, at any limit."""
    import itertools

    words = ["common" + "".join(x) for n in (1, 2, 3) for x in itertools.product("abé", repeat=n)]
    words += ["".join(x) for x in itertools.product("ab", repeat=6)] + ["".join(x) for x in itertools.product("ab", repeat=7)] + ["x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 20]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = S.near_pairs(df, Scratch(spark, "t"), most).collect()
    got = Counter(frozenset((r["x"], r["y"])) for r in pairs)
    want = {frozenset((a, b)) for a, near in plain_near(words).items() for b in near}
    assert set(got) == want and set(got.values()) == {1}


def test_candidates_stay_near_the_links(spark):
    """4,000 words with one beginning: limits that only count would compare 8 million pairs."""
    import random

    rng = random.Random(4)
    words = sorted({"beginning" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(4_000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    rows = S._cut(S._open_rows(df))
    for _ in range(4):
        hot = rows.groupBy("key").agg(F.count_if(F.col("longer").isNull()).alias("i"), F.max("m").alias("m")).where(f"i > {S.MOST} and m > 1").select("key")
        rows = rows.join(hot, "key", "left_anti").unionByName(S._cut(rows.join(hot, "key", "left_semi")))
    seen = rows.groupBy("key").agg(F.count_if(F.col("longer").isNull()).alias("i"), F.count_if(F.col("longer").isNotNull()).alias("p"))
    assert seen.agg(F.sum(F.col("i") * F.col("p"))).first()[0] < 40 * len(words)


def test_chains_lead_to_their_end(spark):
    words = [("abcdef", 5), ("abcdeg", 25), ("abcdhg", 125), ("abcihg", 700), ("zzzzzz", 5), ("zzzzzy", 24)]
    df = spark.createDataFrame(words, "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["form_n"]) for r in S.variants(df, Scratch(spark, "t")).collect()}
    assert got["abcdef"] == ("abcdeg", "abcihg", 25) and got["abcdhg"] == ("abcihg", "abcihg", 700) and got["abcihg"] == (None, "abcihg", None)
    assert got["zzzzzz"] == (None, "zzzzzz", None)


def test_odd_rows(spark):
    """Nulls, empty texts, other scripts, a run of 200,000 letters, repeats, ties, columns of the operator's own names."""
    long = "A" + "b" * 200_000
    rows = [(1, None), (2, ""), (3, "Straße STRASSE straße × ÷ Ünïcode"), (None, "unchanged unchanged " * 3), (4, long), (4, long), (5, " ".join([long] * 3)), (6, "кот 漢字words naïveté naivete"), (7, "ties12ties tiesab tiesac " * 5)]
    df = spark.createDataFrame([(i, t, "w", 1, None) for i, t in rows], "doc_id long, text string, word string, n int, root string")
    got = {r["word"]: r["n"] for r in S.word_counts(df).collect()}
    assert got == plain_counts(rows)
    full = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in S.group_variants(df).collect()}
    assert full == plain_rows({w: n for w, n in plain_counts(rows).items() if n >= 5})
    assert S.group_variants(df.limit(0)).collect() == []
