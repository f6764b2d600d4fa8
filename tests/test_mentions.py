"""Names in texts against loops over both tables."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import mentions as M


def low(x):
    return "".join(c.lower() if c.isascii() else c for c in x)


def plain(texts, names, whole):
    out = {}
    for i, text in texts:
        s = low(text or "")
        for n in {low(n) for n in names if n}:
            at = [p for p in range(len(s)) if s.startswith(n, p)]
            if whole:
                at = [p for p in at if not (p and s[p - 1].isalnum() and n[0].isalnum() or p + len(n) < len(s) and s[p + len(n)].isalnum() and n[-1].isalnum())]
            if at:
                out[i, n] = (len(at), at[0])
    return out


def made():
    rng = random.Random(8)
    words = ["york", "New York", "KENT", "ken", "é", "ÉCOLE", "Σ", "a-b", "aa", "aaa", "london borough", " of ", "#1", None, ""]
    texts = [(i, "".join(rng.choice([*[w or "" for w in words], " ", ".", "x", "\n", "日本"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    return [*texts, (900, None), (901, ""), (902, "aaaaaa"), (903, "z" * 300_000 + "kent")], words


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("size", [1 << 20, 9])
def test_mentions_equal_loops_however_the_names_are_cut(spark, whole, size):
    texts, words = made()
    t = spark.createDataFrame([(i, x, "clash", 1) for i, x in texts], "id long, said string, name string, hits int")
    n = spark.createDataFrame([(w, "clash") for w in [*words, *words]], "who string, key string")
    got = M.mentions(t, "id", "said", n, "who", whole, size).collect()
    assert {(r["id"], r["name"]): (r["hits"], r["first"]) for r in got} == plain(texts, words, whole)
    assert len(got) == len(plain(texts, words, whole))
    assert M.mentions(t, "id", "said", n.limit(0), "who", whole, size).collect() == []
    assert M.mentions(t.limit(0), "id", "said", n, "who", whole, size).collect() == []


def test_nothing_but_names_is_shuffled(spark):
    texts, words = made()
    t = spark.createDataFrame(texts, "id long, said string").repartition(4)
    n = spark.createDataFrame([(w,) for w in words], "who string")
    plan = M.mentions(t, "id", "said", n, "who")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_beginnings_equal_loops(spark):
    texts, words = made()
    t = spark.createDataFrame([(i, x, "clash") for i, x in texts], "id long, said string, name string")
    n = spark.createDataFrame([(w,) for w in words], "who string")
    got = sorted((r["id"], r["name"]) for r in M.beginnings(t, "id", "said", n, "who").collect())
    assert got == sorted((i, w) for i, x in texts for w in {low(w) for w in words if w} if low(x or "").startswith(w))
    assert M.beginnings(t, "id", "said", n.limit(0), "who").collect() == []
    plan = M.beginnings(t, "id", "said", n, "who")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_named_elsewhere_leaves_out_ones_own_texts(spark):
    rows = [(1, "kent", "Kent and Surrey"), (2, "Surrey", "kent, kent"), (3, "surrey", "KENT"), (4, None, "surrey"), (5, "essex", "kentish")]
    got = M.named_elsewhere(spark.createDataFrame(rows, "id long, owner string, said string"), "id", "owner", "said")
    assert {tuple(r) for r in got.collect()} == {("kent", 2, 1, 3), ("surrey", 2, 1, 2)}
    assert got.agg(F.count("*")).first()[0] == 2
