"""The join against brute force, with hot columns forced to appear."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.llm import components, ngram_join, wordhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        s = len(sets[a] & sets[b])
        if s and 100 * s >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(r.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(240):
        w = list(r.choice(base))
        kind = r.random()
        if kind < 0.5:
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
        elif kind < 0.7:
            w = [word() for _ in range(r.randint(0, 30))] + passage
        elif kind < 0.8:
            w = passage + [word() for _ in range(r.randint(0, 8))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "hot_df", "hot_sent"), [(1, 128, 1_000_000), (2, 3, 1_000_000), (3, 3, 0), (4, 1, 1_000_000)])
def test_equals_brute_force(spark, seed, hot_df, hot_sent):
    rows = corpus(seed)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), hot_df=hot_df, hot_sent=hot_sent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_pages_of_shared_frames_equal_brute_force(spark, seed):
    """Frames of one to three passages and own words: 60 to 100 % of a page is shared, some of it by all."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    common, frames = words(30), [words(r.randint(20, 60)) for _ in range(6)]
    rows = [(i, " ".join((common if r.random() < 0.7 else []) + r.choice(frames) + words(r.choice([0, 0, 1, 2, 5, 8, 12, 20])))) for i in range(400)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), hot_df=3)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == brute(rows)


def test_pages_that_share_a_frame_but_do_not_link_never_meet(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerlark.llm.scratch import Scratch

    # 4,000 rows of one hot column, 80 % of each hot: no two can link
    warm = spark.range(4_000).select(F.lit(1).cast("long").alias("h"), F.col("id").alias("rep"), (F.lit(100) + F.col("id") % 20).alias("n"), F.ceil((F.lit(100) + F.col("id") % 20) / 5).alias("k"))
    label = spark.createDataFrame([], "node long, component long")
    scratch = Scratch(spark, "test")
    assert ngram_join._hot_across(warm, label, scratch).count() == 0
    cells = spark.read.parquet(f"{scratch.root}/warm-mixed")
    assert cells.count() == 0


def test_word_hashes_part_as_words_do():
    texts = ["a bb  ccc", "", None, "x" * 1000 + " y", "Ab\tAB é É", " lead", "trail "]
    body, at = wordhash.buffers(pa.array(texts))
    hashed, w = wordhash.word_hashes(body, at)
    seen = defaultdict(set)
    for t, a, b in zip(texts, w[:-1], w[1:]):
        own = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        assert len(own) == b - a
        for x, h in zip(own, hashed[a:b]):
            seen[x].add(int(h))
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_components_of_random_graphs(spark, tmp_path):
    from ledgerlark.llm.scratch import Scratch

    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {x["node"]: x["component"] for x in got.collect()} == label
    a, b = np.array([5, 2, 9]), np.array([2, 7, 8])
    assert dict(zip(*(x.tolist() for x in components.forest(a, b)))) == {2: 2, 5: 2, 7: 2, 8: 8, 9: 8}
