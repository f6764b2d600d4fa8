"""Cases in which less than the whole job was done once."""

import hashlib

import numpy as np

from ledgerlark.llm import decontaminate, language_id, licenses, rp_forest

# ---- embeddings ----------------------------------------------------------------------------------


def test_lengths_without_a_first_split_miss_no_pair(spark):
    r = np.random.default_rng(1)
    base = np.repeat(r.normal(size=(20, 32)), 100, axis=0)
    x = (base + r.normal(size=base.shape) * 0.3).astype(np.float32)
    assert len(x) < rp_forest.BUCKET_AIM
    got = {g["vec_id"]: g["n_links"] for g in rp_forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1))[:, None]
    want = (y @ y.T >= 0.9).sum(1) - 1
    assert want.sum() > 1000 and [got[i] for i in range(len(x))] == want.tolist()


# ---- languages -----------------------------------------------------------------------------------

RUSSIAN = "Комитет опубликует ежегодный отчёт о государственных расходах в следующем месяце, и граждане могут высказать замечания."
POLISH = "W poniedziałek rząd przyjął projekt ustawy, która ma uprościć procedury przyznawania świadczeń dla rodzin wielodzietnych oraz innych."


def of_words(r, letters):
    own = ["".join(r.choice(list(letters), 6)) for _ in range(40)]
    return lambda n: " ".join(r.choice(own, n))


def test_every_declared_language_is_told_apart(spark):
    r = np.random.default_rng(2)
    codes = [a + b for a in "abcdefghij" for b in "abcdefg"]
    rows = []
    for k, code in enumerate(codes):
        write = of_words(r, "abcdefghijklmnopqrstuvwxyz")
        rows += [(1000 * k + i, write(60), code if i else None, "s") for i in range(4 if k % 2 else 5)]
    got = {g["doc_id"]: g for g in language_id.document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(codes) > 64 and all(got[i]["language"] == codes[i // 1000] and got[i]["accepted"] for i, *_ in rows)


def test_text_of_languages_never_declared_is_kept_and_random_letters_are_not(spark):
    r = np.random.default_rng(3)
    write = of_words(r, "aeinorst")
    noise = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz "), 2000))
    odd = [(901, RUSSIAN, None, "t"), (902, POLISH, None, "s"), (903, noise, None, "s"), (904, "12 34", None, "s"), (905, None, None, "s")]
    rows = [(i, write(600), "en", "s") for i in range(40)] + odd
    for lang in ("en", None):
        docs = spark.createDataFrame([(i, x, lang and a, b) for i, x, a, b in rows], "doc_id long, text string, lang string, source string")
        assert {g["doc_id"] for g in language_id.keep_language(docs).collect()} == {*range(40), 901, 902}
        got = {g["doc_id"]: g["language"] for g in language_id.document_languages(docs).collect()}
        assert all(got[i] == "und" for i in range(901, 906)) and all(got[i] == (lang or "und") for i in range(40))


# ---- licenses ------------------------------------------------------------------------------------


def test_wordings_on_either_side_of_the_longest_are_found():
    import zstandard

    t, plain = licenses.compiled(), zstandard.ZstdCompressor(level=3)
    text = {name: x for name, _, x in licenses.TEMPLATES}
    names = lambda x: [g[2] for g in licenses.scan(x, t, plain)[1]]
    assert names("Licensed under CC BY 4.0. Data is Dedicated to the public domain under CC0 1.0 Universal.\n") == ["cc-by-4.0", "cc0-1.0"]
    assert names("All rights reserved. " + text["mit-notice"] + "\n") == ["all-rights-reserved", "mit-notice"]
    far = "All rights reserved. One. Two. Three. Four. " + text["mit-notice"] + " Five. Six. " + text["mpl-2.0"]
    assert names(far) == ["all-rights-reserved", "mit-notice", "mpl-2.0"]
    # between two long ones, and in a block far longer than itself
    mid = text["apache-2.0-notice"] + " " + text["gpl-2.0"] + " " + text["mit-notice"]
    assert names(mid) == ["apache-2.0-notice", "gpl-2.0", "mit-notice"]


# ---- benchmarks ----------------------------------------------------------------------------------


def test_items_without_an_id_hit_and_count_as_one(spark):
    docs = spark.createDataFrame([(1, "one two three four x"), (2, "five six seven eight x"), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (None, "two three four"), (7, "five six seven"), (None, "five six seven")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {1: (4, 1, sha(b""), True), 2: (3, 2, sha(b"7"), True), 3: (0, 0, sha(b""), False)}
