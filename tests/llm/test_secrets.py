"""Secret scans: patterns by re on every text, added spans by planted keys and by what must stay clean."""

import base64
import hashlib
import random
import re
import string
from collections import Counter

from ledgerlark.llm import queries as q
from ledgerlark.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
KINDS = ("assign", "access", "hex")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_op11_equals_plain_patterns(spark, sf):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in q.op11(spark, sf).collect()}
    assert set(got) == set(rows)
    code = S.Novelty(S.identifier_dictionary(spark.read.parquet(f"{sf}/documents.parquet")))
    for i, text in rows.items():
        base = plain(text)
        n = Counter(k for _, k, _ in base)
        assert [got[i][f"n_{x}"] for x in KINDS] == [n[0], n[1], n[2]]
        assert got[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = [s.split(":") for s in got[i]["spans"].split(",") if s]
        assert {tuple(s) for s in spans} >= {(KINDS[k], str(a), str(b)) for a, k, b in base}
        assert got[i]["spans"] == ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in S.all_spans(code, text)[1])


def test_patterns_on_hard_texts():
    for text in ("API_KEY = 'abcdefghijkl'", "apikey:short token=longenough12", "toKen = abcdefghijklmn", "paſſword=abcdefghijklmn", "AKIAAKIA0123456789 AKIAshort", "é" * 40 + "secret: 'a-b_c.d=e/f+g'", "deadbeefdeadbee deadbeefdeadbeef0G", "token token = = token=aaaaaaaaaaaa", "passwd" + " " * 50_000 + ":x", "İ password=İabcdefghijklm"):
        assert S.base_spans(text) == plain(text)


def planted(rng):
    any_ = string.ascii_letters + string.digits
    rnd = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    for before, key, after in (
        ("Authorization: Bearer ", lambda: rnd(any_, 32), "\n"), ("aws access key ", lambda: rnd(any_ + "+/", 40), " end"), ("export GH_PWD=", lambda: rnd(any_, 20), ""), ('"private_key": "', lambda: base64.b64encode(rng.randbytes(24)).decode(), '"'),
        ("credentials (", lambda: rnd(any_, 24), ")"), ("signature is ", lambda: rnd("0123456789ABCDEF", 32), "."),
    ):
        for _ in range(100):
            yield before, key(), after


CLEAN = (
    "auth_handler = getUserAuthenticationToken(request)", "the authorization was granted in 2021-03-04T10:00:00", "Authenticate with https://www.example.com/auth/login", "secret: see config/settings/production2.yaml", "authorName: JohnSmithson", "token.get_access_token_v2",
    'connection_string = os.environ.get("DATABASE_URL2")', "passphrase for utf-8 encoded sha256-checksum", "Author: MacDonaldRobertson", "authors 978-0-306-40615-7 isbn", "auth 2023-10-11-12-13-14", "password_hash_algorithm_sha512", "auth key AUTHENTICATION_KEY_NAME_2",
    "token 00000000-0000-0000-0000-000000000000", "A text with xK9vQ2mB7tR4wZ8pL1nC and nothing sensitive near it, which is no secret by context.",
)


def test_planted_keys_are_found_and_clean_text_is_left_alone():
    code = S.Novelty(S.IDENTIFIERS.encode())
    rng = random.Random(11)
    every = list(planted(rng))
    found = 0
    for before, key, after in every:
        text = "é line of text above\n" + before + key + after
        base, spans = S.all_spans(code, text)
        a = text.index(key)
        found += any(k == 3 and (s, e) == (a, a + len(key)) for s, k, e in spans) or any(s <= a and e >= a + len(key) for s, _, e in base)
    assert found >= 0.97 * len(every)
    for text in CLEAN:
        assert not [s for s in S.all_spans(code, text)[1] if s[1] == 3], text


def test_a_key_that_stands_twice_is_found_twice():
    code = S.Novelty(S.IDENTIFIERS.encode())
    text = "bearer xK9vQ2mB7tR4wZ8pL1nC then again bearer xK9vQ2mB7tR4wZ8pL1nC"
    assert [k for _, k, _ in S.all_spans(code, text)[1]] == [3, 3]


def test_odd_rows(spark):
    long = "token" * 100_000 + " = " + "a1" * 300_000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "secret = 'abcdefghijkl0'"), (4, "auth " * 50_000 + "Zm9vYmFyYmF6cXV4MTIz"), (5, "日本 token: 0123456789abcdef0")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, word string, n_hex int")
    got = sorted(((r["doc_id"] or 0), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in S.find_secrets(df).collect())
    want = []
    for i, t in rows:
        base = plain(t or "")
        n = Counter(k for _, k, _ in base)
        want.append((i or 0, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest()))
    assert got == sorted(want)
    assert S.find_secrets(df.limit(0)).collect() == []
