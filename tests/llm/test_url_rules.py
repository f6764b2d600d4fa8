"""Filter lists through the table, against every rule on every URL."""

import random
import re

import pytest

from ledgerlark.llm import url_rules as u

ODD = [None, "", "x", "://", "http://", "http:///a", "http://Ads.Example.ORG/ES/", "http://a/" + "b/" * 20_000 + "xxx/", "http://a/b?://c/casino/"]


def plain(rules, url):
    host, path = u.split_url(url)
    fit = [r for r in rules if host + path and re.search(r.pattern, host + path, re.ASCII)]
    named = max((r for r in fit if r.rank), key=lambda r: r.rank, default=None)
    said = named.verdict if named else "allow" if any(r.verdict == "allow" for r in fit) else "block" if fit else "allow"
    return host, path, named.name if named else None, said


@pytest.mark.parametrize(("line", "tokens"), [("/ads/", ("ads",)), ("ads", ()), ("/ads*", ()), ("||ads.example^", ("ads", "example")), ("|http", ()), ("/a-b_c/", ("a", "b", "c")), ("pixel.gif|", ("gif",)), ("/x*/y/", ("y",)), ("@@/Ok/", ("ok",)), ("^ab^", ("ab",))])
def test_tokens_are_those_that_the_pattern_ends(line, tokens):
    assert u.filter_rule(line).tokens == tokens


def test_lines():
    assert u.filter_rule("! note") is None and u.filter_rule("  ") is None
    r = u.filter_rule("||ads.example^")
    fits = lambda rule, x: bool(re.search(rule.pattern, x))
    assert fits(r, "a.ads.example/x") and fits(r, "ads.example") and not fits(r, "bads.example/") and not fits(r, "ads.example.org/")
    assert fits(u.filter_rule("/A*b|"), "h/axxB") and not fits(u.filter_rule("/a*b|"), "h/axxbc")


def test_thousands_of_rules_equal_each_in_turn(spark, sf):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["example", "org", "com", "en", "de", "blog"]
    form = lambda: r.choice(["/{}/", "||{}.{}^", "{}", "/{}*{}/", "@@/{}/", "-{}.", "/{}^", "{}|", "^{}^{}^"])
    lines = [f.format(r.choice(words), r.choice(words)) for f in (form() for _ in range(3_000))]
    rules = tuple(u.host_rule(*x) for x in u.HOST_RULES) + u.read_rules(lines)
    urls = ODD + [x["url"] for x in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [f"https://{r.choice(words)}.{r.choice(words)}.org/{'/'.join(r.choices(words, k=r.randint(0, 4)))}{r.choice(['', '/', '?q', '.html'])}" for _ in range(300)]
    rows = [(i if i % 7 else None, x, "clash", "clash") for i, x in enumerate(urls)]
    got = u.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, t string"), rules).collect()
    want = sorted(repr((i if i % 7 else None, *plain(rules, x))) for i, x in enumerate(urls))
    assert sorted(repr(tuple(x)) for x in got) == want and {x["verdict"] for x in got} == {"allow", "block"}


def test_empty_table_and_lists(spark):
    d = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(d).collect() == []
    one = spark.createDataFrame([(1, "http://ads.x/casino/")], "page_id long, url string")
    assert [tuple(r) for r in u.judge_urls(one, ()).collect()] == [(1, "ads.x", "/casino/", None, "allow")]
