"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` with the literal tokens
(runs of a-z and 0-9) that every URL it fits must hold whole.  Counts of those
tokens over all URLs choose the rarest of each rule, under which it is filed;
a URL's tokens fetch candidate rules and only those run.  Rules without such a
token are few in a good list and run on every URL.  Host rules (allow or block,
longest first) are compiled to the same form and win over patterns; of patterns
that fit, one that allows wins; a URL that nothing fits is allowed.

Rules come from lines of the common filter syntax: ``*`` is any run, ``^`` a
separator or the end, ``|`` at either end an anchor, ``||`` the start of a host
or one of its labels, ``@@`` before a line an exception, ``!`` a comment; letters
fit in either case.  A literal run is a token only where the pattern itself says
that it ends there.

Cases: a null url, or one without ``://``, has an empty host and path, which no
rule fits, and is allowed; an empty table gives an empty result; repeated rows
are judged each; very long urls are judged whole; of rules of equal rank the
first of the list wins; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int  # host rules: the length of what they name; patterns: 0


def host_rule(verdict: str, name: str) -> Rule:
    """``example.org/es/``: the host and its subdomains, paths that start with ``/es/``."""
    host, path = name[: name.index("/")], name[name.index("/") :]
    whole = _TOKEN.findall(host) + [t for t in re.findall("(?<=/)[a-z0-9]+(?=/)", path)]
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), len(name))


def host_word(word: str) -> Rule:
    """Blocks hosts that hold the word between dots, hyphens or the ends."""
    return Rule(word, "block", rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|$)", (word,), 0)


def path_word(word: str) -> Rule:
    """Blocks paths with the word as a whole segment."""
    return Rule("/" + word, "block", rf"^[^/]*/(?:[^?#]*/)?{word}(?:/|$)", (word,), 0)


_SEPARATOR = "(?:[^a-z0-9_.%-]|$)"


def filter_rule(line: str) -> Rule | None:
    """The rule of a line; None for comments and blank lines."""
    text = line.strip()
    if not text or text.startswith("!"):
        return None
    allow, text = text.startswith("@@"), text.removeprefix("@@").lower()
    host, text = text.startswith("||"), text.removeprefix("||")
    start, end = text.startswith("|"), text.endswith("|")
    body = text[start : len(text) - end]
    pattern = r"^(?:[^/]*\.)?" if host else "^" if start else ""
    pattern += "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) for c in body) + ("$" if end else "")
    # a run ends where another sign or an anchor stands next to it: not at "*" and not at an open end
    tokens = []
    for m in _TOKEN.finditer(body):
        before, after = body[: m.start()][-1:], body[m.end() :][:1]
        if (before not in ("", "*") or (not before and (host or start))) and (after not in ("", "*") or (not after and end)):
            tokens.append(m[0])
    return Rule(line.strip(), "allow" if allow else "block", f"(?i){pattern}", tuple(dict.fromkeys(tokens)), 0)


def read_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    """The rules of a list's lines, such as those of a text file."""
    return tuple(r for r in map(filter_rule, lines) if r)


#: The host rules of the contract. Fixed values.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that mark unwanted hosts and path segments. Fixed values.
HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")
PATH_WORDS = ("adult", "casino", "porn", "xxx")
#: Patterns of paths and hosts without text worth reading: advertisements, counters, sessions, carts, endless calendars. Fixed values.
FILTERS = """
! advertisements and counters
/adserver/
/adserver.
/banners/*/click^
/pagead/
/tracking/pixel^
/beacon.gif|
||adservice.
||doubleclick.net^
||counter.*/hit^
-banner-300x250.
! sessions, carts and forms
/cart/checkout^
/wp-login.php|
/user/login^
/jsessionid/
! endless pages
/calendar/*/day/
/search/results/page/
! files that are no pages
/downloads/*.exe|
/downloads/*.zip|
! pages of these are wanted
@@/about/advertising^
""".splitlines()

RULES = tuple(host_rule(*r) for r in HOST_RULES) + tuple(map(host_word, HOST_WORDS)) + tuple(map(path_word, PATH_WORDS)) + read_rules(FILTERS)
#: Bytes of patterns that are sent to every task; longer lists are refused.
RULE_BYTES = 64 << 20


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    ends = [i for c in "?#" if (i := path.find(c)) >= 0]
    return rest[:cut].translate(_LOWER), path[: min(ends, default=len(path))]


class Index:
    """Rules by their rarest token, given the tokens' counts."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            own = (rule, re.compile(rule.pattern, re.ASCII))
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(own)
            else:
                self.always.append(own)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        text = host + path
        best: Rule | None = None
        if text:
            tokens = set(_TOKEN.findall(text.translate(_LOWER)))
            for rule, pattern in (own for part in (self.always, *(self.by_token.get(t, ()) for t in tokens)) for own in part):
                if (best is None or wins(rule, best)) and pattern.search(text):
                    best = rule
        return host, path, best.name if best and best.rank else None, best.verdict if best else "allow"


def wins(a: Rule, b: Rule) -> bool:
    """Whether a rule goes before another that fits, too: longer host rules first, then exceptions."""
    return (a.rank, a.verdict == "allow") > (b.rank, b.verdict == "allow")


def _judge(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    rules, counts = sent.value
    index = Index(rules, counts)
    for batch in batches:
        rows = [index.judge(u) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4))], names=["page_id", "host", "path", "rule", "verdict"])


def url_tokens(url: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    spark = pages.sparkSession
    if sum(len(r.pattern) for r in rules) > RULE_BYTES:
        raise ValueError(f"a list of more than {RULE_BYTES} bytes of patterns can't be sent to every task")
    asked = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "t string")
    counted = pages.select(F.explode(F.array_distinct(url_tokens(F.col("url")))).alias("t")).join(F.broadcast(asked), "t", "left_semi").groupBy("t").count()
    counts = {r["t"]: r["count"] for r in counted.collect()}  # a row for each token of the rules at most
    sent = spark.sparkContext.broadcast((rules, counts))
    return pages.mapInArrow(partial(_judge, sent=sent), "page_id long, host string, path string, rule string, verdict string")
