"""Normalisers as functions from Column to Column, for batch, streaming and SQL alike.

They stay in whole-stage code generation; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions import values as V

_SPACE = r"[\s ]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(x: Column) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def unrendered(x: Column) -> Column:
    """N-1: a template that a portal left in place of a value."""
    return F.coalesce(F.contains(x, F.lit("{{")), F.lit(False))


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))


def title(x: Column) -> Column:
    """N-2: a usable title or null; machine tokens with underscores are read out as words."""
    t = clean(x)
    words = F.filter(F.split(t, r"[_.]+"), lambda w: w != "")
    has_letter = lambda w: F.lower(w) != F.upper(w)
    spoken = F.transform(words, lambda w: F.when(has_letter(w) & (((w == F.upper(w)) & (F.length(w) > 3)) | (w == F.lower(w))), _capital(w)).otherwise(w))
    usable = (F.length(t) > 2) & ~unrendered(t) & t.rlike("[A-Za-z]")
    machine = F.contains(t, F.lit("_")) & t.rlike(r"^[A-Za-z0-9_.]+$")
    return F.when(usable, F.when(machine, F.array_join(spoken, " ")).otherwise(t))


def distinct_folded(items: Column) -> Column:
    """Items in order, each spelling once whatever its case; the first spelling stays."""

    def first(own: Column) -> Column:
        return let(F.transform(own, F.lower), lambda low: F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    # An expression in a lambda's body is worked out again for each item.
    return let(items, first)


def tags(x: Column) -> Column:
    """N-3: long comma lists are split; blanks and repeats of other case go."""
    parts = F.transform(x, lambda t: F.when(F.contains(t, F.lit(",")) & (F.length(clean(t)) > 45), F.split(t, ",")).otherwise(F.array(t)))
    flat = F.filter(F.transform(F.flatten(F.filter(parts, lambda p: p.isNotNull())), clean), lambda t: t != "")
    return F.coalesce(distinct_folded(flat), F.array().cast("array<string>"))


def unescape(x: Column) -> Column:
    """The five named entities and the no-break space; ``&amp;`` last, so that nothing is unescaped twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_html(x: Column) -> Column:
    """N-5: tags to blanks, then entities, then blanks joined; a template is null, an empty text stays."""
    plain = F.trim(F.regexp_replace(unescape(F.regexp_replace(x, "<[^>]+>", " ")), _SPACE, " "))
    return F.when(x == "", x).when(~unrendered(plain), plain)


def date_text(x: Column, now_year: int) -> Column:
    """N-6: epochs become UTC times; what does not start with a year from 1990 to next year is null."""
    t = clean(x.cast("string"))
    number = t.try_cast("double")
    seconds = F.when(F.length(F.regexp_replace(t, "^-", "")) == 13, number / 1000).otherwise(number)
    stamp = F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.when(t.rlike(r"^-?[0-9]{10}([0-9]{3})?$"), stamp).otherwise(t)
    year = F.regexp_extract(value, r"^([0-9]{4})([^0-9]|$)", 1).try_cast("int")
    return F.when(~unrendered(t) & (t != "") & year.between(1990, now_year + 1), value)


def extras_map(x: Column) -> Column:
    """N-7: key to value of an array of structs; empty values go, the last of a key counts."""
    full = F.filter(x, lambda e: e["key"].isNotNull() & (e["key"] != "") & e["value"].isNotNull() & ~e["value"].isin("", "[]", "null"))
    last = F.filter(full, lambda e, i: ~F.exists(F.slice(full, i + 2, F.size(full)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def bbox(extras: Column) -> Column:
    """N-8: (w, s, e, n) of four extras if all are numbers in range and south is not above north."""
    w, s, e, n = (F.try_element_at(extras, F.lit(k)).try_cast("double") for k in ("bbox-west-long", "bbox-south-lat", "bbox-east-long", "bbox-north-lat"))
    ok = w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90) & (s <= n)
    return F.when(ok, F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n")))


def reference_date(extras: Column) -> Column:
    """N-9: the earliest publication or creation date."""
    entries = F.from_json(F.try_element_at(extras, F.lit("dataset-reference-date")), "array<struct<type:string,value:string>>")
    good = F.filter(entries, lambda e: e["type"].isin("publication", "creation") & (e["value"] != ""))
    return F.array_min(F.transform(good, lambda e: e["value"]))


def update_frequency(extras: Column) -> Column:
    """N-10: at most 40 characters; blank is null."""
    v = F.substring(clean(F.try_element_at(extras, F.lit("frequency-of-update"))), 1, 40)
    return F.when(v != "", v)


def licence_of_extras(extras: Column) -> Column:
    """N-11: the first named licence, else the first licence address; a JSON list counts by its first entry."""
    seen = F.filter(extras, lambda e: F.contains(F.lower(e["key"]), F.lit("licen")))
    first = lambda v: F.try_element_at(F.filter(F.from_json(v, "array<string>"), lambda y: y.isNotNull() & (y != "")), F.lit(1))
    value = lambda e: F.when(F.startswith(clean(e["value"]), F.lit("[")), first(e["value"])).otherwise(clean(e["value"]))
    got = F.filter(F.transform(seen, lambda e: F.struct(F.contains(F.lower(e["key"]), F.lit("url")).alias("url"), value(e).alias("v"))), lambda g: g["v"].isNotNull() & (g["v"] != ""))
    pick = lambda url: F.try_element_at(F.filter(got, lambda g: g["url"] == url), F.lit(1))["v"]
    return F.coalesce(pick(False), pick(True))


def collapse_repeat(x: Column) -> Column:
    """N-12: a text that says one word sequence several times over says it once."""

    def once(w: Column) -> Column:
        n = F.size(w)
        sizes = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (n % k == 0) & (F.slice(w, 1, n - k) == F.slice(w, k + 1, n - k)))
        return F.when(n > 0, F.array_join(F.slice(w, 1, F.array_min(sizes)), " ")).otherwise(x)

    return let(F.filter(F.split(x, _SPACE), lambda t: t != ""), once)


def creative_commons(key: Column) -> Column:
    """N-13: the canonical id of any spelling, by the longest flavour; version 4.0 where none is given."""
    major = F.regexp_extract(key, r"\b([1-4])\.([05])\b", 1)
    version = F.when(major == "", F.lit("4.0")).otherwise(F.concat_ws(".", major, F.regexp_extract(key, r"\b([1-4])\.([05])\b", 2)))

    def named(flat: Column) -> Column:
        # Each flavour: what follows "by" in an id or an address, and its words after "attribution"; the longest first.
        flavour = F.when(flat.rlike(r"\bcc0\b|\bcczero\b|\bzero\b|publicdomain|public domain"), "CC0-1.0")
        for tail, said in (("nc sa", "non ?commercial ?share"), ("nc nd", "non ?commercial ?no ?deriv"), ("sa", "share"), ("nc", "non ?commercial"), ("nd", "no ?deriv")):
            hit = flat.rlike(f"cc ?by ?{tail.replace(' ', ' ?')}|licenses by {tail}|attribution ?{said}")
            flavour = flavour.when(hit, F.concat(F.lit(f"CC-BY-{tail.upper().replace(' ', '-')}-"), version))
        return flavour.when(flat.rlike(r"cc ?by\b|licenses by\b|\battribution\b"), F.concat(F.lit("CC-BY-"), version))

    asked = key.rlike(r"(?i)creative\s*commons|creativecommons|^cc[\s\-_]?(by|0|zero)")
    return F.when(asked, let(F.trim(F.regexp_replace(F.lower(key), "[^a-z0-9.]+", " ")), named))


def licence(identifier: Column, heading: Column | None = None) -> Column:
    """N-14: the canonical licence of an id, else of its title; null where both state none."""

    def of(raw: Column) -> Column:
        return let(F.lower(raw), lambda key: by_rule(raw, key))

    def by_rule(raw: Column, key: Column) -> Column:
        has = lambda needle: F.contains(key, F.lit(needle))
        rule = [F.when(key.isin(*(k for k, v in V.LICENCE_IDS.items() if v is None)), ""), lookup({k: v for k, v in V.LICENCE_IDS.items() if v}, key), lookup(V.LICENCE_URLS, F.regexp_replace(key, "/+$", "")), F.when(key.rlike("open government licen[cs]e"), F.lit("OGL-UK-3.0")), creative_commons(key)]
        rule += [F.when(reduce(lambda a, b: a | b, map(has, needles)), F.lit(label)) for label, needles in V.MAPPING_LICENCES.items()]
        rule.append(F.when(F.startswith(key, F.lit("http")) & has("open-government-licence"), F.lit("OGL-UK-3.0")))
        rule.append(F.when(F.length(raw) <= 60, raw).otherwise(F.lit("Custom licence")))
        return F.coalesce(*rule)

    def one(x: Column) -> Column:
        got = let(unescape(collapse_repeat(clean(F.regexp_replace(x, _SPACE, " ")))), of)
        return F.when(clean(x) != "", F.nullif(got, F.lit("")))

    return one(identifier) if heading is None else F.coalesce(one(identifier), one(heading))


def file_format(x: Column) -> Column:
    """N-15: media types and spellings to labels; other single tokens in capitals; else null."""
    t = F.regexp_replace(clean(F.regexp_replace(clean(x), r"(?i)^https?://www\.iana\.org/assignments/media-types/", "")), r"^\.+", "")
    low = F.lower(t)
    return F.coalesce(lookup(V.MEDIA_TYPES, low), lookup(V.FORMAT_SPELLINGS, low), F.when(t.rlike(r"^[A-Za-z0-9+.\-]{1,20}$"), F.upper(t)))


def file_formats(x: Column) -> Column:
    """N-16: labels in order, each once."""
    return F.array_distinct(F.filter(F.transform(x, file_format), lambda f: f.isNotNull()))


def plausible_bbox(box: Column, publisher: Column) -> Column:
    """N-17: a council's box may span 5 degrees of longitude and 3 of latitude at most."""
    wide = (box["e"] - box["w"] > 5.0) | (box["n"] - box["s"] > 3.0)
    return F.when(~(F.coalesce(F.lower(publisher).rlike(r"\bcouncil\b|\bborough\b"), F.lit(False)) & wide), box)


def polygon_bbox(points: Column) -> Column:
    """N-19: the box of [x, y] points, longitude first or else latitude first, that is valid and meets the British Isles."""

    def box(i: int, j: int) -> Column:
        x, y = F.transform(points, lambda p: p[i]), F.transform(points, lambda p: p[j])
        w, s, e, n = F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)
        ok = (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90) & (w < e) & (s < n)
        uk = (w <= 5) & (e >= -25) & (s <= 65) & (n >= 45)
        return F.when(ok & uk, F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n")))

    return F.coalesce(box(0, 1), box(1, 0))


def dig(x: Column, path: str) -> Column:
    """N-20: the value at a dotted path of JSON text; an empty path is the whole."""
    return x if not path else F.get_json_object(x, "$." + path)


def bag(entries: Column, key: str, value: str, shown: str | None = None) -> Column:
    """N-21: name to value of an array of structs; a shown value comes first, a vocabulary prefix goes."""

    def plain(v: Column) -> Column:
        head = F.regexp_extract(v, r"^([A-Za-z]+):(?!//)(.*)$", 2)
        return F.when(head != "", clean(head)).otherwise(v)

    pick = lambda e: F.coalesce(e[shown], e[value]) if shown else e[value]
    full = F.filter(entries, lambda e: (e[key].isNotNull()) & pick(e).isNotNull())
    once = F.filter(full, lambda e, i: ~F.exists(F.slice(full, i + 2, F.size(full)), lambda later: later[key] == e[key]))
    return F.map_from_entries(F.transform(once, lambda e: F.struct(e[key], plain(pick(e)))))


def name_key(x: Column) -> Column:
    """N-23: lower case, runs of other signs as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def who(publisher: Column) -> Column:
    """N-24: the words that say which body it is, sorted."""
    words = F.filter(F.split(name_key(publisher), " "), lambda w: w != "")
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, V.PUBLISHER_NOISE + V.PLATFORM_WORDS))))


def identity(publisher: Column) -> Column:
    """N-25: the words of a council without platform words; all words where none is left."""
    words = F.array_distinct(F.filter(F.split(name_key(publisher), " "), lambda w: w != ""))
    kept = who(publisher)
    return F.when(F.size(kept) == 0, F.array_sort(words)).otherwise(kept)


def supplier_key(x: Column) -> Column:
    """N-26: capitals, other signs as blanks, without legal forms and a leading THE."""
    words = F.filter(F.split(F.regexp_replace(F.upper(x), "[^A-Z0-9 ]+", " "), " +"), lambda w: (w != "") & ~w.isin("LTD", "LIMITED", "PLC", "AND"))
    return F.array_join(F.when(F.get(words, F.lit(0)) == "THE", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words), " ")


def has_words(text_key: Column, words_key: Column) -> Column:
    """N-28: whether one normalised name holds another as whole words in order."""
    return F.contains(F.concat(F.lit(" "), text_key, F.lit(" ")), F.concat(F.lit(" "), words_key, F.lit(" ")))


def amount(x: Column) -> Column:
    """N-29: money of a free-form cell; parentheses or a trailing minus make it negative."""
    t = F.regexp_replace(clean(x), r"[£$€,\s ]", "")
    negative = t.rlike(r"^\(.*\)$") | t.rlike("[0-9.]-$")
    bare = F.regexp_replace(t, r"^\(|\)$|-$", "")
    number = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), bare.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def _date(y: Column, m: Column, d: Column) -> Column:
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when(y.between(1990, 2099), day)


def ledger_date(x: Column, style: Column) -> Column:
    """N-31: iso, compact, slash by the file's style (the other order where that fails), text month, spreadsheet serial."""
    iso = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"
    slash = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})(?:[^0-9]|$)"
    month = r"^([0-9]{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -]([0-9]{4})"
    parts = lambda t, pattern: F.array(*(F.regexp_extract(t, pattern, i) for i in (1, 2, 3)))
    number = lambda p, i: p[i].try_cast("int")

    def slashed(p: Column) -> Column:
        short = number(p, 2)
        year = F.when(short < 70, short + 2000).when(short < 100, short + 1900).otherwise(short)
        dmy, mdy = _date(year, number(p, 1), number(p, 0)), _date(year, number(p, 0), number(p, 1))
        return F.when(style == "mdy", F.coalesce(mdy, dmy)).otherwise(F.coalesce(dmy, mdy))

    def named(p: Column) -> Column:
        day = F.try_to_date(F.concat_ws(" ", p[0], F.initcap(p[1]), p[2]), "d MMM yyyy")
        return F.when(day.between(F.lit("1990-01-01").cast("date"), F.lit("2099-12-31").cast("date")), day)

    def read(t: Column) -> Column:
        compact = _date(F.substring(t, 1, 4).try_cast("int"), F.substring(t, 5, 2).try_cast("int"), F.substring(t, 7, 2).try_cast("int"))
        serial = t.try_cast("double")
        return (
            F.when(t.rlike(iso), let(parts(t, iso), lambda p: _date(number(p, 0), number(p, 1), number(p, 2))))
            .when(t.rlike("^[0-9]{8}$"), compact).when(t.rlike(slash), let(parts(t, slash), slashed)).when(t.rlike(month), let(parts(t, month), named))
            .when((serial > 30000) & (serial < 60000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")))
        )

    return let(F.substring(clean(x), 1, 40), read)


def fiscal_year(year_month: Column) -> Column:
    """N-37: ``2023-04`` starts 2023-24."""
    y, m = F.substring(year_month, 1, 4).try_cast("int"), F.substring(year_month, 6, 2).try_cast("int")
    start = F.when(m >= 4, y).otherwise(y - 1)
    return F.when(start.isNotNull(), F.format_string("%04d-%02d", start, (start + 1) % 100))


def summarise(x: Column, limit: int = 155) -> Column:
    """N-41: at most ``limit`` signs, cut at a blank beyond 60 % of them, with an ellipsis."""
    t = F.trim(F.regexp_replace(x, _SPACE, " "))
    cut = F.substring(t, 1, limit)
    blank = limit - F.locate(" ", F.reverse(cut))
    short = F.when((F.locate(" ", F.reverse(cut)) > 0) & (blank > limit * 0.6), F.expr("null").cast("string")).otherwise(cut)
    at_blank = F.substring(cut, F.lit(1), blank)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.coalesce(short, at_blank)), F.lit("…")))


def initial(x: Column) -> Column:
    """The letter under which a name is listed; ``#`` for others."""
    c = F.upper(F.substring(F.trim(x), 1, 1))
    return F.when(c.rlike("^[A-Z]$"), c).otherwise(F.lit("#"))


def is_thin(description: Column, resources: Column, tag_list: Column, formats: Column) -> Column:
    """N-43: a page with nothing to index."""
    return (F.length(F.coalesce(F.trim(description), F.lit(""))) < 40) & (F.coalesce(resources, F.lit(0)) == 0) & (F.coalesce(F.size(tag_list), F.lit(0)) <= 0) & (F.coalesce(F.size(formats), F.lit(0)) <= 0)


def fingerprint(*columns: Column) -> Column:
    """N-46: sixteen hex digits over the display columns."""
    return F.substring(F.sha1(F.concat_ws("␟", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))), 1, 16)


def host(url: Column) -> Column:
    """N-47: the host in lower case, with its port."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.when(h != "", h)


def shape(x: Column) -> Column:
    """N-50: digits as 9, at most 24 signs."""
    return F.substring(F.regexp_replace(x, "[0-9]", "9"), 1, 24)


def link_verdict(url: Column, status: Column, content_type: Column, label: Column) -> Column:
    """N-51: what an answer says about a link."""
    base = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    starts = lambda kinds: reduce(lambda a, b: a | b, (F.startswith(base, F.lit(k)) for k in kinds))
    hint = reduce(lambda a, b: a | b, (F.contains(F.lower(url), F.lit(h)) for h in V.API_HINTS)) | F.coalesce(label, F.lit("")).isin(*V.API_FORMATS)
    return (
        F.when(status.isin(*V.BLOCKED_STATUSES, *V.REFUSED_STATUSES), "blocked").when(status == 0, "unreachable").when(status >= 400, "dead")
        .when(starts(V.FILE_TYPES), "data").when(hint, "api").when(starts(V.DATA_TYPES), "data")
        .when(base.isin("text/html", "application/xhtml+xml", ""), "webpage").when(starts(("text/", "image/", "application/")), "data").otherwise("webpage")
    )


def index_text(name: Column, publisher: Column, tag_list: Column, description: Column) -> Column:
    """N-52: what an embedding is made of; blank parts go."""
    part = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x))
    return F.concat_ws("\n", part("", name), part("Publisher: ", publisher), part("Tags: ", F.array_join(tag_list, ", ")), part("", F.substring(description, 1, 600)))
