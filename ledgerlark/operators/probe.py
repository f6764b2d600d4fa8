"""S-20, S-22..S-26: what landed bytes really are, and what a first look shows of them.

Everything but the list of an archive's members is an expression over the
first bytes of a file.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes of kinds of files, in hexadecimal, and bounds of a look. Fixed values.
SIGNATURES = {"504B0304": "zip", "504B0506": "zip", "1F8B": "gzip", "25504446": "pdf", "53514C69746520666F726D6174203300": "sqlite", "D0CF11E0": "ole"}
LOOK, WHOLE_ARCHIVE, MOST_MEMBERS, MOST_FORMATS, MOST_COLUMNS, MOST_KEYS, LINES = 32_768, 8_000_000, 400, 8, 200, 50, 20
DELIMITERS = (",", ";", "\t", "|")


def signature(content: Column) -> Column:
    """S-20: the kind that the first bytes name; null if they name none."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for first, kind in SIGNATURES.items():
        out = F.when(F.startswith(head, F.lit(first)), kind).otherwise(out)
    opening = F.substring(F.ltrim(F.decode(F.substring(content, 1, 64), "iso-8859-1")), 1, 1)
    return F.coalesce(out, F.when(opening.isin("{", "["), "json"))


def _cells(line: Column, delimiter: Column) -> Column:
    """A line's cells: delimiters inside quotes do not part them."""
    outside = F.concat(F.lit("["), delimiter, F.lit('](?=(?:[^"]*"[^"]*")*[^"]*$)'))
    return F.transform(F.split(line, outside), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))


def table_look(text: Column, cut: Column) -> Column:
    """S-23: struct of columns and lines; ``cut``: whether the text goes on, so that its last line is not whole."""
    every = F.filter(F.split(F.regexp_replace(text, "^\\ufeff", ""), "\r?\n"), lambda x: x != "")
    lines = F.when(cut & (F.size(every) > 1), F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    first = F.get(lines, F.lit(0))

    def says(d: str) -> Column:
        count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))
        own = count(first)
        # how many of the first lines have as many of it as the header, if that has any
        return F.when(own > 0, F.size(F.filter(F.slice(lines, 1, LINES), lambda x: count(x) == own))).otherwise(0)

    best = F.array_max(F.array(*(F.struct(says(d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS))))
    names = F.transform(F.slice(_cells(first, best["d"]), 1, MOST_COLUMNS), lambda c: F.substring(c, 1, 80))
    none = F.array().cast("array<string>")
    return F.struct(F.when(first.isNull(), none).otherwise(names).alias("columns"), F.greatest(F.size(lines) - 1, F.lit(0)).cast("long").alias("rows"))


def json_look(text: Column, cut: Column) -> Column:
    """S-24: struct of format and keys: those of a feature's properties, else of the document."""
    said = F.contains(text, F.lit('"FeatureCollection"'))
    keys = F.json_object_keys(text)
    inner = F.json_object_keys(F.get_json_object(text, "$.features[0].properties"))
    is_map = F.get_json_object(text, "$.type") == "FeatureCollection"
    none = F.array().cast("array<string>")
    names = F.when(cut, none).when(is_map, F.slice(F.coalesce(inner, none), 1, MOST_COLUMNS)).otherwise(F.slice(F.coalesce(keys, none), 1, MOST_KEYS))
    return F.struct(F.when(F.when(cut, said).otherwise(F.coalesce(is_map, F.lit(False))), "GEOJSON").otherwise("JSON").alias("format"), names.alias("columns"))


def members():  # noqa: ANN201
    """S-22: the names in an archive, null if it can't be read (needs a session)."""

    @F.pandas_udf("array<string>")
    def names(content: pd.Series) -> pd.Series:
        def one(raw):  # noqa: ANN001, ANN202
            if raw is None or len(raw) > WHOLE_ARCHIVE:
                return None
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    return [i.filename for i in z.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
                return None

        return content.map(one)

    return names


def header_cells(text: Column) -> Column:
    """S-26: the first line's cells if they look like a header: two or more, fewer than half of them numbers; else null."""
    line = F.get(F.split(F.regexp_replace(text, "^\\ufeff", ""), "\r?\n"), F.lit(0))
    cells = F.transform(F.filter(_cells(line, F.lit(",")), lambda c: c != ""), lambda c: F.substring(c, 1, 60))
    numbers = F.size(F.filter(cells, lambda c: F.replace(c, F.lit("."), F.lit("")).rlike("^[0-9]+$")))
    return F.when((F.size(cells) >= 2) & (2 * numbers < F.size(cells)), F.slice(cells, 1, 40))


def probe(files: DataFrame) -> DataFrame:
    """S-25: rows of (path, content) of the binaryFile source to path, kind, format, members, columns, rows, size, remark.

    First bytes decide, then the path's ending; what can't be read is told in
    ``remark``, never raised.  A null content is an empty file.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    end = F.lower(F.regexp_extract(F.regexp_replace("path", "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    text = F.decode(F.substring(content, 1, LOOK), "iso-8859-1")
    text = F.coalesce(F.try_validate_utf8(F.substring(content, 1, LOOK).cast("string")), text)
    by_end = F.when(end.isin("csv", "tsv", "txt"), "table").when(end.isin("json", "geojson"), "json")
    x = files.select("path", F.octet_length(content).cast("long").alias("size"), F.coalesce(signature(content), by_end, F.lit("unknown")).alias("kind"), text.alias("text"), content.alias("content"))
    zips = x.where("kind = 'zip'").select("path", "size", "kind", members()(F.col("content")).alias("all"))
    ends = F.array_sort(F.array_distinct(F.filter(F.transform("all", lambda n: F.upper(F.regexp_extract(n, r"\.([A-Za-z0-9]+)$", 1))), lambda e: e != "")))
    said = F.when(F.col("all").isNull(), F.when(F.col("size") > WHOLE_ARCHIVE, "larger than is read whole").otherwise("no readable archive")).otherwise(F.concat(F.size("all").cast("string"), F.lit(" members")))
    zips = zips.select("path", "kind", F.array_join(F.slice(ends, 1, MOST_FORMATS), ",").alias("format"), F.slice("all", 1, MOST_MEMBERS).alias("members"), F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("long").alias("rows"), "size", said.alias("remark"))
    cut = F.col("size") > LOOK
    t, j = table_look(F.col("text"), cut), json_look(F.col("text"), cut)
    is_table, is_json = F.col("kind") == "table", F.col("kind") == "json"
    rest = x.where("kind <> 'zip'").select(
        "path", "kind", F.when(is_table, "CSV").when(is_json, j["format"]).when(F.col("kind") != "unknown", F.upper("kind")).alias("format"), F.lit(None).cast("array<string>").alias("members"),
        F.when(is_table, t["columns"]).when(is_json, j["columns"]).alias("columns"), F.when(is_table, t["rows"]).alias("rows"), "size",
        F.when(F.col("size") == 0, "no bytes").when(F.col("kind") == "unknown", "neither bytes nor name tell").when(cut, "only the first bytes were read").alias("remark"),
    )
    return zips.unionByName(rest)
