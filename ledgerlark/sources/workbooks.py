"""S-27, S-28, R-4: sheets of XLSX files, headers of one or two levels, durations in any of their spellings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "file string, sheet string, row long, col int, value string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def column_number(ref: str) -> int:
    """The 0-based column of a cell reference: A1 is 0, AA7 is 26."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the cells that hold anything."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for title, part in zip(titles, sheets):
            for c in (e for e in ElementTree.fromstring(z.read(part)).iter() if _local(e.tag) == "c"):
                text = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                if text:
                    ref = c.get("r")
                    yield title, int(re.search(r"\d+", ref)[0]), column_number(ref), text


def read_cells(files: DataFrame) -> DataFrame:
    """Rows of the binaryFile source (path, content) to cells; a file that is no workbook has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"]):
                try:
                    found = [(path, *c) for c in cells(bytes(content or b""))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError):
                    found = []
                yield pd.DataFrame(found, columns=[c.split()[0] for c in CELLS.split(", ")])

    return files.select("path", "content").mapInPandas(run, CELLS)


def flat_table(sheet_cells: DataFrame, header_row: int) -> DataFrame:
    """file, sheet, row, name, value under a header of one row."""
    head = sheet_cells.where(F.col("row") == header_row).select("file", "sheet", "col", F.trim("value").alias("name"))
    return sheet_cells.where(F.col("row") > header_row).join(head, ["file", "sheet", "col"]).select("file", "sheet", "row", "name", "value")


def two_level_table(sheet_cells: DataFrame, upper_row: int, lower_row: int) -> DataFrame:
    """The same with a header of two rows: the upper one's cells reach to the right until the next (W-8)."""
    from pyspark.sql import Window

    heads = sheet_cells.where(F.col("row").isin(upper_row, lower_row)).groupBy("file", "sheet", "col").agg(F.max(F.when(F.col("row") == upper_row, F.trim("value"))).alias("upper"), F.max(F.when(F.col("row") == lower_row, F.trim("value"))).alias("lower"))
    w = Window.partitionBy("file", "sheet").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.withColumn("upper", F.last("upper", ignorenulls=True).over(w)).where("lower is not null")
    return sheet_cells.where(F.col("row") > lower_row).join(heads, ["file", "sheet", "col"]).select("file", "sheet", "row", "upper", "lower", "value")


def hours(x: Column) -> Column:
    """S-28: a duration as hours: ``hh:mm[:ss]``, ``d days hh:mm:ss`` or a fraction of a day."""
    t = F.trim(x)
    clock = r"^(?:([0-9]+) days?,? )?([0-9]+):([0-9]{2})(?::([0-9]{2}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(t, clock, i).try_cast("double"), F.lit(0.0))
    return F.when(t.rlike(clock), 24 * part(1) + part(2) + part(3) / 60 + part(4) / 3600).otherwise(t.try_cast("double") * 24)


def sheet():  # noqa: ANN201
    """A workbook of one sheet with a header and a row of texts, as bytes (needs a session)."""

    @F.pandas_udf("binary")
    def make(head: pd.Series, row: pd.Series) -> pd.Series:
        def one(lines) -> bytes:  # noqa: ANN001
            cell = lambda i, r, v: f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
            body = "".join(f'<row r="{r}">{"".join(cell(i, r, v) for i, v in enumerate(values) if v is not None)}</row>' for r, values in enumerate(lines, 1))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="One"/></sheets></workbook>')
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')
            return out.getvalue()

        return pd.Series([one(x) for x in zip(head, row)])

    return make
