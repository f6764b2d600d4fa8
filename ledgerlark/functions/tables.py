"""2.15: readers of files as table functions of SQL (S-19, S-23).

    SELECT * FROM ledger_rows(TABLE(files) PARTITION BY path)
    SELECT * FROM table_cells(TABLE(files) PARTITION BY (path), 20)

``files`` has path and content, as the binaryFile source gives them; other columns
are ignored.  The result's columns are stated when a query is analysed, and a
table without these two is refused there.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ledgerlark.operators.ledger import decode, parse

#: Lines by which a delimiter is told, and the rows of a file that are shown unless a query says otherwise.
TOLD_BY, SHOWN = 20, 20


def _files(argument: AnalyzeArgument, name: str) -> None:
    fields = {f.name for f in argument.dataType.fields} if argument.isTable else set()
    if not {"path", "content"} <= fields:
        raise ValueError(f"{name} takes TABLE(...) with the columns path and content")


def _schema(**kinds: object) -> StructType:
    out = StructType()
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


class LedgerRows:
    """The raw rows of payment files: what ``operators.ledger.read_ledgers`` gives."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        _files(files, "ledger_rows")
        text = {c: StringType() for c in ("supplier", "amount", "date", "expense_type", "expense_area", "txn")}
        return AnalyzeResult(_schema(file=StringType(), status=StringType(), row=LongType(), **text))

    def eval(self, file: Row) -> Iterator[tuple]:
        try:
            status, rows = parse(bytes(file["content"] or b""))
        except (csv.Error, ValueError) as e:
            status, rows = f"parse-exception: {type(e).__name__}", []
        yield from ((file["path"], status, i, *r) for i, r in enumerate(rows))
        if not rows:
            yield (file["path"], status, None, *[None] * 6)


def delimiter_of(lines: list[str]) -> str:
    """The delimiter that parts most lines into as many cells as the first, more than one; a comma where none does."""

    def score(d: str) -> tuple[int, int]:
        cells = [len(next(csv.reader([line], delimiter=d), [])) for line in lines]
        return (sum(c == cells[0] for c in cells) if cells and cells[0] > 1 else 0), (cells[0] if cells else 0)

    return max(",;\t|", key=score)


class TableCells:
    """The first rows of tables in files, a row for each cell, named by the first line."""

    @staticmethod
    def analyze(files: AnalyzeArgument, rows: AnalyzeArgument | None = None) -> AnalyzeResult:
        _files(files, "table_cells")
        if rows is not None and not rows.isConstantExpression:
            raise ValueError("table_cells takes the number of rows as a constant")
        return AnalyzeResult(_schema(path=StringType(), row=LongType(), column=IntegerType(), name=StringType(), value=StringType()))

    def eval(self, file: Row, rows: int = SHOWN) -> Iterator[tuple]:
        text, _ = decode(bytes(file["content"] or b""))
        told = [line for line in text.splitlines()[:TOLD_BY] if line.strip()]
        try:
            reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(told))
            names: list[str] | None = None
            n = 0
            for cells in reader:
                if not any(c.strip() for c in cells):
                    continue
                if names is None:
                    names = [c.strip() for c in cells]
                    continue
                if n >= rows:
                    break
                yield from ((file["path"], n, i, names[i] if i < len(names) else None, c) for i, c in enumerate(cells))
                n += 1
        except csv.Error:  # what was read before it is shown
            return


def register_tables(spark: SparkSession) -> list[str]:
    """Makes the table functions known to the session: their names."""
    spark.udtf.register("ledger_rows", udtf(LedgerRows))
    spark.udtf.register("table_cells", udtf(TableCells))
    return ["ledger_rows", "table_cells"]
