"""2.15: the normalisers as functions of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerlark.functions import text

#: Name, argument and body of functions that Spark SQL can state; they are inlined where they are called. Fixed values.
SQL = (
    ("norm_supplier", "x STRING", "STRING", "array_join(filter(split(regexp_replace(regexp_replace(upper(x), '[^A-Z0-9 ]+', ' '), '^ *THE ', ''), ' +'), w -> w <> '' AND w NOT IN ('LTD', 'LIMITED', 'PLC', 'AND')), ' ')"),
    ("norm_org", "x STRING", "STRING", "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))"),
    ("parse_amount", "x STRING", "DOUBLE", "CASE WHEN trim(x) RLIKE '^[(].*[)]$' OR trim(x) RLIKE '[0-9.]-$' THEN -1 ELSE 1 END * try_cast(regexp_replace(x, '[£$€,()\\\\s]|-$', '') AS DOUBLE)"),
    ("host_of", "url STRING", "STRING", "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#]*)', 2))"),
    ("fiscal_year_of", "month STRING", "STRING", "CASE WHEN month RLIKE '^[0-9]{4}-[0-9]{2}$' THEN concat(cast(int(left(month, 4)) - IF(int(right(month, 2)) < 4, 1, 0) AS STRING), '-', lpad(cast((int(left(month, 4)) + IF(int(right(month, 2)) < 4, 0, 1)) % 100 AS STRING), 2, '0')) END"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session: their names."""
    for name, argument, kind, body in SQL:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {kind} RETURN {body}")
    for name, f in (("fix_mojibake", text.mojibake()), ("unescape_html", text.entities()), ("porter_stem", text.stems())):
        spark.udf.register(name, f)
    return [name for name, *_ in SQL] + ["fix_mojibake", "unescape_html", "porter_stem"]
