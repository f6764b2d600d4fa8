"""S-32: which protocol a landed answer speaks, and how many records it says there are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where each protocol's answer holds its count, or its list. Fixed values.
COUNTS = {"ckan": "$.result.count", "ods": "$.total_count", "geonode": "$.total"}
LISTS = {"ckan": "$.result.results", "ods": "$.results", "geonode": "$.resources", "dcat": "$.dataset"}


def protocol(answer: Column) -> Column:
    """ckan, dcat, ods, geonode, csw, json or null for what is neither JSON nor XML."""
    has = lambda path: F.get_json_object(answer, path).isNotNull()
    xml = F.ltrim(answer).rlike("(?s)^<.*(csw:|GetRecordsResponse)")
    return F.when(xml, "csw").when(has(LISTS["ckan"]), "ckan").when(has(LISTS["dcat"]), "dcat").when(has(LISTS["ods"]) & has(COUNTS["ods"]), "ods").when(has(LISTS["geonode"]), "geonode").when(F.try_parse_json(answer).isNotNull(), "json")


def stated_count(answer: Column) -> Column:
    """The number of records that the answer states, else the length of its list."""
    stated = F.coalesce(*(F.get_json_object(answer, p).try_cast("long") for p in COUNTS.values()))
    listed = F.coalesce(*(F.json_array_length(F.get_json_object(answer, p)).cast("long") for p in LISTS.values()))
    return F.coalesce(stated, listed, F.json_array_length(answer).cast("long"))
