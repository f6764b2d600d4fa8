"""Landed catalogue payloads of six protocols to one schema.

Each protocol has a schema for its records and a set of expressions; what they
share (licence, dates, tags, formats, children) is said once in ``finish``.
Records without a usable title or identifier drop out.  Paging and transport
are left to whatever lands the payloads.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import normalise as N

KEYED = "array<struct<key:string,value:string>>"
CKAN = f"id string, name string, title string, notes string, organization struct<title:string>, license_id string, license_title string, metadata_created string, metadata_modified string, tags array<struct<name:string>>, extras {KEYED}, resources array<struct<url:string,name:string,format:string>>"
DCAT = "identifier string, landingPage string, title string, description string, license string, issued string, modified string, keyword array<string>, publisher struct<name:string>, contactPoint struct<fn:string>, distribution array<struct<title:string,format:string,mediaType:string,accessURL:string,downloadURL:string>>"
ODS = "dataset_id string, has_records boolean, metas struct<default:struct<title:string,description:string,license:string,license_url:string,publisher:string,modified:string,keyword:array<string>,theme:array<string>,geometry_types:array<string>>>"
GEONODE = "uuid string, pk string, name string, title string, alternate string, workspace string, raw_abstract string, abstract string, license struct<identifier:string>, category struct<identifier:string>, keywords array<struct<name:string>>, ll_bbox_polygon struct<coordinates:array<array<array<double>>>>, created string, date string, last_updated string, detail_url string"
CSW = "identifier string, title string, abstract string, description string, rights string, modified string, date string, subject array<string>, URI array<string>, references array<string>"

# Access-constraint codes that are no licence, and workspaces of publishers. Fixed values.
ACCESS_CODES = ("otherrestrictions", "restricted", "unclassified", "copyright", "license", "licence", "intellectualpropertyrights")
WORKSPACES = {
    "inspire-nrw": "Natural Resources Wales", "appdata-nrw": "Natural Resources Wales", "appdata-ons": "Office for National Statistics",
    "inspire-wg": "Welsh Government", "appdata-wg": "Welsh Government", "appdata-wg-marine": "Welsh Government",
}


@dataclass(frozen=True)
class Source:
    """An entry of the registry; ``dataset_url`` has {name} or {id}, ``fields`` are the paths of a bespoke JSON source."""

    id: str
    name: str
    web: str
    dataset_url: str | None = None
    fields: Mapping[str, object] = field(default_factory=dict)


def _full(c: Column) -> Column:
    return F.when(N.clean(c) != "", c)


def _url(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def finish(records: DataFrame, src: Source, now_year: int, c: Mapping[str, Column]) -> DataFrame:
    """The catalogue's columns from a protocol's expressions.

    ``c``: ident, title, description, publisher, license_raw, landing, tags
    (array), formats (array), and optionally name, license_title, created,
    modified, resources (array of url, name, format), extras (a map).
    """
    none = F.lit(None).cast("string")
    children = c.get("resources", F.array().cast("array<struct<url:string,name:string,format:string>>"))
    web = F.filter(children, lambda r: F.startswith(r["url"], F.lit("http")))
    first = lambda own: N.let(F.transform(own, lambda x: x["url"]), lambda urls: F.filter(own, lambda r, i: F.array_position(urls, r["url"]) == i + 1))
    once = N.let(web, first)
    shown = F.transform(once, lambda r: F.struct(r["url"].alias("url"), F.substring(F.coalesce(r["name"], F.lit("")), 1, 200).alias("name"), N.file_format(r["format"]).alias("format_norm")))
    publisher = c["publisher"]
    extras = c.get("extras")
    box = N.plausible_bbox(N.bbox(extras), publisher) if extras is not None else c.get("bbox", F.lit(None).cast("struct<w:double,s:double,e:double,n:double>"))
    out = records.select(
        F.concat(F.lit(src.id + ":"), c["ident"]).alias("key"), F.lit(src.id).alias("source_id"), c["ident"].alias("ckan_id"), F.coalesce(c.get("name", none), c["ident"]).alias("name"),
        N.title(c["title"]).alias("title"), N.strip_html(c["description"]).alias("description"), publisher.alias("publisher"), c["license_raw"].alias("license_raw"),
        N.licence(c.get("license_id", c["license_raw"]), c.get("license_title", none)).alias("license_norm"), N.date_text(c.get("created", none), now_year).alias("created"), N.date_text(c.get("modified", none), now_year).alias("modified"),
        c["landing"].alias("landing_url"), c["tags"].alias("tags"), F.filter(c["formats"], lambda f: F.coalesce(f, F.lit("")) != "").alias("formats_raw"), N.file_formats(c["formats"]).alias("formats_norm"),
        c.get("count", F.size(c["formats"])).cast("int").alias("resource_count"), shown.alias("resources"), box.alias("bbox"),
        (N.update_frequency(extras) if extras is not None else none).alias("update_frequency"), (N.reference_date(extras) if extras is not None else none).alias("reference_date"),
        *([c["salt"].alias("salt")] if "salt" in c else []),
    )
    return out.where("title is not null and ckan_id is not null")


def _names(items: Column) -> Column:
    """The names of an array of structs, without blanks; a missing array is empty."""
    return F.coalesce(F.filter(F.transform(items, lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), F.array().cast("array<string>"))


def _some(items: Column, kind: str = "string") -> Column:
    return F.coalesce(items, F.array().cast(f"array<{kind}>"))


def ckan(packages: DataFrame, src: Source, now_year: int) -> DataFrame:
    """S-2: packages; the licence is the id, the title, or that of the extras."""
    r = F.col
    extra = N.licence_of_extras(r("extras"))
    name = F.coalesce(_full(r("name")), r("id"))
    resources = _some(r("resources"), "struct<url:string,name:string,format:string>")
    return finish(packages, src, now_year, {
        "ident": r("id"), "name": name, "title": r("title"), "description": r("notes"), "publisher": r("organization.title"),
        "license_raw": F.coalesce(_full(r("license_id")), _full(r("license_title")), extra), "license_id": F.coalesce(_full(r("license_id")), extra), "license_title": r("license_title"),
        "created": r("metadata_created"), "modified": r("metadata_modified"), "landing": _url(src.dataset_url or src.web, name=name), "tags": N.tags(_names(r("tags"))),
        "formats": F.transform(resources, lambda x: x["format"]), "resources": resources, "extras": F.coalesce(N.extras_map(r("extras")), F.create_map().cast("map<string,string>")),
    })


def dcat(datasets: DataFrame, src: Source, now_year: int) -> DataFrame:
    """S-4..S-6: entries of a feed; without identifier and link, publisher and title make the key.  Adds ``salt``."""
    r = F.col

    def body(x: Column) -> Column:
        name = N.clean(x)
        hostname = F.contains(name, F.lit(".")) & ~F.contains(name, F.lit(" ")) & (name == F.lower(name)) & (name != F.upper(name))
        return F.when((name != "") & ~N.unrendered(name) & ~hostname, name)

    publisher = F.coalesce(body(r("publisher.name")), body(r("contactPoint.fn")), F.lit(src.name))
    links = _some(r("distribution"), "struct<title:string,format:string,mediaType:string,accessURL:string,downloadURL:string>")
    web_first = F.concat(F.filter(links, lambda d: F.contains(F.lower(F.coalesce(d["title"], F.lit(""))), F.lit("web"))), links)
    page = F.try_element_at(F.filter(F.transform(web_first, lambda d: F.coalesce(_full(d["accessURL"]), _full(d["downloadURL"]))), lambda u: F.startswith(u, F.lit("http"))), F.lit(1))
    landing = F.coalesce(_full(r("landingPage")), page)
    seed = F.concat(F.lit("sha1:"), F.substring(F.sha1(F.concat(publisher, F.lit("|"), N.title(r("title"))).cast("binary")), 1, 16))
    ident = F.coalesce(_full(r("identifier")), landing, seed)
    tail = F.regexp_extract(F.regexp_replace(F.coalesce(landing, ident), "/+$", ""), "([^/]*)$", 1)
    license_raw = F.substring(N.strip_html(r("license")), 1, 150)
    formats = F.transform(links, lambda d: F.coalesce(_full(d["format"]), d["mediaType"]))
    resources = F.transform(links, lambda d: F.struct(F.coalesce(_full(d["downloadURL"]), d["accessURL"]).alias("url"), d["title"].alias("name"), F.coalesce(_full(d["format"]), d["mediaType"]).alias("format")))
    first = F.try_element_at(F.filter(F.transform(links, lambda d: F.coalesce(_full(d["downloadURL"]), _full(d["accessURL"]))), lambda u: u.isNotNull()), F.lit(1))
    return finish(datasets, src, now_year, {
        "ident": ident, "name": F.when(tail != "", tail), "title": r("title"), "description": r("description"), "publisher": publisher, "license_raw": license_raw, "created": r("issued"), "modified": r("modified"),
        "landing": landing, "tags": N.tags(_some(r("keyword"))), "formats": formats, "resources": resources, "salt": F.substring(F.sha1(first.cast("binary")), 1, 8),
    })


def salt_collisions(catalogue: DataFrame, order: Column) -> DataFrame:
    """X-9: of records with one key the first (by ``order``) keeps it; later ones get their first link's hash, or an ordinal where that repeats."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("key").orderBy(order)) - 1
    x = catalogue.withColumn("nth", nth)
    again = F.row_number().over(Window.partitionBy("key", F.coalesce("salt", F.lit("")), F.col("nth") > 0).orderBy("nth")) > 1
    suffix = F.when(F.col("nth") == 0, "").when(F.col("salt").isNull() | again, F.concat(F.lit("~n"), F.col("nth").cast("string"))).otherwise(F.concat(F.lit("~"), F.col("salt")))
    x = x.withColumn("suffix", suffix)
    return x.withColumn("key", F.concat("key", "suffix")).withColumn("ckan_id", F.concat("ckan_id", "suffix")).drop("nth", "suffix", "salt")


def ods(datasets: DataFrame, src: Source, now_year: int) -> DataFrame:
    """S-8: formats are those that can be exported: none without records."""
    r = lambda name: F.col("metas.default." + name)
    base = src.web.rstrip("/")
    formats = F.when(F.col("has_records"), F.concat(F.array(F.lit("CSV"), F.lit("JSON")), F.when(F.size(_some(r("geometry_types"))) > 0, F.array(F.lit("GEOJSON"))).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    resources = F.transform(formats, lambda f: F.struct(_url(base + "/api/explore/v2.1/catalog/datasets/{id}/exports/{fmt}", id=F.col("dataset_id"), fmt=F.lower(f)).alias("url"), f.alias("name"), f.alias("format")))
    return finish(datasets, src, now_year, {
        "ident": F.col("dataset_id"), "title": r("title"), "description": r("description"), "publisher": F.coalesce(_full(r("publisher")), F.lit(src.name)), "license_raw": r("license"), "license_title": r("license_url"),
        "modified": r("modified"), "landing": _url(base + "/explore/dataset/{id}/", id=F.col("dataset_id")), "tags": F.filter(F.concat(_some(r("keyword")), _some(r("theme"))), lambda k: F.coalesce(k, F.lit("")) != ""), "formats": formats, "resources": resources,
    })


def csw(records: DataFrame, src: Source, now_year: int) -> DataFrame:
    """S-10: Dublin Core records; access-constraint codes are no licence."""
    r = F.col
    rights = F.when(~F.lower(N.clean(r("rights"))).isin(*ACCESS_CODES), N.clean(r("rights")))
    urls = F.filter(F.concat(_some(r("URI")), _some(r("references"))), lambda u: F.startswith(N.clean(u), F.lit("http")))
    ident = _full(N.clean(r("identifier")))
    page = _url(src.dataset_url, id=ident) if src.dataset_url else F.coalesce(F.try_element_at(urls, F.lit(1)), F.lit(src.web))
    return finish(records, src, now_year, {
        "ident": ident, "title": r("title"), "description": F.coalesce(_full(r("abstract")), r("description")), "publisher": F.lit(src.name), "license_raw": rights, "modified": F.coalesce(_full(r("modified")), r("date")),
        "landing": page, "tags": F.slice(_some(r("subject")), 1, 25), "formats": F.array().cast("array<string>"), "count": F.size(urls),
        "resources": F.transform(urls, lambda u: F.struct(N.clean(u).alias("url"), F.lit("").alias("name"), F.lit(None).cast("string").alias("format"))),
    })


def geonode(layers: DataFrame, src: Source, now_year: int) -> DataFrame:
    """S-14, S-15, N-19: layers; the workspace names the publisher, never the uploader; links follow from the layer's name."""
    r = F.col
    base = src.web.rstrip("/")
    space = F.lower(N.clean(F.coalesce(r("workspace"), F.lit(""))))
    publisher = F.lit(src.name)
    for prefix, name in sorted(WORKSPACES.items()):  # later ones, which are longer, win
        publisher = F.when((space == prefix) | F.startswith(space, F.lit(prefix + "-")), F.lit(name)).otherwise(publisher)
    lic = N.clean(F.coalesce(r("license.identifier"), F.lit("")))
    ident = F.coalesce(_full(r("uuid")), _full(r("pk")))
    feature = base + "/geoserver/wfs?service=WFS&version=2.0.0&request=GetFeature&typeName={alt}&outputFormat="
    offered = [(feature + "application/json", "GeoJSON (WFS)", "GeoJSON"), (feature + "SHAPE-ZIP", "Shapefile (WFS)", "SHP"), (feature + "csv", "CSV (WFS)", "CSV"), (base + "/geoserver/wms?service=WMS&version=1.3.0&request=GetCapabilities", "WMS service", "WMS")]
    links = F.array(*(F.struct(_url(u, alt=r("alternate")).alias("url"), F.lit(n).alias("name"), F.lit(f).alias("format")) for u, n, f in offered))
    resources = F.when(_full(r("alternate")).isNotNull(), links).otherwise(F.array().cast("array<struct<url:string,name:string,format:string>>"))
    keywords = F.concat(_names(r("keywords")), F.when(_full(r("category.identifier")).isNotNull(), F.array(r("category.identifier"))).otherwise(F.array().cast("array<string>")))
    return finish(layers, src, now_year, {
        "ident": ident, "name": _full(r("name")), "title": r("title"), "description": F.coalesce(_full(r("raw_abstract")), r("abstract")), "publisher": publisher, "license_raw": F.when(~lic.isin("", "not_specified"), lic),
        "created": r("created"), "modified": F.coalesce(_full(r("last_updated")), r("date")), "landing": F.coalesce(_full(r("detail_url")), _url(base + "/layers/{id}", id=F.coalesce(_full(r("alternate")), ident))),
        "tags": N.tags(keywords), "formats": F.transform(resources, lambda x: x["format"]), "resources": resources, "bbox": N.polygon_bbox(F.flatten(r("ll_bbox_polygon.coordinates"))),
    })


def bespoke(records: DataFrame, src: Source, now_year: int, record: str = "value", details: DataFrame | None = None) -> DataFrame:
    """S-11, S-12: JSON text in ``record`` mapped by the source's paths.

    Paths: id, title, description, publisher, created, modified, license,
    landing (a template with {id}) or landing_field, tags (a path or several),
    resources ([url path, format path or "=LITERAL"], …), formats (a path).
    ``details`` (id, value) are richer records that win over the listed ones.
    """
    cfg = src.fields
    dig = lambda path: N.dig(F.col(record), path)
    if details is not None:
        more = details.select(F.col("id").alias("detail_id"), F.col("value").alias("detail_value"))
        merged = F.coalesce(F.col("detail_value"), F.col(record))
        records = records.join(more, dig(str(cfg["id"])) == F.col("detail_id"), "left").withColumn(record, merged)
    at = lambda name: _full(dig(str(cfg[name]))) if cfg.get(name) else F.lit(None).cast("string")
    lic = at("license")
    lic = F.when(~F.lower(N.clean(lic)).isin("other", "none", "unknown", ""), lic)
    paths = cfg.get("tags") or []
    one_or_more = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.when(_full(x).isNotNull(), F.array(x)), F.array().cast("array<string>"))
    listed = lambda path: N.let(dig(path), one_or_more)
    tags = F.concat(F.array().cast("array<string>"), *(listed(p) for p in ([paths] if isinstance(paths, str) else paths)))
    links = []
    for url, fmt in cfg.get("resources") or []:
        kind = F.lit(fmt[1:]) if fmt and fmt.startswith("=") else dig(fmt) if fmt else F.lit(None).cast("string")
        links.append(F.when(_full(dig(url)).isNotNull(), F.struct(dig(url).alias("url"), F.lit("").alias("name"), kind.alias("format"))))
    resources = F.filter(F.array(*links), lambda x: x.isNotNull()) if links else F.array().cast("array<struct<url:string,name:string,format:string>>")
    formats = F.concat(F.transform(resources, lambda x: x["format"]), listed(str(cfg["formats"])) if cfg.get("formats") else F.array().cast("array<string>"))
    ident = at("id")
    landing = _url(str(cfg["landing"]), id=ident) if cfg.get("landing") else F.coalesce(at("landing_field"), F.lit(src.web))
    return finish(records, src, now_year, {
        "ident": ident, "name": at("name"), "title": dig(str(cfg.get("title", "title"))), "description": at("description"), "publisher": F.coalesce(at("publisher"), F.lit(src.name)), "license_raw": lic, "created": at("created"), "modified": at("modified"),
        "landing": landing, "tags": N.tags(F.slice(F.array_distinct(tags), 1, 25)), "formats": formats, "resources": resources,
    })


def read_records(spark: SparkSession, path: str, schema: str, at: str | None = None) -> DataFrame:
    """S-1, S-3, S-7, S-13: landed JSON pages; ``at`` is the path of their list of records (null: one record a line)."""
    if at is None:
        return spark.read.schema(schema).json(path)
    pages = spark.read.text(path, wholetext=True)
    listed = F.from_json(N.dig(F.col("value"), at), f"array<struct<{', '.join(_typed(schema))}>>")
    return pages.select(F.explode(listed).alias("r")).select("r.*")


def _typed(schema: str) -> list[str]:
    """``name type`` pairs of a schema as the fields of a struct."""
    from pyspark.sql.types import StructType

    return [f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields]


def read_csw(spark: SparkSession, path: str) -> DataFrame:
    """S-9: landed CSW answers as records of the CSW schema, prefixes ignored."""
    return spark.read.format("xml").option("rowTag", "Record").option("ignoreNamespace", True).schema(CSW).load(path)


def geography(catalogue: DataFrame) -> DataFrame:
    """N-18, D-2: a row for records with a box, a frequency or a reference date."""
    return catalogue.where("bbox is not null or update_frequency is not null or reference_date is not null").select(F.col("key").alias("dataset_key"), "bbox.*", "update_frequency", "reference_date")


def resources(catalogue: DataFrame) -> DataFrame:
    """N-22, D-3: the children of records, each address once."""
    return catalogue.select(F.col("key").alias("dataset_key"), F.explode("resources").alias("r")).select("dataset_key", "r.*")


def without_boilerplate(catalogue: DataFrame, least: int = 5) -> DataFrame:
    """W-13: a description that a source repeats ``least`` times is blanked."""
    often = catalogue.where("description is not null").groupBy("source_id", "description").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("source_id", "description", F.lit(True).alias("often"))
    return catalogue.join(often, ["source_id", "description"], "left").withColumn("description", F.when(F.col("often").isNull(), F.col("description"))).select(*catalogue.columns)
