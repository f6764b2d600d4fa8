"""Catalogues that answer in pages, as a Spark data source (S-1, S-7, S-9, S-11, S-13, S-29).

    spark.dataSource.register(PagedAnswers)
    spark.read.format("paged_answers").option("sources", json.dumps([{"id": "a", "api": "https://a.example/api/3/action", "protocol": "ckan"}])).load()

Batch: the first page of each source states how many records there are and, by
what it holds, how many a page brings; the pages follow from these two numbers
and are dealt out to tasks, a few to each.  A source that states no count is
followed page by page by one task until a page is empty.

Stream: the offset is the number of records already taken from each source.  A
micro-batch takes what has been added since, so a restart from the checkpoint
repeats nothing.

Every record is a row of its text, with its place in the source.  A page that
still fails after ``retries`` tries is one row with the error and no record, and
leaves all others; ``harvest_runs`` counts them, ``failed_pages`` gives the
option to read them again.  Where a protocol says so, and where no count is
stated, a page beyond the first that is not there (404) is the end of the data.

Addresses are http(s), or whatever file system pyarrow opens: landed pages are
read by the same plan, a folder standing for the files in it.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, start long, total long, place long, record string, error string"
_FIELDS = (("source", pa.string()), ("start", pa.int64()), ("total", pa.int64()), ("place", pa.int64()), ("record", pa.string()), ("error", pa.string()))
#: A source of which so many pages failed is given up.
MOST_ERRORS = 3
#: Pages that a task lands, about.
PAGES_WRITTEN = 256
#: Pages of a task at least, and tasks of a source at most, about: a large source has longer tasks, not more of them.
LEAST_PAGES, MOST_TASKS = 8, 256


@dataclass(frozen=True)
class Protocol:
    """How a page is asked for, where it states the count and where its records are (dotted paths; several may be tried)."""

    address: str
    rows: int
    count: tuple[str, ...] = ()
    records: tuple[str, ...] = ()
    first: int = 0
    xml: str = ""
    ends: bool = False  # a page beyond the first that is not there is the end of the data


# Addresses, page sizes and paths of the protocols. Fixed values.
PROTOCOLS = {
    "ckan": Protocol("{api}/package_search?rows={rows}&start={start}", 500, ("result.count",), ("result.results", "result.result")),
    "ods": Protocol("{api}/catalog/datasets?limit={rows}&offset={start}", 100, ("total_count",), ("results",)),
    "geonode": Protocol("{api}/datasets?page_size={rows}&page={page}", 200, ("total",), ("resources",), ends=True),
    "csw": Protocol("{api}?service=CSW&version=2.0.2&request=GetRecords&elementSetName=full&resultType=results&maxRecords={rows}&startPosition={start}", 100, first=1, xml="Record"),
    "arcgis": Protocol("{api}/query?where=1%3D1&outFields=*&f=json&resultRecordCount={rows}&resultOffset={start}", 1000, (), ("features",)),
}


@dataclass(frozen=True)
class Source:
    id: str
    api: str
    protocol: Protocol
    only: tuple[int, ...] | None = None

    @staticmethod
    def of(said: Mapping[str, object]) -> Source:
        """A source from its description: ``protocol`` names one of ``PROTOCOLS``; address, rows, count, records, first may be stated instead."""
        own = {k: tuple([v] if isinstance(v, str) else v) if k in ("count", "records") else v for k, v in said.items() if k in ("address", "rows", "count", "records", "first", "xml", "ends")}
        base = PROTOCOLS.get(str(said.get("protocol")), Protocol("{api}?start={start}", 100))
        return Source(str(said["id"]), str(said["api"]).rstrip("/"), replace(base, **own), None if said.get("only") is None else tuple(said["only"]))

    def address(self, start: int) -> str:
        p = self.protocol
        return p.address.format(api=self.api, rows=p.rows, start=start + p.first, page=start // p.rows + 1)


@dataclass
class Task(InputPartition):
    """Pages of one source by their starts; ``follow``: go on after the last until a page is empty; records before ``begin`` and from ``end`` on are left out."""

    source: Source
    starts: tuple[int, ...]
    follow: bool = False
    begin: int = 0
    end: int | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


class NoSuchPage(Exception):
    pass


def _open(address: str, timeout: float) -> bytes:
    if re.match("https?://", address):
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": "ledgerlark"}), timeout=timeout) as answer:  # noqa: S310
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise NoSuchPage(str(e)) from e
            raise
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise NoSuchPage(f"{address} is not there")
    files = [path] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    out = []
    for f in files:
        with store.open_input_stream(f) as s:
            out.append(s.read())
    return b"".join(out)


def _dig(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def read_page(body: bytes, p: Protocol) -> tuple[int | None, list[str]]:
    """The stated count, if any, and the texts of the records of one answer."""
    if p.xml:
        from xml.etree import ElementTree

        root = ElementTree.fromstring(body)
        bare = lambda e: e.tag.rpartition("}")[2]
        stated = next((e.get("numberOfRecordsMatched") for e in root.iter() if e.get("numberOfRecordsMatched")), None)
        return int(stated) if stated else None, [ElementTree.tostring(e, encoding="unicode") for e in root.iter() if bare(e) == p.xml]
    answer = json.loads(body)
    listed = answer if isinstance(answer, list) else next((x for x in (_dig(answer, path) for path in p.records) if isinstance(x, list) and x), [])
    stated = next((x for x in (_dig(answer, path) for path in p.count) if isinstance(x, int) and not isinstance(x, bool)), None)
    return stated, [json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in listed]


class _Asker:
    def __init__(self, options: Mapping[str, str]) -> None:
        self.retries, self.timeout, self.pause = int(options.get("retries", 3)), float(options.get("timeout", 60)), float(options.get("pause", 0.2))

    def page(self, source: Source, start: int) -> tuple[int | None, list[str]]:
        for n in range(max(1, self.retries)):
            try:
                return read_page(_open(source.address(start), self.timeout), source.protocol)
            except NoSuchPage:
                raise
            except Exception:  # whatever a server or its answer does is an error of this page
                if n + 1 >= self.retries:
                    raise
                time.sleep(self.pause * 2**n)
        raise AssertionError

    def first(self, source: Source) -> tuple[int | None, int, str | None]:
        """The stated count, the records of the first page, and what went wrong."""
        try:
            total, records = self.page(source, 0)
            return total, len(records), None
        except Exception as e:
            return None, 0, f"{type(e).__name__}: {e}"


def _sources(options: Mapping[str, str]) -> list[Source]:
    return [Source.of(s) for s in json.loads(options["sources"])]


def _rows(task: Task, options: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    ask, source = _Asker(options), task.source
    starts, errors, at = list(task.starts), 0, 0
    while at < len(starts):
        start, at = starts[at], at + 1
        try:
            total, records = ask.page(source, start)
        except NoSuchPage as e:
            if start and source.only is None and (source.protocol.ends or task.follow):
                continue
            yield _batch([(source.id, start, None, None, None, f"{type(e).__name__}: {e}")])
            continue
        except Exception as e:
            yield _batch([(source.id, start, None, None, None, f"{type(e).__name__}: {e}")])
            errors += 1
            if task.follow and errors < MOST_ERRORS:
                starts.append(start + source.protocol.rows)
            continue
        kept = [(source.id, start, total, start + i, r, None) for i, r in enumerate(records) if start + i >= task.begin and (task.end is None or start + i < task.end)]
        yield _batch(kept or [(source.id, start, total, None, None, None)])
        if task.follow and records:
            starts.append(start + len(records))
        if re.match("http", source.api):
            time.sleep(ask.pause)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])


def _tasks(source: Source, begin: int, end: int, each: int, cut: bool) -> list[Task]:
    """The pages that hold the records from ``begin`` to ``end``; pages start at multiples of their size."""
    rows = source.protocol.rows
    starts = list(range(begin // rows * rows, end, rows)) if end > begin else []
    return [Task(source, own, begin=begin, end=end if cut else None) for own in _dealt(starts, each)]


def _dealt(starts: Sequence[int], each: int) -> list[tuple[int, ...]]:
    """Pages of one task each; ``each`` is 0 where their number is not stated."""
    each = each or max(LEAST_PAGES, -(-len(starts) // MOST_TASKS))
    return [tuple(starts[i : i + each]) for i in range(0, len(starts), each)]


class _Batch(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        ask, each, sources = _Asker(self.options), int(self.options.get("pages_of_task", 0)), _sources(self.options)
        limit = int(self.options.get("limit", 0))
        with ThreadPoolExecutor(16) as pool:
            seen = list(pool.map(ask.first, sources))
        out: list[Task] = []
        for source, (total, step, error) in zip(sources, seen):
            if source.only is not None:
                out += [Task(source, own) for own in _dealt(source.only, each)]
            elif error or not step or (total is not None and total <= step):
                out.append(Task(source, (0,), end=limit or None))
            elif total is None:
                out.append(Task(source, (0,), follow=True))
            else:
                # A server may give shorter pages than it is asked for.
                source = replace(source, protocol=replace(source.protocol, rows=min(step, source.protocol.rows)))
                out += _tasks(source, 0, min(total, limit) if limit else total, each, bool(limit))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition, self.options)  # type: ignore[arg-type]


class _Stream(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {s.id: 0 for s in _sources(self.options)}

    def latestOffset(self) -> dict:
        """The stated counts; a source that does not answer fails the query, which then goes on from its checkpoint."""
        ask = _Asker(self.options)
        out = {}
        for s in _sources(self.options):
            total, _, error = ask.first(s)
            if error or total is None:
                raise RuntimeError(f"{s.id}: {error or 'no count is stated'}")
            out[s.id] = total
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        each = int(self.options.get("pages_of_task", 0))
        return [t for s in _sources(self.options) for t in _tasks(s, start.get(s.id, 0), end.get(s.id, 0), each, True)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition, self.options)  # type: ignore[arg-type]


class PagedAnswers(DataSource):
    """Options: sources (a JSON list), retries, timeout, pause (seconds), pages_of_task, limit (records of each source; batch)."""

    @classmethod
    def name(cls) -> str:
        return "paged_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def _with(reader, sources: Sequence[Mapping[str, object]], options: Mapping[str, object]):  # noqa: ANN001, ANN202
    return reader.format("paged_answers").option("sources", json.dumps([dict(s) for s in sources])).options(**{k: str(v) for k, v in options.items()})


def read_paged(spark: SparkSession, sources: Sequence[Mapping[str, object]], **options: object) -> DataFrame:
    """All pages of the sources (each: id, api, protocol, or what a protocol states)."""
    spark.dataSource.register(PagedAnswers)
    return _with(spark.read, sources, options).load()


def stream_paged(spark: SparkSession, sources: Sequence[Mapping[str, object]], **options: object) -> DataFrame:
    """What is added to the sources from the checkpoint on."""
    spark.dataSource.register(PagedAnswers)
    return _with(spark.readStream, sources, options).load()


def records_as(rows: DataFrame, source: str | None, schema: str) -> DataFrame:
    """The records (of one source) in the columns of a schema."""
    rows = rows.where("record is not null")
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows.select(F.from_json("record", schema).alias("r")).select("r.*")


def harvest_runs(rows: DataFrame) -> DataFrame:
    """source, total (as stated), stored, errors, abandoned of a read."""
    n = rows.groupBy("source").agg(F.max("total").alias("total"), F.count("record").alias("stored"), F.count("error").alias("errors"))
    return n.withColumn("abandoned", F.col("errors") >= MOST_ERRORS)


def failed_pages(rows: DataFrame, sources: Sequence[Mapping[str, object]]) -> list[dict]:
    """The sources whose pages failed, with ``only`` these pages: what ``read_paged`` takes to read them again."""
    bad = rows.where("error is not null").groupBy("source").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    by = {r["source"]: r["starts"] for r in bad.collect()}  # a page's number for each failure
    return [{**s, "only": by[s["id"]]} for s in sources if s["id"] in by]


def land_pages(records: DataFrame, place: str, record: Column, path: str, rows: int, wrap: Callable[[Column, Column], Column], lost: Column | None = None) -> None:
    """Writes records as pages of ``rows``, a folder ``start=<n>`` for each; ``wrap`` makes an answer of the count and the joined records.

    Pages of which ``lost`` (of their ``start``) holds are counted and not written.
    """
    total = records.count()
    spark = records.sparkSession
    tasks = landing_tasks(total, rows, spark.sparkContext.defaultParallelism)
    # Stated, as what a page costs does not follow from its bytes.
    dealt = records.select((F.floor(F.col(place) / rows) * rows).alias("start"), F.col(place).alias("p"), record.alias("r")).repartition(tasks, "start")
    page = dealt.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("p", "r"))).alias("l"))
    listed = F.array_join(F.transform("l", lambda x: x["r"]), ",")
    page = page if lost is None else page.where(~lost)
    page.select("start", wrap(F.lit(total), listed).alias("value")).mapInArrow(partial(_put, path=path), "pages long").agg(F.sum("pages")).collect()


def landing_tasks(total: int, rows: int, cores: int) -> int:
    """Tasks that land so many records: one for each core, and more of about ``PAGES_WRITTEN`` pages."""
    pages = -(-total // rows)
    return max(1, min(pages, max(cores, pages // PAGES_WRITTEN)))


def _put(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Puts pages in place: each is written aside and renamed, so that it is there whole, and a task that runs again replaces it."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    for batch in batches:
        for start, text in zip(*(c.to_pylist() for c in batch.columns)):
            folder = f"{base}/start={start}"
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as s:
                s.write(text.encode() + b"\n")
            try:
                store.move(draft, f"{folder}/page.json")
            except OSError:  # a store that never replaces a file, which has the page from another try
                if store.get_file_info(f"{folder}/page.json").type == fs.FileType.NotFound:
                    raise
                store.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["pages"])


#: The address of a landed page.
LANDED = "{api}/start={start}"
