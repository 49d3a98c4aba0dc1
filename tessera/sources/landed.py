"""Answers of a paged service, landed as files, as a source for batches and streams.

A landing folder has a folder for each query and in it a file for each page: ``0000000007.json`` holds the page's
records, a list of JSON texts, and ``0000000007.failed`` the status of a request that got none. A page that was landed
after it had failed counts as landed. Files are written under another name first and then moved, so that a task that is
run twice, or lost, leaves whole pages only.

Streams read each query's pages in order. An offset is the next page of each query, so a run stops before the first
page that isn't there or failed and the next run goes on at it: each page is read once. The driver keeps one number
for each query and lists one query's file names at a time; contents are read by tasks, ``pagesPerTask`` pages each, so
that a query with most of the pages is read by many tasks.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.rest import Fetch, with_retries

SCHEMA = "query string, page int, ord int, record string"


class Landing:
    """Names and contents of a landing folder; any file system that Arrow knows by URI."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def _folder(self, query: str) -> str:
        return posixpath.join(self.root, "q=" + quote(query, safe=""))

    def queries(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(unquote(f.base_name[2:]) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("q="))

    def pages(self, query: str, ending: str = "json") -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(self._folder(query), allow_not_found=True))
        names = (f.base_name.partition(".") for f in found)
        return sorted(int(name) for name, _, end in names if end == ending and name.isdigit())

    def next_page(self, query: str, known: int = 0) -> int:
        """The first page that hasn't been landed, ``known`` or a later one."""
        there = set(self.pages(query))
        while known in there:
            known += 1
        return known

    def read(self, query: str, page: int) -> list[str]:
        with self.files.open_input_stream(posixpath.join(self._folder(query), f"{page:010d}.json")) as f:
            return json.loads(f.read())

    def write(self, query: str, page: int, content: object, ending: str = "json") -> None:
        folder = self._folder(query)
        self.files.create_dir(folder, recursive=True)
        at = posixpath.join(folder, f"{page:010d}.{ending}")
        part = f"{at}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(content).encode())
        self.files.move(part, at)


# ------------------------------------------------------------------ landing
def land_responses(responses: DataFrame, path: str) -> int:
    """Land answers given as ``query, page, status, records`` (an array of texts); the number that had status 200.

    Rows with a null query or page are left out; null records are none. Of a page's repeated answers the last written stays.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landing = Landing(path)
        for b in batches:
            good = 0
            for r in b.to_pylist():
                if r["status"] == 200:
                    landing.write(r["query"], r["page"], r["records"] or [])
                    good += 1
                else:
                    landing.write(r["query"], r["page"], r["status"], "failed")
            yield pa.RecordBatch.from_arrays([pa.array([good], pa.int64())], names=["n"])

    rows = responses.where("query is not null and page is not null").select(F.col("query").cast("string"), F.col("page").cast("int"), "status", "records")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def land_pages(queries: DataFrame, fetch: Fetch, path: str, page_size: int, attempts: int = 5, base: float = 1.0) -> DataFrame:
    """Ask for the pages of each query that aren't landed yet, until one isn't full; ``query, landed, failed`` (the page, or null).

    Goes on at the first page that lacks; a page without an answer is marked as failed and asked for again by the next
    run. Queries that are null are left out, repeated ones asked once. The frame is lazy and each evaluation asks again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landing = Landing(path)
        for b in batches:
            for q in b.column(0).to_pylist():
                first = page = landing.next_page(q)
                failed = None
                while page == 0 or len(landing.read(q, page - 1)) >= page_size:
                    try:
                        records = with_retries(fetch, q, page, attempts, base)
                    except RuntimeError as error:
                        landing.write(q, page, str(error), "failed")
                        failed = page
                        break
                    landing.write(q, page, records)
                    page += 1
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([page - first], pa.int32()), pa.array([failed], pa.int32())], names=["query", "landed", "failed"])

    asked = queries.select(F.col("query").cast("string").alias("query")).where("query is not null").distinct()
    return asked.mapInArrow(run, "query string, landed int, failed int")


# ------------------------------------------------------------------ reading
@dataclass
class Pages(InputPartition):
    """Pages that one task reads."""

    pages: list[tuple[str, int]]

    def __post_init__(self) -> None:
        super().__init__(self.pages)


class _Reader:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("pagesPerTask", 64))

    def split(self, pages: Iterable[tuple[str, int]]) -> list[Pages]:
        return [Pages(list(some)) for some in batched(pages, self.size)]

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        landing = Landing(self.path)
        for query, page in partition.pages if partition else ():  # Spark reads one partition, None, where there are none
            records = landing.read(query, page)
            n = len(records)
            yield pa.RecordBatch.from_arrays([pa.array([query] * n, pa.string()), pa.array([page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(records, pa.string())], names=["query", "page", "ord", "record"])


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Pages]:
        landing = Landing(self.path)
        return self.split((q, page) for q in landing.queries() for page in landing.pages(q))


class _StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        landing = Landing(self.path)
        self.known = {q: landing.next_page(q, self.known.get(q, 0)) for q in landing.queries()}
        return {q: n for q, n in self.known.items() if n}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.split((q, page) for q, n in sorted(end.items()) for page in range(start.get(q, 0), n))


class LandedPages(DataSource):
    """Format ``landed_pages``: records of landed pages. Options: path, pagesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_landed(spark: SparkSession, path: str, pages_per_task: int = 64) -> DataFrame:
    """``query, page, ord, record`` of all pages landed so far; none for a folder that isn't there."""
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").option("path", path).option("pagesPerTask", pages_per_task).load()


def failed_pages(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """``query, page`` of the queries' pages that failed and haven't been landed since."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landing = Landing(path)
        for b in batches:
            for q in b.column(0).to_pylist():
                lacking = sorted(set(landing.pages(q, "failed")) - set(landing.pages(q)))
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(lacking), pa.string()), pa.array(lacking, pa.int32())], names=["query", "page"])

    asked = queries.select(F.col("query").cast("string").alias("query")).where("query is not null").distinct()
    return asked.mapInArrow(run, "query string, page int")


def append_landed(spark: SparkSession, path: str, sink: str, checkpoint: str, run: int | None = None, pages_per_task: int = 64) -> StreamingQuery:
    """Append to ``sink`` the records of pages that no earlier run has read, in each query's order, and stop.

    Where pages stand is in the checkpoint folder; a batch that is repeated after a failure replaces its own files. With
    ``run`` a column of that name says which run a record came by.
    """
    spark.dataSource.register(LandedPages)
    rows = spark.readStream.format("landed_pages").option("path", path).option("pagesPerTask", pages_per_task).load()
    if run is not None:
        rows = rows.withColumn("run", F.lit(run))
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
