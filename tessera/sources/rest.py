"""Paged collection as an extension point: S07 to S11 with the caller's own ``fetch``.

Nothing here opens a connection. ``fetch(query, page)`` does, and returns a status, a
wait in seconds that the server asked for (or None), and the page's records as JSON
texts. Queries are rows of a table, so they are spread over executors; a page that was
landed before is not fetched again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetch = Callable[[str, int], tuple[int, float | None, list[str]]]

# Answers after which a request is made again.
RETRY_STATUS = (429, 500, 502, 503, 504)


def with_retries(fetch: Fetch, query: str, page: int, attempts: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """The page's records; waits double with each failure unless the server names a wait. Raises after the last attempt."""
    for attempt in range(attempts):
        status, wait, records = fetch(query, page)
        if status == 200:
            return records
        if status not in RETRY_STATUS:
            raise RuntimeError(f"{query}, page {page}: answer {status}")
        if attempt + 1 < attempts:
            sleep(wait if wait is not None else base * 2**attempt)
    raise RuntimeError(f"{query}, page {page}: no answer after {attempts} attempts")


def collect_pages(queries: DataFrame, fetch: Fetch, page_size: int, attempts: int = 5, base: float = 1.0) -> DataFrame:
    """``query, page, ord, record`` for all pages of the queries in column ``query``: until a page isn't full."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.column(0).to_pylist():
                page = 0
                while q is not None:
                    records = with_retries(fetch, q, page, attempts, base)
                    n = len(records)
                    yield pa.RecordBatch.from_arrays([pa.array([q] * n), pa.array([page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(records, pa.string())], names=["query", "page", "ord", "record"])
                    if n < page_size:
                        break
                    page += 1

    return queries.select(F.col("query").cast("string").alias("query")).mapInArrow(run, "query string, page int, ord int, record string")


def missing_queries(queries: DataFrame, landed: DataFrame) -> DataFrame:
    """Queries that nothing has been landed for."""
    return queries.join(landed.select("query").distinct(), "query", "left_anti")


def id_batches(ids: DataFrame, key: str, size: int = 50, separator: str = "|") -> DataFrame:
    """``query``: ids joined into requests of so many at most."""
    from tessera.operators.match import number_rows

    numbered = number_rows(ids.select(key).distinct(), [key], "__n").withColumn("__b", F.floor((F.col("__n") - 1) / size))
    return numbered.groupBy("__b").agg(F.array_join(F.array_sort(F.collect_list(key)), separator).alias("query")).select("query")
