"""A Python data source of cursor-paged JSON addresses. The function that fetches is a parameter: a client in production, a
dictionary in tests; it travels to the tasks, and each start address is a partition of its own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, page int, raw string, error string"


class _Start(InputPartition):
    def __init__(self, url: str):
        self.url = url


def page_source(fetch: Callable[[str, str | None], str], name: str = "record_pages") -> type[DataSource]:
    """A data source whose rows are the pages of each address of the option `urls` (apart by spaces).

    fetch(url, cursor) returns the text of a page. Pages follow each other by next_cursor or metadata.nextCursor; anything but
    a text ends them. A fetch that fails, or a page that is no JSON object, ends its address with a row of `error`."""

    class Reader(DataSourceReader):
        def __init__(self, urls: list[str]):
            self.urls = urls

        def partitions(self) -> list[InputPartition]:
            return [_Start(u) for u in self.urls]

        def read(self, partition: _Start) -> Iterator[tuple]:
            cursor, page = None, 1
            while True:
                try:
                    raw = fetch(partition.url, cursor)
                    body = json.loads(raw)
                except Exception as e:  # noqa: BLE001  whatever the client raises ends the address, not the job
                    yield partition.url, page, None, f"{type(e).__name__}: {e}"[:500]
                    return
                if not isinstance(body, dict):
                    yield partition.url, page, raw, "not an object"
                    return
                yield partition.url, page, raw, None
                meta = body.get("metadata")
                cursor = body.get("next_cursor") or (meta.get("nextCursor") if isinstance(meta, dict) else None)
                if not isinstance(cursor, str):
                    return
                page += 1

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["urls"].split())

    return Pages


def read_pages(spark: SparkSession, urls: list[str], fetch: Callable[[str, str | None], str], name: str = "record_pages"):
    """(url, page, raw, error) of all pages, for registry.records."""
    spark.dataSource.register(page_source(fetch, name))
    return spark.read.format(name).option("urls", " ".join(urls)).load()
