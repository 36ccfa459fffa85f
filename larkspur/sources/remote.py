"""Paged JSON as a Spark data source, and calls of a remote scorer by partition."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedJson(DataSource):
    """format("paged_json"): items of pages `first`..`last` of a `url` that holds {page}.

    Options: url, first (1), last, items (the key of a page's list; without it the page is the list).
    A page is a partition; one that can't be read fails its task, which Spark tries again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Page(n) for n in range(int(self.options.get("first", 1)), int(self.options["last"]) + 1)]

    def read(self, partition) -> Iterator[tuple]:
        with urllib.request.urlopen(self.options["url"].replace("{page}", str(partition.number)), timeout=30) as answer:
            page = json.load(answer)
        for item in page.get(self.options["items"], []) if "items" in self.options else page:
            yield partition.number, json.dumps(item, ensure_ascii=False)


def scored_remotely(df: DataFrame, client: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Each partition's batches through one client of its own; a batch that fails gives rows with null results and its error.

    client() returns the call: a frame of rows to a frame of results with the columns of schema.
    """

    def run(batches):
        call = client()
        names = [part.split()[0] for part in schema.split(",")]
        for batch in batches:
            try:
                found = call(batch).assign(error=None)
            except (OSError, ValueError) as problem:
                found = pd.DataFrame({n: [None] * len(batch) for n in names}).assign(error=type(problem).__name__)
            yield pd.concat([batch.reset_index(drop=True), found.reset_index(drop=True)], axis=1)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{own}, {schema}, error string")
