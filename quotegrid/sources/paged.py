"""A data source for listings that come in pages: ``format("paged_json")``, to
read once or as a stream.

Options: ``path`` (a folder whose ``page-<offset>.json`` files stand for the
answers to offset and limit), ``limit`` (rows a page), ``key`` (what names a
row, ``id`` by default), ``total`` (rows in all, if known), ``pages`` (a task
reads so many; by default as many as make 256 tasks).

Where no total is given, the last page is found by doubling and then halving: a
page is beyond the end if it is missing, empty, or ends as the page before it
does (some listings say their last rows again). That asks for a few pages, not
for all; the pages themselves are read by the tasks. A listing that shifts while
it is read says rows again on the next page: a task leaves out what it has read
before, and what the page before its first one has. ``listing`` does so for all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

c = F.col


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """Any file system that pyarrow knows, or a plain path."""
    return fs.FileSystem.from_uri(path.removeprefix("file:") if path.startswith("file:/") else path)


class Rows(InputPartition):
    """The rows from ``start`` to before ``stop``."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class Listing:
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", "100"))
        self.key, self.total, self.pages = options.get("key", "id"), options.get("total"), int(options.get("pages", "0"))

    def fetch(self, page: int) -> list[dict]:
        store, folder = _place(self.path)
        place = f"{folder}/page-{page * self.limit}.json"
        if store.get_file_info(place).type != fs.FileType.File:
            return []
        with store.open_input_file(place) as f:
            return json.loads(f.read())

    def _live(self, page: int) -> bool:
        rows = self.fetch(page)
        if not rows or page == 0:
            return bool(rows)
        before = self.fetch(page - 1)
        return bool(before) and before[-1].get(self.key) != rows[-1].get(self.key)

    def rows(self, least: int = 0) -> int:
        """How many rows there are, if it is known that there are at least so many."""
        low = max(0, least - 1) // self.limit
        if not self._live(low):
            return least
        step = 1
        while self._live(low + step):
            low += step
            step *= 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._live(middle) else (low, middle)
        return low * self.limit + len(self.fetch(low))

    def parts(self, start: int, stop: int) -> list[Rows]:
        size = self.limit * (self.pages or max(1, -(-(stop - start) // (256 * self.limit))))
        return [Rows(max(start, i), min(stop, i + size)) for i in range(start - start % size, stop, size)]

    def read(self, part: Rows) -> Iterator[tuple]:
        first = part.start // self.limit
        seen = {str(r.get(self.key)) for r in self.fetch(first - 1)} if first else set()
        for page in range(first, -(-part.stop // self.limit)):
            for pos, row in enumerate(self.fetch(page)[: self.limit], page * self.limit):
                key = str(row.get(self.key))
                if part.start <= pos < part.stop and key not in seen:
                    seen.add(key)
                    yield key, pos, json.dumps(row)


class PagedReader(Listing, DataSourceReader):
    def partitions(self) -> list[Rows]:
        return self.parts(0, self.rows() if self.total is None else int(self.total)) or [Rows(0, 0)]


class PagedStream(Listing, DataSourceStreamReader):
    """Rows by their place: a later batch has those that were added since."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.known = 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        self.known = self.rows(self.known)
        return {"rows": self.known}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return self.parts(start["rows"], end["rows"])

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["rows"])


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "key string, pos int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def listing(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows (key, pos, body) of a listing, each key once, where it stands first."""
    spark.dataSource.register(PagedJson)
    rows = spark.read.format("paged_json").options(path=path, **options).load()
    return rows.groupBy("key").agg(F.min_by(F.struct("pos", "body"), "pos").alias("x")).select("key", "x.pos", "x.body")


def _write(path: str, limit: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _place(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for page, body in zip(batch.column("page").to_pylist(), batch.column("body").to_pylist()):
                with store.open_output_stream(f"{folder}/page-{page * limit}.json") as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_arrays([batch.column("page")], ["page"])

    return rows


def write_pages(rows: DataFrame, path: str, limit: int, again: bool = True) -> int:
    """Rows (pos from 0, and more) as the pages of a listing, each written by the
    task that has it. again: whether the page after the last says the last row again. Returns the number of pages."""
    body = F.to_json(F.struct(*[x for x in rows.columns if x != "pos"]))
    members = rows.select(F.floor(c("pos") / limit).cast("long").alias("page"), F.struct("pos", body.alias("body")).alias("x"))
    pages = members.groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    text = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda r: r["body"]), ","), F.lit("]"))
    out = pages.select("page", text(c("x")).alias("body"))
    if again:
        last = members.agg((F.max("page") + 1).alias("page"), F.max("x").alias("x")).where("page is not null")
        out = out.unionByName(last.select("page", F.concat(F.lit("["), c("x.body"), F.lit("]")).alias("body")))
    return out.mapInArrow(_write(path, limit), "page long").count()
