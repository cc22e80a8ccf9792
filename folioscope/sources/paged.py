"""A paged collection as a Spark data source: ranges of pages are the partitions.

``fetch(resource, offset, limit)`` returns the text of one page ``{data[], totalCount, limit, offset}``, from
an HTTP client, a folder of pages, or whatever holds the collection; it travels to the tasks. The driver
asks for one page, which tells the total, and plans the ranges; every task fetches its own pages. A page
that can't be had after ``attempts`` tries comes out with a null payload, so that the check of the scan
reports it and the rest is kept. Rows are those of ``sources.pages.LANDED_SCHEMA``.

Options: ``resource``; ``page_size``; ``pages_per_task``; ``attempts``; ``from_offset``, where a scan that broke
off goes on. Filters on ``requested_offset`` choose pages before any is fetched. As a stream, offsets are
record numbers: a batch reads what the collection has gained since the last one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from folioscope.sources.pages import LANDED_SCHEMA

Fetch = Callable[[str, int, int], str]

#: Pages that a task holds at a time.
_PAGES_AT_ONCE = 8


@dataclass
class PageRange(InputPartition):
    """Pages that begin at ``first``, ``first + limit``, ... before ``end``."""

    first: int
    end: int


@dataclass
class _Scan:
    """What the options say, and how to get pages."""

    fetch: Fetch
    resource: str
    limit: int
    per_task: int
    attempts: int
    start: int

    def page(self, offset: int) -> str | None:
        for _ in range(self.attempts):
            try:
                return self.fetch(self.resource, offset, self.limit)
            except Exception:  # noqa: BLE001, whatever the client raises
                continue
        return None

    def total(self) -> int:
        page = self.page(self.start)
        try:
            total = json.loads(page)["totalCount"] if page is not None else None
        except (ValueError, TypeError, KeyError):
            total = None
        if not isinstance(total, int) or isinstance(total, bool):
            raise ValueError(f"{self.resource}: the page at {self.start} tells no total")
        return total

    def ranges(self, first: int, end: int) -> list[PageRange]:
        step = self.limit * self.per_task
        return [PageRange(at, min(at + step, end)) for at in range(first, end, step)]

    def rows(self, some: PageRange | None) -> Iterator[pa.RecordBatch]:
        # Spark reads a scan without partitions as one that is None.
        at = list(range(some.first, some.end, self.limit)) if some else []
        for k in range(0, len(at), _PAGES_AT_ONCE):
            offsets = at[k : k + _PAGES_AT_ONCE]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.resource] * len(offsets)),
                    pa.array(offsets, pa.int64()),
                    pa.array([self.limit] * len(offsets), pa.int64()),
                    pa.array([self.page(offset) for offset in offsets], pa.string()),
                ],
                names=["resource", "requested_offset", "requested_limit", "payload"],
            )


class _Reader(DataSourceReader):
    def __init__(self, scan: _Scan):
        self.scan = scan
        self.least, self.most, self.none = scan.start, None, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, IsNotNull) and name in ("resource", "requested_offset", "requested_limit"):
                continue
            if isinstance(f, EqualTo) and name == "resource":
                self.none |= f.value != self.scan.resource
            elif name == "requested_offset" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self._from(f.value)
                if isinstance(f, GreaterThan):
                    self._from(f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self._before(f.value + 1)
                if isinstance(f, LessThan):
                    self._before(f.value)
            else:
                yield f

    def _from(self, offset: int) -> None:
        """The first page that begins at ``offset`` or behind it."""
        steps = -(-(offset - self.scan.start) // self.scan.limit)
        self.least = max(self.least, self.scan.start + steps * self.scan.limit)

    def _before(self, offset: int) -> None:
        self.most = offset if self.most is None else min(self.most, offset)

    def partitions(self) -> Sequence[PageRange]:
        if self.none:
            return []
        # An empty collection has one page, which says so.
        end = max(self.scan.total(), self.scan.start + 1)
        return self.scan.ranges(self.least, end if self.most is None else min(end, self.most))

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        yield from self.scan.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, scan: _Scan):
        self.scan = scan

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": self.scan.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"offset": self.scan.total()}

    def partitions(self, start: dict, end: dict) -> Sequence[PageRange]:
        return self.scan.ranges(start["offset"], end["offset"])

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        yield from self.scan.rows(partition)


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Makes ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read pages through ``fetch``."""

    class PagedCollection(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LANDED_SCHEMA

        def _scan(self) -> _Scan:
            get = self.options.get
            resource = get("resource")
            if not resource:
                raise ValueError("option resource is missing")
            numbers = [int(get(k, d)) for k, d in (("page_size", "100"), ("pages_per_task", "50"), ("attempts", "3"), ("from_offset", "0"))]
            if min(numbers[:3]) < 1 or numbers[3] < 0:
                raise ValueError("page_size, pages_per_task and attempts are 1 or more, from_offset is 0 or more")
            return _Scan(fetch, resource, *numbers)

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(self._scan())

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(self._scan())

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCollection)


#: Record numbers whose pages lie in one file, so that a large collection isn't a file per page.
_FILE_SPAN = 5_000


def land_pages(pages: DataFrame, folder: str) -> None:
    """Writes landed pages so that each can be found by its resource and offset, in files of neighbouring pages."""
    placed = pages.select("resource", "requested_offset", "payload", F.expr(f"requested_offset div {_FILE_SPAN}").alias("span"))
    placed.repartition("resource", "span").write.partitionBy("resource", "span").parquet(folder)


class _Folder:
    """Pages of a folder; those of the file read last are held, as a task asks for neighbours."""

    def __init__(self, folder: str):
        self.folder = folder
        self._at, self._pages = None, {}

    def __getstate__(self) -> dict:
        # What the driver read doesn't travel to the tasks.
        return {"folder": self.folder, "_at": None, "_pages": {}}

    def __call__(self, resource: str, offset: int, limit: int) -> str:
        from pyarrow import fs, parquet

        at = (resource, offset // _FILE_SPAN)
        if at != self._at:
            store, root = fs.FileSystem.from_uri(self.folder)
            files = store.get_file_info(fs.FileSelector(f"{root}/resource={resource}/span={at[1]}"))
            found: dict[int, list[str]] = {}
            for file in files:
                if file.base_name.startswith("part-"):
                    with store.open_input_file(file.path) as content:
                        read = parquet.read_table(content, columns=["requested_offset", "payload"]).to_pydict()
                    for o, page in zip(read["requested_offset"], read["payload"]):
                        found.setdefault(o, []).append(page)
            self._at, self._pages = at, found
        (page,) = self._pages[offset]
        return page


def from_folder(folder: str) -> Fetch:
    """Pages that ``land_pages`` wrote; any file system that Arrow opens."""
    return _Folder(folder)
