"""The journal server as a source of Spark, so that cursors, checkpoints, replays and retries are Spark's.

``register(spark, entries, export)`` gives the formats ``journal_entries`` and ``journal_comments`` from two functions
that ask the server; they travel to Python workers. Entries are read backwards through time, page by page, which tasks
can't share; comments are read by ranges of ids, which they can. What a killed run had read and not committed is read
again, so sinks should settle rows by their keys, as the store does.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from daybook.schemas import ENTRIES
from daybook.session import ship
from daybook.sources import comments
from daybook.sources.paging import moment_before

#: What a server tells of an entry: the table's columns but the time of the fetch, and the tags as one text.
ENTRY = StructType([f for f in ENTRIES.fields if f.name != "fetched_at"]).add("taglist", "string")
#: A page of the comment export, which speaks for the ids from start up to, and without, until.
PAGE = "start bigint, until bigint, page string"

#: (newest time or None, number of rows) -> entries of that time and before, newest first.
Entries = Callable[[str | None, int], list[dict]]
#: (comment_meta or comment_body, first id) -> a page of the export.
Export = Callable[[str, int], str]


def older(fetch: Entries, offset: dict, size: int) -> tuple[list[dict], dict]:
    """The page behind an offset and the next offset; no rows and the same offset where nothing is older.

    A page that brings entries of its first moment alone is asked for again, twice as large, until it reaches an older
    one. Where the server gives fewer than asked for then, the walk goes on before that moment, which ``partial`` of the
    offset names as one that may lack entries; the journal's oldest moment too where it fills a page, for nothing shows that it is whole.
    """
    before, many = offset["before"], size
    page = fetch(before, many)
    if not page:
        return [], offset
    while (oldest := min(p["eventtime"] for p in page)) == before:
        if len(page) < many:
            lost = {"partial": [*offset["partial"], oldest]} if many > size else {}
            return page, offset | {"before": moment_before(oldest)} | lost
        many *= 2
        page = fetch(before, many) or page
    return page, offset | {"before": oldest}


def _entry(row: dict) -> tuple:
    return tuple(row.get(name) for name in ENTRY.names)


class _Backwards(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Entries, size: int):
        self.fetch, self.size = fetch, size

    def initialOffset(self) -> dict:
        return {"before": None, "partial": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page, end = older(self.fetch, start, self.size)
        return iter([_entry(p) for p in page]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages that lead from start to end or beyond, should the server's pages have moved."""
        while start["before"] is None or start["before"] > end["before"]:
            page, start = older(self.fetch, start, self.size)
            if not page:
                return
            yield from map(_entry, page)


class _AllEntries(DataSourceReader):
    def __init__(self, fetch: Entries, size: int):
        self.walk = _Backwards(fetch, size)

    def read(self, partition) -> Iterator[tuple]:
        page, at = older(self.walk.fetch, self.walk.initialOffset(), self.walk.size)
        while page:
            yield from map(_entry, page)
            page, at = older(self.walk.fetch, at, self.walk.size)


class _Range(InputPartition):
    def __init__(self, start: int, until: int):
        self.start, self.until = start, until


class _ByIds:
    """Pages of comments; what is read at once is cut into ``parallel`` ranges of ids."""

    def __init__(self, export: Export, first: int, parallel: int):
        self.export, self.first, self.parallel = export, first, parallel

    def behind(self) -> int:
        """The id behind the highest that the index names, or where to begin if that is higher."""
        top = ET.fromstring(self.export("comment_meta", self.first)).findtext("maxid")
        return max(self.first, int(top or 0) + 1)

    def ranges(self, start: int, until: int) -> list[_Range]:
        width = max(1, -(-(until - start) // self.parallel))
        return [_Range(i, min(i + width, until)) for i in range(start, until, width)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        at = partition.start
        while at < partition.until:
            page = self.export("comment_body", at)
            top = max((int(c.get("id")) for c in ET.fromstring(page).iter("comment")), default=0)
            if top < at:
                return
            until = min(top + 1, partition.until)
            yield at, until, page
            at = until


class _AllComments(_ByIds, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return self.ranges(self.first, self.behind()) or [_Range(0, 0)]


class _NewComments(_ByIds, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"id": self.first}

    def latestOffset(self) -> dict:
        return {"id": self.behind()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.ranges(start["id"], end["id"])


def register(spark: SparkSession, entries: Entries, export: Export) -> None:
    """The formats ``journal_entries`` (option size: rows of a page, 50) and ``journal_comments`` (first: where to begin, 0; parallel: ranges read at once, 1).

    Both can be read as tables and as streams. A stream of entries ends at the oldest; what is written later needs a new checkpoint.
    A stream of comments goes on with the ids that come.
    """
    ship(spark)

    class JournalEntries(DataSource):
        @classmethod
        def name(cls) -> str:
            return "journal_entries"

        def schema(self) -> StructType:
            return ENTRY

        def _size(self) -> int:
            return int(self.options.get("size", 50))

        def reader(self, schema: StructType) -> DataSourceReader:
            return _AllEntries(entries, self._size())

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return _Backwards(entries, self._size())

    class JournalComments(DataSource):
        @classmethod
        def name(cls) -> str:
            return "journal_comments"

        def schema(self) -> str:
            return PAGE

        def _how(self) -> tuple[Export, int, int]:
            return export, int(self.options.get("first", 0)), int(self.options.get("parallel", 1))

        def reader(self, schema: StructType) -> DataSourceReader:
            return _AllComments(*self._how())

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _NewComments(*self._how())

    spark.dataSource.register(JournalEntries)
    spark.dataSource.register(JournalComments)


def comments_of(pages: DataFrame) -> DataFrame:
    """Pages of the export -> comments, each from the page that speaks for its id. A page that is no XML raises."""
    kind = f"comments struct<comment array<struct<{comments.BODY}>>>"
    found = F.from_xml("page", kind, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"})["comments"]["comment"]
    rows = pages.select("start", "until", F.inline(found))
    return comments.bodies_of(rows.where("_id >= start and _id < until").drop("start", "until"))
