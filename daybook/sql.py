"""The archive for SQL: its tables as views and the engine's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import harvest, html, sqltext
from daybook.operators.store import Store
from daybook.schemas import TABLES


@F.udtf(returnType="url string, raw string, alt string, kind string")
class PageReferences:
    """The images of a page, a row each: ``LATERAL page_references(html, base)``."""

    def eval(self, page: str, base: str):
        for i in html.extract(page, base)["images"]:
            yield i["url"], i["raw"], i["alt"], i["kind"]


@F.udtf(returnType="place int, url string")
class PageLinks:
    """The links of a page in their order: ``LATERAL page_links(html, base)``."""

    def eval(self, page: str, base: str):
        yield from enumerate(html.extract(page, base)["links"])


@F.udtf(returnType="owner string, start string, until string, days int")
class LongestGaps:
    """The longest time without a day, the first of several, of each group of rows (owner, day) that come in the order of days.

    ``SELECT * FROM longest_gaps(TABLE(..) PARTITION BY owner ORDER BY day)``. Holds two days at a time.
    """

    def __init__(self):
        self.owner, self.last, self.best = None, None, None

    def eval(self, row):
        day = row["day"]
        if day is None:
            return
        if self.last is not None and (self.best is None or (day - self.last).days > self.best[2]):
            self.best = str(self.last), str(day), (day - self.last).days
        self.owner, self.last = row["owner"], day

    def terminate(self):
        if self.best:
            yield self.owner, *self.best


def register(spark: SparkSession) -> list[str]:
    """Functions that SQL lacks: extraction, resolving, redaction, gaps, harvest, table functions and those of ``sqltext``. Returns their names."""
    made = {
        "extract_html": F.pandas_udf(html.extract_udf.__wrapped__, html.EXTRACTION),
        "resolve_url": F.pandas_udf(html.resolve_udf.__wrapped__, "string"),
        "redact_html": F.pandas_udf(html.redact_udf.__wrapped__, "html string, removed array<string>"),
        "missing_run": F.pandas_udf(html.missing_run_udf.__wrapped__, "int"),
        "harvest_page": F.pandas_udf(harvest.harvest_udf.__wrapped__, harvest.HARVEST),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    tables = {"page_references": PageReferences, "page_links": PageLinks, "longest_gaps": LongestGaps}
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return [*made, *tables, *sqltext.create(spark)]


def query(store: Store, statement: str, **args) -> DataFrame:
    """SQL over the store's current tables; ``:name`` in the statement takes its value from args."""
    for name in TABLES:
        store.read(name).createOrReplaceTempView(name)
    return store.spark.sql(statement, args=args)
