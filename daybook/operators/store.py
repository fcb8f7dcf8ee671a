"""The archive's store: tables in buckets of their keys, changed by transactions over one commit log.

Parquet has no MERGE. A batch is merged with the buckets that its keys fall into and with no other:
those are written anew, beside the old ones, and an entry of the log makes the new ones current, for
all tables of a transaction at once. Nothing is replaced or deleted on the way: at any moment, and
after a crash at any point, the last entry leads to whole tables.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.window import Window

from daybook.operators.log import CommitLog, applied
from daybook.schemas import TABLES
from daybook.shared import written


def settled(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the last by ``order`` (by default the time of fetching, where there is one), then by the row's JSON, so that any order of arrival gives the same row."""
    by = [c for c in (order if order is not None else ["fetched_at"]) if c in rows.columns]
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    last = F.max_by(whole, F.struct(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(by)), F.to_json(whole).alias("text")))
    return rows.groupBy(*key).agg(last.alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of old with the same key; of a key that is twice in new, the ``settled`` row. Columns that one side lacks become null."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(settled(new, key, order), allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new with keys that old lacks are added, of a key that is twice in new the ``settled`` one; nothing is changed."""
    return old.unionByName(settled(new, key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def update_some(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], on_insert: dict[str, Column] | None = None) -> DataFrame:
    """Only ``columns`` are taken from new (a null there counts); new keys are inserted with ``on_insert`` for the rest. Of a key that is twice in new, the ``settled`` row counts."""
    both = old.alias("o").join(settled(new, key).withColumn("_new", F.lit(True)).alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    there, fresh = F.col("n._new").isNotNull(), F.col(f"o.{key[0]}").isNull()
    extra = on_insert or {}

    def pick(c: str) -> Column:
        if c in key:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        if c in columns:
            return F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(fresh, extra[c]).otherwise(F.col(f"o.{c}")) if c in extra else F.col(f"o.{c}")

    return both.select(*(pick(c).alias(c) for c in old.columns))


def last_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key within a batch."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def replace_tags(old: DataFrame, entries: DataFrame) -> DataFrame:
    """The tags of the given entries (itemid, tags) replace those they had."""
    new = entries.select("itemid", F.explode("tags").alias("tag")).distinct()
    return old.join(entries.select("itemid").distinct(), "itemid", "left_anti").unionByName(new)


def fetched_refs(refs: DataFrame, results: DataFrame) -> DataFrame:
    """All references to an address get the outcome of its fetch, in results (source_url, hash, http_status, error, fetched_at)."""
    own = ["hash", "http_status", "error", "fetched_at"]
    r = settled(results.select("source_url", *own), ["source_url"]).select("source_url", *(F.col(c).alias(f"_{c}") for c in own), F.lit(True).alias("_met"))
    met = refs.join(r, "source_url", "left")
    return met.select(*(F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in refs.columns))


def fetched_blobs(assets: DataFrame, results: DataFrame) -> DataFrame:
    """Blobs of results are added or refreshed. The status of a known blob stays: a placeholder once found remains one."""
    blobs = settled(results.where("hash is not null").select(*assets.columns), ["hash"])
    status = assets.select("hash", F.col("status").alias("_status"))
    fresh = blobs.join(status, "hash", "left").withColumn("status", F.coalesce("_status", "status")).select(*assets.columns)
    return upsert(assets, fresh, ["hash"])


def record_fetches(refs: DataFrame, assets: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results (source_url, hash, mime, byte_len, width, height, status, local_path, http_status, error, fetched_at) -> new refs and assets."""
    return fetched_refs(refs, results), fetched_blobs(assets, results)


def flag_poison(assets: DataFrame, found: DataFrame) -> DataFrame:
    """Blobs found to be placeholders are flagged, never deleted and never cleared."""
    hits = found.select("hash").distinct().withColumn("_hit", F.lit(True))
    return assets.join(hits, "hash", "left").withColumn("status", F.when(F.col("_hit"), F.lit("poison")).otherwise(F.col("status"))).select(*assets.columns)


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose reference has no target; null refers to nothing and is fine."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


#: Adjacent whole-numbered keys that stay together, so that a page of a source falls into few buckets.
TOGETHER = 1024
#: Rows of a bucket that one task writes, about; it sorts what it writes.
SHARE = 100_000


class Conflict(RuntimeError):
    """Somebody else changed what a transaction read or wrote."""


class Transaction:
    """Changes of any number of tables that become current together, seen from the state at its beginning and its own changes."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.number, self.base = store.log.head()
        self.delta: dict = {"tables": {}, "values": {}}
        self.seen: dict[str, set[str] | None] = {}
        self.seen_values: set[str] = set()

    def _table(self, name: str) -> dict:
        return applied(self.base, self.delta)["tables"].get(name, {"buckets": 1, "parts": {}})

    def _see(self, name: str, buckets: set[str] | None) -> None:
        before = self.seen.get(name, set())
        self.seen[name] = None if buckets is None or before is None else before | buckets

    def _rows(self, name: str, parts: dict) -> DataFrame:
        schema = self.store.tables[name][0]
        paths = sorted(f"{self.store.root}/{name}/{folder}/bucket={b}" for b, (folder, _) in parts.items())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """A table as it is; columns added since it was written are null."""
        self._see(name, None)
        return self._rows(name, self._table(name)["parts"])

    def bucket(self, name: str, buckets: int) -> Column:
        """The bucket of a row: by the first column of the key."""
        first = self.store.tables[name][1][0]
        whole = isinstance(self.store.tables[name][0][first].dataType, (IntegerType, LongType))
        return F.pmod(F.xxhash64(F.floor(F.col(first) / TOGETHER) if whole else F.col(first)), F.lit(buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, buckets: int, held: dict[int, int]) -> dict:
        """Rows in their buckets, in a folder of their own; returns {bucket: [folder, rows]}. ``held`` says how many rows a bucket may have: large ones are dealt to several tasks by their keys, so that no task sorts more than its share."""
        (schema, key), folder = self.store.tables[name], uuid.uuid4().hex
        path = f"{self.store.root}/{name}/{folder}"
        cast = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumn("bucket", self.bucket(name, buckets))
        large = {b: -(-n // SHARE) for b, n in held.items() if n > SHARE}
        share = F.lit(0)
        if large:
            share = F.pmod(F.xxhash64(*key), F.coalesce(F.create_map(*(F.lit(i) for pair in large.items() for i in pair))[F.col("bucket")], F.lit(1))).cast("int")
        cast.repartition(max(1, -(-sum(held.values()) // SHARE)), "bucket", share).write.partitionBy("bucket").parquet(path)
        found = self.spark.read.schema(StructType([*schema, *StructType().add("bucket", "integer")])).parquet(path).groupBy("bucket").count().collect()
        return {str(b): [folder, n] for b, n in found}

    def _held(self, name: str, rows: DataFrame, buckets: int) -> dict[int, int]:
        return dict(rows.select(self.bucket(name, buckets).alias("b")).groupBy("b").count().collect())

    def _grown(self, rows: int, buckets: int) -> int:
        while rows > buckets * self.store.most // 2:
            buckets *= 2
        return buckets

    def merge(self, name: str, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``how(old, new)`` of the buckets that new falls into gives their rows; new needs the first column of the key. Where buckets outgrow the store's bound, the table gets more of them."""
        table = self._table(name)
        more = self._held(name, new, table["buckets"])
        touched = {str(b) for b in more}
        self._see(name, touched)
        if not touched:
            return
        old = {b: p for b, p in table["parts"].items() if b in touched}
        held = {b: n + (table["parts"].get(str(b)) or [None, 0])[1] for b, n in more.items()}
        parts = self._write(name, how(self._rows(name, old), new), table["buckets"], held)
        change = self.delta["tables"].setdefault(name, {"buckets": table["buckets"], "parts": {}})
        change["parts"] |= {b: parts.get(b) for b in touched} | parts
        self._fit(name)

    def _fit(self, name: str) -> None:
        table, most = self._table(name), self.store.most
        if max((n for _, n in table["parts"].values()), default=0) <= most:
            return
        buckets = self._grown(sum(n for _, n in table["parts"].values()), table["buckets"])
        if buckets > table["buckets"]:
            self._see(name, None)
            rows = self._rows(name, table["parts"])
            self.delta["tables"][name] = {"buckets": buckets, "whole": True, "parts": self._write(name, rows, buckets, self._held(name, rows, buckets))}

    def upsert(self, name: str, new: DataFrame, order: list[str] | None = None) -> None:
        self.merge(name, new, lambda old, rows: upsert(old, rows, self.store.tables[name][1], order))

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces the whole table."""
        self._see(name, None)
        buckets = self._table(name)["buckets"]
        rows = written(df)  # counted before it is dealt
        n = rows.count()
        if n > buckets * self.store.most:
            buckets = self._grown(n, buckets)
        self.delta["tables"][name] = {"buckets": buckets, "whole": True, "parts": self._write(name, rows, buckets, self._held(name, rows, buckets))}
        self._fit(name)

    def get_state(self, key: str) -> str | None:
        self.seen_values.add(key)
        return applied(self.base, self.delta)["values"].get(key)

    def set_state(self, key: str, value: str) -> None:
        self.seen_values.add(key)
        self.delta["values"][key] = value

    def _disturbed(self, other: dict) -> bool:
        for name, change in other.get("tables", {}).items():
            own = self.seen.get(name, set())
            if own is None or own and (change.get("whole") or own & change["parts"].keys()):
                return True
        return bool(self.seen_values & other.get("values", {}).keys())

    def commit(self) -> None:
        """Makes the changes current. Behind entries that others made meanwhile, if those left alone what this transaction saw; else raises Conflict."""
        if not self.delta["tables"] and not self.delta["values"]:
            return
        number = self.number + 1
        while not self.store.log.claim(number, self.delta):
            if self._disturbed(self.store.log.entry(number)):
                raise Conflict(f"{', '.join(self.seen) or 'a value'} changed meanwhile")
            number += 1


class Store:
    """Tables in a folder of any file system that Spark reads and that ``CommitLog`` can use.

    ``tables`` gives each table's type and key, ``most`` the rows of a bucket before the table gets more buckets.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[StructType, list[str]]] = TABLES, most: int = 500_000):
        self.spark, self.root, self.tables, self.most = spark, root.rstrip("/"), tables, most
        self.log = CommitLog(spark, f"{self.root}/log")

    def transact(self, change: Callable[[Transaction], object], tries: int = 5):
        """Runs ``change`` with a transaction and commits it; after a conflict all of it again, on the new state. An exception of its own undoes all."""
        for left in range(tries - 1, -1, -1):
            tx = Transaction(self)
            out = change(tx)
            try:
                tx.commit()
                return out
            except Conflict:
                if not left:
                    raise

    def read(self, name: str) -> DataFrame:
        if name == "sync_state":
            return self.spark.createDataFrame(sorted(self.log.head()[1]["values"].items()), self.tables[name][0])
        return Transaction(self).read(name)

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces a table. Raises Conflict if it was changed while df was written, since df may come of it."""
        self.transact(lambda tx: tx.write(name, df), tries=1)

    def upsert(self, name: str, new: DataFrame, order: list[str] | None = None) -> None:
        self.transact(lambda tx: tx.upsert(name, new, order))

    def merge(self, name: str, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.transact(lambda tx: tx.merge(name, new, how))

    def get_state(self, key: str) -> str | None:
        return self.log.head()[1]["values"].get(key)

    def set_state(self, key: str, value: str) -> None:
        self.transact(lambda tx: tx.set_state(key, value))

    def vacuum(self, keep: int = 2, age: float = 86_400.0) -> None:
        """Deletes what none of the last ``keep`` entries leads to, and the entries before them. Folders younger than ``age`` seconds stay: a transaction may be about to commit them."""
        last, _ = self.log.head()
        first = max(1, last - keep + 1)
        if not last:
            return
        used = {(name, b, folder) for n in range(first, last + 1) for name, t in self.log.at(n)["tables"].items() for b, (folder, _) in t["parts"].items()}
        self.log.forget_before(first)
        before = (time.time() - age) * 1000
        for name in self.tables:
            fs, where = self.log.fs(f"{self.root}/{name}")
            for version in fs.listStatus(where) if fs.exists(where) else []:
                if version.getModificationTime() > before:
                    continue
                folder = version.getPath().getName()
                if not any(u[0] == name and u[2] == folder for u in used):
                    fs.delete(version.getPath(), True)
                    continue
                for part in fs.listStatus(version.getPath()):
                    b = part.getPath().getName().removeprefix("bucket=")
                    if b.isdigit() and (name, b, folder) not in used:
                        fs.delete(part.getPath(), True)

    def check(self) -> None:
        """Raises if a comment names a poster that isn't known."""
        lost = orphans(self.read("comments"), self.read("users"), "posterid", "posterid")
        if lost.take(1):
            raise ValueError("comments name posters that are not in users")
