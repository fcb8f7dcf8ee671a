"""Operator 5, line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents arrive in batches of rising doc_id. The runs hold the 128-bit digest of every line key
seen so far and the document that held it first; they are bucketed and sorted by digest, so no
join moves or reorders them. Each batch's distinct keys meet all runs in one left join, bucket by
bucket. What comes of it is written once, as a run: the keys that no run had are new, and those
that a run had, or that two documents of the batch share, say which lines go. When a level has
``fanout`` runs they are merged, again bucket by bucket, into one run of the next level, so a key
is rewritten only a logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, Scratch, delete, table

#: Columns of a run's table: the digest, the document that first held it, whether that is news of this run, whether lines must go.
RUN = "key binary, first bigint, new boolean, shared boolean"


class SortedRuns:
    """The levels of runs in a folder, no key in two runs. The folder outlives the session, so later batches go on from it.

    A manifest with the next number makes a change current once the runs it names are whole; runs
    that no manifest names any more are deleted after it. ``buckets`` counts when the folder is new;
    ``most`` bounds the keys of a bucket, and runs that hold more in all get more buckets.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = 2, most: int = 500_000):
        self.spark, self.folder, self.fanout, self.most = spark, folder.rstrip("/"), fanout, most
        self.parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        self.number, held = self._manifest()
        self.buckets, self.levels, self.rows = held.get("buckets", buckets or self.parallel), held.get("levels", []), held.get("rows", {})

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _manifest(self) -> tuple[int, dict]:
        fs, where = self._fs(self.folder)
        names = sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []
        names = [n for n in names if n.startswith("manifest-")]
        if not names:
            return 0, {}
        stream = fs.open(self._fs(f"{self.folder}/{names[-1]}")[1])
        try:
            return int(names[-1].split("-")[1]), json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, gone: list[str]) -> None:
        self.number += 1
        fs, draft = self._fs(f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "levels": self.levels, "rows": self.rows}).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.folder}/manifest-{self.number:010d}")[1]):
            raise RuntimeError("the manifest of the line runs was changed meanwhile")
        for run in gone:
            self._close(run)
            delete(self.spark, f"{self.folder}/{run}")

    def _plain(self, run: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/{run}")

    def _grown(self, gone: list[str]) -> None:
        """Where the runs hold more than ``most`` keys a bucket, one run with enough buckets for twice as many takes their place."""
        held = [run for level in self.levels for run in level]
        keys = sum(self.rows.get(run, 0) for run in held)
        if keys <= self.buckets * self.most:
            return
        while keys > self.buckets * self.most // 2:
            self.buckets *= 2
        whole = None
        for run in held:
            one = self._plain(run).where("new").select("key", "first", F.lit(True).alias("new"), F.lit(False).alias("shared"))
            whole = one if whole is None else whole.union(one)
        self.levels = [[] for _ in self.levels[:-1]] + [[self._write(whole.repartition(self.buckets, "key"))]]
        self.rows = {self.levels[-1][0]: keys}
        gone += held

    def _open(self, run: str) -> DataFrame:
        if run not in self.tables:
            self.tables[run] = f"daybook_{run}"
            self.spark.sql(f"CREATE TABLE {self.tables[run]} ({RUN}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(self.tables[run])

    def _close(self, run: str) -> None:
        if run in self.tables:
            self.spark.sql(f"DROP TABLE {self.tables.pop(run)}")

    def close(self) -> None:
        """Forgets the tables' names; the runs stay in their folder."""
        for run in list(self.tables):
            self._close(run)

    def _write(self, df: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        self.tables[run] = f"daybook_{run}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{run}").format("parquet").saveAsTable(self.tables[run])
        return run

    def all(self) -> DataFrame | None:
        """key and first of all runs, in their buckets."""
        out = None
        for run in (run for level in self.levels for run in level):
            one = self._open(run).where("new").select("key", "first")
            out = one if out is None else out.union(one)
        return out

    def met(self, firsts: DataFrame) -> DataFrame:
        """(key, mine, last) of a batch's distinct keys -> a run's table."""
        if self.buckets != self.parallel:
            firsts = firsts.repartition(self.buckets, "key")
        runs = self.all()
        both = firsts.withColumn("first", F.lit(None).cast("bigint")) if runs is None else firsts.join(runs.hint("merge"), "key", "left")
        known = F.col("first").isNotNull()
        return both.select("key", F.coalesce("first", "mine").alias("first"), (~known).alias("new"), (known | (F.col("last") > F.col("mine"))).alias("shared"))

    def add(self, firsts: DataFrame) -> DataFrame:
        """Adds a batch's keys; returns (key, first) of those of its lines that may have to go. It is read as plain Parquet, so that a join with it can split a hot key."""
        run, gone, level = self._write(self.met(firsts)), [], 0
        self.rows[run] = self._plain(run).where("new").count()
        self._plain(run).where("shared").select("key", "first").write.parquet(f"{self.folder}/shared_{run}")
        shared = self.spark.read.schema("key binary, first bigint").parquet(f"{self.folder}/shared_{run}")
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                break
            old, self.levels[level] = self.levels[level], []
            merged = None
            for r in old:
                one = self._open(r).where("new")
                merged = one if merged is None else merged.union(one)
            whole = merged.groupBy("key").agg(F.min("first").alias("first"))  # runs share no key: this only keeps each bucket in one task
            run = self._write(whole.select("key", "first", F.lit(True).alias("new"), F.lit(False).alias("shared")))
            self.rows[run] = sum(self.rows.pop(r) for r in old)
            gone += old
            level += 1
        self._grown(gone)
        self._commit(gone)
        return shared


def line_key(line: Column) -> Column:
    """A line without blanks at its ends; A-Z must already be lower-cased."""
    return F.btrim(line, F.lit(BLANKS))


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """A row (doc_id, tag, pos, key) for each line whose key is long enough: key is half of its SHA-256, tag tells rows of one doc_id apart by text."""
    low = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.translate("text", UPPER, UPPER.lower()).alias("text")).where("doc_id is not null")
    lines = low.select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return lines.where(F.length("key") >= least).select("doc_id", "tag", "pos", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("key"))


def cut_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2, index: str | None = None, most: int = 500_000) -> DataFrame:
    """docs with ``text`` (null: empty) -> the same rows and columns, plus n_lines, n_dropped and kept_text.

    Keys of at least ``least`` code points found in two documents or more stay only in the smallest
    doc_id that holds them (all its occurrences there). A null doc_id takes no part: its row comes
    back whole. Repeated rows of one doc_id count as one document. An empty text is one empty line.
    Besides doc_id and text, columns are handed through, whatever their names; those named like the
    three new ones are replaced. With ``index``, a folder of runs, keys that earlier calls saw in
    other documents go as well, and those of docs are added to it. ``most`` bounds the keys of a bucket.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    steps = [i / batches for i in range(1, batches)]
    cuts = (rows.agg(F.percentile_approx("doc_id", steps, 10000)).first()[0] if steps else None) or []
    batch = sum(((F.col("doc_id") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    staged, _ = scratch.write(hashed_lines(rows, least).withColumn("batch", batch), "batch")
    few = staged.count() // most + 1  # no more buckets than the lines can need, for small inputs
    runs, drops = SortedRuns(spark, index or scratch.path(), min(few, int(spark.conf.get("spark.sql.shuffle.partitions"))), fanout, most), []
    for b in range(len(set(cuts)) + 1):
        own = staged.where(F.col("batch") == b)
        shared = runs.add(own.groupBy("key").agg(F.min("doc_id").alias("mine"), F.max("doc_id").alias("last")))
        late = own.join(shared, "key").where("doc_id <> first").select("doc_id", "tag", "pos")
        drops.append(scratch.write(late)[1])
    runs.close()
    late = spark.read.schema(late.schema).parquet(*drops)
    cut = late.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("pos")).alias("cut"))
    # the columns of docs travel in one struct under numbers, so that none meets a name used here
    given = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    row = F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(given)))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.coalesce("text", F.lit("")).alias("whole")).withColumn("tag", F.xxhash64("whole"))
    met = whole.join(cut, ["doc_id", "tag"], "left").withColumn("lines", F.split("whole", "\n"))
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda p: p + 1))
    ends = F.concat("cut", F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.slice("lines", x["s"] + 1, x["e"] - x["s"])))
    counted = met.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("cut").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
    return counted.select(*((F.col("row")[f"c{i}"].cast("long") if c == "doc_id" else F.col("row")[f"c{i}"]).alias(c) for i, c in enumerate(given)), "n_lines", "n_dropped", "kept_text")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS cut FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
