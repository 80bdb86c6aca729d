"""Fact tables with a commit ledger: rows count only once a ledger entry names their folder.

A table is a folder with ``data/entry=<id>/<grain>=<value>/`` (Parquet) and
``ledger/`` (one small Parquet file an entry). A batch's rows are written first;
then its entry appears by the rename of one file, so a reader sees all of a batch
or nothing. An entry is known by (stream, batch): a batch that comes again after
a failure finds its entry, or, if two attempts raced, the first entry counts.
Streams have ids of their own, so a second stream, or one that begins anew with
a fresh checkpoint, adds to the table.

``compact`` writes the live rows of small entries as one entry that replaces
them, again by one ledger entry; if two compactions replace the same rows, the
later one doesn't count. ``fold`` puts the ledger itself into one file. Folders
that no entry names (of failed attempts, or replaced) are removed by ``vacuum``.

The driver reads the ledger only: a row a batch since the last fold.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "entry string, stream string, batch long, n_rows long, replaces array<string>, committed_at timestamp"
#: Forms of the time's grains that a table may be partitioned by.
GRAINS = {"month": "yyyyMM", "day": "yyyyMMdd"}
#: Rows of an entry that ``compact`` leaves as it is.
LARGE = 5_000_000


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _files(spark, path)
    return system.exists(at)


def _entries(spark: SparkSession, table: str) -> list:
    """All entries in the order of their commits."""
    if not _exists(spark, f"{table}/ledger"):
        return []
    rows = spark.read.schema(ENTRY).parquet(f"{table}/ledger").collect()
    first = {r.entry: r for r in rows}  # a fold and what it stands for hold the same entries
    return sorted(first.values(), key=lambda r: (r.committed_at, r.entry))


def live_entries(spark: SparkSession, table: str) -> list:
    """The entries whose rows are the table's: the first of each batch, less those that a compaction replaced."""
    live, known = {}, set()
    for r in _entries(spark, table):
        if r.replaces is None and (r.stream, r.batch) not in known:
            known.add((r.stream, r.batch))
            live[r.entry] = r
        elif r.replaces is not None and all(x in live for x in r.replaces):
            for x in r.replaces:
                del live[x]
            live[r.entry] = r
    return list(live.values())


def _commit(spark: SparkSession, table: str, entries: list[tuple], mode: str = "append", folder: str = "ledger") -> None:
    spark.createDataFrame(entries, ENTRY).coalesce(1).write.mode(mode).parquet(f"{table}/{folder}")


def _written(rows: DataFrame, table: str, entry: str, grain: str) -> int:
    """Write an entry's rows; they are counted by the same job."""
    seen = Observation(entry)
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.partitionBy(grain).parquet(f"{table}/data/entry={entry}")
    return seen.get["n"]


def append(rows: DataFrame, table: str, ts: str, stream: str, batch: int, grain: str = "month") -> bool:
    """Add a batch of a stream once; false if it is committed already. Rows without a time stand under a null grain."""
    spark = rows.sparkSession
    if any((r.stream, r.batch) == (stream, batch) for r in _entries(spark, table)):
        return False
    entry = uuid.uuid4().hex
    n = _written(rows.withColumn(grain, F.date_format(ts, GRAINS[grain])), table, entry, grain)
    _commit(spark, table, [(entry, stream, batch, n, None, dt.datetime.now(dt.UTC))])
    return True


def read_fact(spark: SparkSession, table: str, schema: str | StructType, grain: str = "month") -> DataFrame:
    """The committed rows, with the column of the grain; its filters prune folders. A table without commits is empty."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*fields.fields]).add("entry", "string").add(grain, "string")
    paths = [f"{table}/data/entry={r.entry}" for r in live_entries(spark, table) if r.n_rows]
    found = spark.read.schema(full).option("basePath", f"{table}/data").parquet(*paths) if paths else spark.createDataFrame([], full)
    return found.drop("entry")


def compact(spark: SparkSession, table: str, schema: str | StructType, grain: str = "month") -> int:
    """Write the rows of small entries as one entry; how many it replaced. Readers see the old or the new rows, never both."""
    small = [r for r in live_entries(spark, table) if r.n_rows < LARGE]
    if len(small) < 2:
        return 0
    entry = uuid.uuid4().hex
    full = StructType([*(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields]).add("entry", "string").add(grain, "string")
    n, paths = 0, [f"{table}/data/entry={r.entry}" for r in small if r.n_rows]
    if paths:
        rows = spark.read.schema(full).option("basePath", f"{table}/data").parquet(*paths).drop("entry")
        n = _written(rows.repartition(grain), table, entry, grain)
    _commit(spark, table, [(entry, "compaction", 0, n, [r.entry for r in small], dt.datetime.now(dt.UTC))])
    return len(small)


def fold(spark: SparkSession, table: str) -> None:
    """One file for all entries that the ledger has now; entries that come meanwhile stay beside it.

    The folded file is written first and takes effect as it is moved in; the files that it stands for go after that.
    """
    system, ledger = _files(spark, f"{table}/ledger")
    if not system.exists(ledger):
        return
    before = [f.getPath() for f in system.listStatus(ledger) if f.getPath().getName().endswith(".parquet")]
    folder = f"fold-{uuid.uuid4().hex}"
    _commit(spark, table, [tuple(r) for r in _entries(spark, table)], "errorifexists", folder)
    _, made = _files(spark, f"{table}/{folder}")
    for f in system.listStatus(made):
        if f.getPath().getName().endswith(".parquet"):
            system.rename(f.getPath(), _files(spark, f"{table}/ledger/{f.getPath().getName()}")[1])
    for path in before:
        system.delete(path, False)
    system.delete(made, True)


def vacuum(spark: SparkSession, table: str, older_than_hours: float = 24.0) -> int:
    """Remove data folders that no live entry names and that are older than any running write or read; how many."""
    system, data = _files(spark, f"{table}/data")
    if not system.exists(data):
        return 0
    kept = {f"entry={r.entry}" for r in live_entries(spark, table)}
    before, n = dt.datetime.now(dt.UTC).timestamp() * 1000 - older_than_hours * 3_600_000, 0
    for f in system.listStatus(data):
        if f.getPath().getName() not in kept and f.getModificationTime() <= before:
            n += bool(system.delete(f.getPath(), True))
    return n


def stream_id(batch: DataFrame) -> str:
    """The id that a query's checkpoint keeps, inside ``foreachBatch``."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
