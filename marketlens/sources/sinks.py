"""Append sinks, their streaming forms, and the insert-or-ignore table.

Everything that must not be written twice goes through ``publish``: data is staged in a hidden folder, which no reader lists,
and becomes visible by one rename that fails where the target exists. A lost executor, a stopped job or a second writer leaves
a hidden folder at worst, never half of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.calibration import new_rows

LEDGER_COLUMNS = tuple(x.split()[0] for x in S.LEDGER.split(","))


def write_events(events: DataFrame, path: str) -> None:
    """Appends event rows as JSON lines, partitioned by event type."""
    events.write.mode("append").partitionBy("event").json(path)


def write_ledger(rows: DataFrame, path: str) -> None:
    """Appends ledger rows as CSV in the fixed column order."""
    rows.select(*LEDGER_COLUMNS).write.mode("append").option("header", True).csv(path)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(rows: DataFrame, path: str, name: str, fmt: str, by: Sequence[str] = (), **options: object) -> bool:
    """Writes ``rows`` as the folder ``name`` below ``path`` at once; False, and nothing written, where it exists already."""
    spark = rows.sparkSession
    target, fs = _folder(spark, f"{path}/{name}")
    if fs.exists(target):
        return False
    staged, _ = _folder(spark, f"{path}/_staged-{uuid.uuid4().hex}")
    rows.write.options(**options).partitionBy(*by).format(fmt).save(staged.toString())
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(staged, target, none)
    except Py4JJavaError as e:
        fs.delete(staged, True)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def event_batches(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of event rows: JSON lines by event type, one folder per batch. A batch that a restarted query sends
    again finds its folder and adds no row. ``path`` belongs to one query (one checkpoint)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(batch, path, f"batch={batch_id}", "json", ["event"])

    return write


def ledger_batches(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of ledger rows: CSV in the fixed column order, one folder per batch as ``event_batches``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(batch.select(*LEDGER_COLUMNS), path, f"batch={batch_id}", "csv", header=True)

    return write


def upsert_hist_calib(rows: DataFrame, path: str) -> None:
    """Adds rows whose (asset, round_ts, side) is not stored yet; the first write wins.

    Each write is one commit, a folder with the next number. The keys of all commits before it are checked, and a writer that
    finds its number taken checks again against the commit that took it, so two writers or a repeated job leave each key once.
    Only the stored days between the first and the last day of ``rows`` are read. A path that does not exist is an empty
    store; every other error is raised."""
    spark = rows.sparkSession
    rows = rows.withColumn("day", F.to_date(F.timestamp_seconds("round_ts")))
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    while True:
        where, fs = _folder(spark, path)
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        done = [int(x.removeprefix("commit=")) for x in names if x.startswith("commit=")]
        stored = spark.createDataFrame([], "asset string, round_ts long, side string")
        if done:
            folders = [f"{path}/commit={n}" for n in done]
            kept = spark.read.schema("asset string, round_ts long, side string, day date").option("basePath", path).parquet(*folders)
            stored = kept.where(F.col("day").between(F.lit(first), F.lit(last))).select("asset", "round_ts", "side")
        if publish(new_rows(rows, stored), path, f"commit={max(done, default=-1) + 1}", "parquet", ["day"]):
            return
