"""Helpers shared by the operators: Arrow column functions, checkpoints, bounded samples, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch sent to Python: bound a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: A join key of at least 1 / HOT of the rows goes by broadcast: at most HOT keys can.
HOT = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts; a smaller row limit of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_column(spark: SparkSession, make: Callable[[], Callable[[list], dict[str, list]]], ddl: str) -> Callable[[Column], Column]:
    """A column function of one string column, evaluated over Arrow batches.

    ``make`` runs once per task and returns a function from a list of texts (None for null) to a dict of
    lists or Arrow arrays, one per field of ``ddl``. Only this column goes to Python; all other columns stay in the JVM.
    """
    bounded_batches(spark)
    struct = StructType.fromDDL(ddl)
    kind = to_arrow_type(struct)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            out = f(batch.to_pylist())
            cols = [out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], type=x.type) for x in kind]
            yield pa.StructArray.from_arrays(cols, fields=list(kind))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType=struct)


def with_text_column(df: DataFrame, text: str, make: Callable, ddl: str) -> DataFrame:
    """``df`` with the fields of ``ddl`` computed from ``text``; columns of ``df`` by these names are replaced."""
    names = StructType.fromDDL(ddl).names
    keep = [c for c in df.columns if c not in names]
    f = text_column(df.sparkSession, make, ddl)
    return df.withColumn("__made", f(F.col(text))).select(*keep, *(F.col("__made")[n].alias(n) for n in names))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is configured and all tasks run on this
    machine (tests). Raises on a cluster without one: executors would write to folders of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again. For loops of joins: a checkpoint keeps the
    planner's guess of its size, which such a loop multiplies from round to round; a written table has its true one."""
    path = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as held out (null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def sample_per_class(df: DataFrame, cls: str, order: Column, n: int, salts: int = 64) -> DataFrame:
    """The n rows of each class that come first by ``order``. Spark applies the limit in every map task before it shuffles; a
    class is first cut to n rows in each of ``salts`` shares, so no task sees a hot class's rows of all map tasks."""
    def first(x: DataFrame, *by: str) -> DataFrame:
        return x.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("__r") <= n).drop("__r")

    return first(first(df.withColumn("__s", F.pmod(F.xxhash64(order), F.lit(salts))), cls, "__s"), cls).drop("__s")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (unique ``keys``), whose ``hot`` rows are few and are broadcast, so that a frequent
    key of ``left`` stays where its rows are. Left rows without a partner stay for how="left"."""
    at_hot = F.broadcast(right.filter(hot))
    cold = left.join(at_hot.select(*keys), keys, "left_anti")
    return left.join(at_hot, keys).unionByName(cold.join(right.filter(~hot), keys, how))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (node, component) per node that has an edge to
    another node, component = smallest node. Alternating large-star / small-star steps; each round is written.
    Null ends and self-loops are dropped (no edge). Raises if ``rounds`` do not suffice (each halves the distances)."""
    e = (edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = written(e)
    state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = written(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = now
    raise RuntimeError("components did not settle")
