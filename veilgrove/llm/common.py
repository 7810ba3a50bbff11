"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder, which the cluster names in ``spark.checkpoint.dir``.

    One is made only where that setting is missing and the executors are threads
    of this process, as in tests; on a cluster that is an error, since a folder
    of one machine is not seen by the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilgrove-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and read it from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df`` (names are alike in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of ``df`` begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_or_empty(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, a null text as the empty one."""
    return df.select(F.col(id_col), *[F.col(c) for c in more], F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


#: Rows of a batch that goes to a Python worker, at most: texts of many kilobytes make ten thousand rows too much.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the rows of an Arrow batch to BATCH_ROWS; what a worker holds follows from it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ddl(df: DataFrame, *cols: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def map_texts(df: DataFrame, keep: list[str], text_col: str, fields: str, make: Callable[[], Callable[[list[str]], list[pa.Array]]]) -> DataFrame:
    """``keep`` as they are, and the columns of ``fields`` that a function of the texts gives.

    ``make`` is called once a task and returns that function, from the texts of
    a batch to one array for each field.  Ids never pass through Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for b in batches:
            got = apply(b.column(text_col).to_pylist())
            cols = [b.column(c) for c in keep] + got
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    bounded_batches(df.sparkSession)
    return df.select(*keep, text_col).mapInArrow(run, f"{ddl(df, *keep)}, {fields}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of its own in the shared checkpoint folder and read it from there."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored and that nothing refers to any more.

    Spark does so when the driver's JVM collects its garbage, by itself every
    half hour; a job of many steps would fill the disks before that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def similar_pairs(pairs: DataFrame, sets: DataFrame, on: list[str], first: list[str], second: list[str], values: str, threshold: tuple[int, int], met: int = 256, broadcast_keys: int = 100_000) -> DataFrame:
    """Those of ``pairs`` (``first``, ``second``) whose sets, the arrays ``values`` of ``sets`` by ``on``, have Jaccard ``threshold`` or more.

    A set that more than ``met`` pairs have second is sent in as many copies as
    it takes, and its pairs are dealt over them, so none meets all its pairs in
    one task.
    """
    a, b = threshold
    x = sets.select(*[F.col(c).alias(d) for c, d in zip(on, first, strict=True)], F.col(values).alias("x"))
    y = sets.select(*[F.col(c).alias(d) for c, d in zip(on, second, strict=True)], F.col(values).alias("y"))
    often = pairs.groupBy(*second).agg(F.count("*").alias("_c")).where(F.col("_c") > met)
    often = cut(often.select(*second, F.ceil(F.col("_c") / met).cast("int").alias("_parts")))
    often = F.broadcast(often) if often.count() <= broadcast_keys else often
    parts = F.coalesce("_parts", F.lit(1))
    dealt = pairs.join(x, first).join(often, second, "left").withColumn("_part", F.pmod(F.xxhash64(*first), parts).cast("int")).drop("_parts")
    copies = y.join(often, second, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))).drop("_parts")
    both = dealt.join(copies, [*second, "_part"])
    return both.where((a + b) * F.size(F.array_intersect("x", "y")) >= a * (F.size("x") + F.size("y"))).select(*first, *second)
