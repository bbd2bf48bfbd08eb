"""Session helpers: materialising a table, and running totals over a whole table."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; in local mode below a temporary one where that is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="quantloom-")
    return f"{folder.rstrip('/')}/quantloom/{name}-{uuid.uuid4().hex}"


def checkpointing(spark: SparkSession) -> None:
    """Has checkpoints go to the folder that spark.checkpoint.dir names."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark, "checkpoints"))


def deleted(context: SparkContext, path: str) -> None:
    """Deletes a file or folder in a store of Spark's."""
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialised(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, in the folder that spark.checkpoint.dir names."""
    checkpointing(df.sparkSession)
    return df.checkpoint()


#: Bytes of input files, as they are stored, that a task of a dealt table stands for.
BYTES_A_TASK = 4 << 20


def tasks_of(df: DataFrame) -> int | None:
    """Tasks that the files df reads call for; None where a plain exchange keeps as many.

    Spark joins an exchange's small partitions until about one a core is left, whatever
    spark.sql.shuffle.partitions says; an exchange into a given number is left alone.
    """
    files = df.inputFiles()
    if not files:
        return None
    spark = df.sparkSession
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    n = -(-size // BYTES_A_TASK)
    return n if n > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else None


def dealt(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """df with the rows of equal keys in one task; the tasks grow in number with the files it reads, not in size."""
    tasks = tasks or tasks_of(df)
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def running_total(df: DataFrame, order: list[str], weight: str | None = None, name: str = "before", tasks: int | None = None) -> DataFrame:
    """Adds to each row the weights (whole numbers; or number) of the rows before it in the whole order.

    Rows are range-partitioned and totals of the partitions added up, so no task sees
    more than its share.  ``order`` has to be unique for a result that does not vary.
    """
    schema = StructType([*df.schema.fields, StructField("_part", IntegerType(), False), StructField(name, LongType()), StructField("_upto", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            w = batch.column(weight).to_numpy().astype(np.int64) if weight else np.ones(batch.num_rows, np.int64)
            upto = held + np.cumsum(w)
            held = int(upto[-1]) if len(upto) else held
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - w), pa.array(upto)], names=schema.names)

    ranged = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    ranged = materialised(ranged.mapInArrow(run, schema))
    parts = ranged.groupBy("_part").agg(F.max("_upto").alias("_held"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(parts), "_part").withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset", "_upto")


def default_session(app: str = "quantloom") -> SparkSession:
    """A session with the settings that the operators assume."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


class Tables:
    """Tables that an iterative operator writes to the shared folder, each until the next is there.

    They cut the lineage: a lost executor costs a re-read.  What is left goes at the end of
    the ``with`` block or, for results that are still lazy, when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_folder(spark, name)
        atexit.register(self.clean)

    def write(self, df: DataFrame, name: str, instead_of: str | None = None) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        if instead_of:
            self._delete(f"{self.root}/{instead_of}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        deleted(self.spark.sparkContext, path)

    def clean(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may be gone at interpreter exit
            pass

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.clean()
