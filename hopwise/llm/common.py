"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is made if driver and executors are one
    process (tests); on a cluster there is no folder that could stand in.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="hopwise-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, cutting its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, as a compressed Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/hopwise-tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are deleted when it ends, not when the driver happens to
    collect its garbage.  For jobs of many steps whose results are all checkpointed or written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def running_totals(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, amount, upto) of rows with distinct keys; ``upto`` is the sum of the amounts of all
    smaller keys.

    Rows are sorted in ranges and the ranges' sums added up first, so no task sees them all.  The
    ranges are drawn from a sample and written out; the sums do not depend on them.
    """
    ranged = checkpointed(rows.select(key, amount).repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum(amount).alias("_own"))
    parts = parts.select("_part", (F.sum("_own").over(Window.orderBy("_part")) - F.col("_own")).alias("_before"))  # one row a partition
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return ranged.join(F.broadcast(parts), "_part").select(key, amount, upto.alias("upto"))


def free_memory() -> None:
    """Hand what a batch has left free back to the system: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to dicts of columns (lists or arrays)."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def column(values, kind):
        return values.cast(kind) if isinstance(values, pa.ListArray) else pa.array(values, type=kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in arrow], schema=arrow)
                free_memory()

    return df.mapInArrow(each, schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``arrow_batches`` with one batch out for each batch in."""
    return arrow_batches(df, lambda batch: (fn(batch),), schema)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until none of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes, empty for null."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
