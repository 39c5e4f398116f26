"""Helpers shared by the corpus operators: the shared folder, written tables, ranks and sums over all rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words: the space and the five ASCII controls from tab to carriage return.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir; where unset on a local master (tests), a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, local, True)
        path = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Where the step tables that are still there lie, in the order of their writing.
_STEPS: dict[str, weakref.ref] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STEPS[path] = weakref.ref(out)
    return out


def dropped(spark: SparkSession, *steps: DataFrame) -> None:
    """Deletes the tables of steps whose readers have all been written; without steps, those of all that are still there."""
    gone = [path for path, step in _STEPS.items() if not steps or any(step() is s for s in steps)]
    jvm = spark.sparkContext._jvm
    for path in gone:
        del _STEPS[path]
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    freed(spark)


def freed(spark: SparkSession) -> None:
    """Asks the driver to collect the handles of finished jobs, whose shuffle files then go."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Tasks for a stage that a plan deals out by hand: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text modulo modulus equals remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, buckets: int) -> DataFrame:
    """Adds a dense 0-based rank within group, by hash bucket and then by order.

    A group is split into buckets, so no task holds a whole group; the bucket offsets come from counts.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*group, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_within", within).join(offsets, keys).withColumn(rank, (F.col("_base") + F.col("_within")).cast("long")).drop("_bucket", "_base", "_within")
