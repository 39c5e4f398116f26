"""Streams: new documents to elements, chunks and responses, and a status log to the current status of every document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, chunks, responses, structure

# The statuses of a document, in the order in which it goes through them; the last two are ends.
STATUSES = ("pending", "uploaded", "parsing", "extracting", "completed", "failed")


def _empty(text: Column) -> Column:
    return F.coalesce(structure.stripped(text) == "", F.lit(True))


def _chunks(elements: DataFrame, limit: int) -> DataFrame:
    rows = elements.select("doc_id", "ord", "element_id", "section", F.lit(None).cast("int").alias("page"), "text")
    return chunks.chunk_summary(chunks.chunk_numbers(chunks.section_units(chunks.render_markers(rows)), limit))


def stream_ingest(documents: DataFrame, path: str, checkpoint: str, call: Callable[[str], str] | None = None, process: Callable[[DataFrame], DataFrame] = structure.build_elements, max_chars: int = 5000, tasks: int = 8, pool: int = 4) -> None:
    """Runs each new batch of a stream of documents (doc_id, source, text) through elements, chunks and calls, under path.

    Tables: elements, chunks, responses (those of good documents), status (doc_id, status, step; a row for each status that a
    document went through) and quarantine (doc_id, step, error: one row for each document that failed, with its first error).
    A document without id, text or elements, or with a chunk whose call fails, is failed and quarantined; the batch goes on, and
    the others complete. Without a call, documents complete with their chunks. A batch writes folders of its own name, so one
    that runs again after a failure replaces its rows. Rows of one id in a batch are one document, of the smallest text.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def kept(frame: DataFrame, name: str) -> DataFrame:
            place = f"{path}/{name}/batch={number}"
            frame.write.mode("overwrite").parquet(place)
            return spark.read.schema(frame.schema).parquet(place)

        arrived = batch.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("x")).select("doc_id", "x.text", "x.source")
        arrived = kept(arrived, "arrived")
        reason = F.when(F.col("doc_id").isNull(), "no id").when(_empty(F.col("text")), "no text")
        blank = arrived.where(reason.isNotNull()).select("doc_id", F.lit("parsing").alias("step"), reason.alias("error"))
        said = arrived.where(reason.isNull())
        elements = kept(process(said), "elements")
        bare = said.join(elements.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("parsing").alias("step"), F.lit("no elements").alias("error"))
        packed = kept(_chunks(elements, max_chars), "chunks")
        failed = blank.unionByName(bare)
        if call is not None:
            summary = F.concat_ws(" ", F.col("chunk_id"), F.concat(F.col("elements").cast("string"), F.lit(" elements")), F.concat(F.col("chars").cast("string"), F.lit(" characters")))
            asked = packed.select("doc_id", "chunk_id", F.col("markdown").alias("request"), summary.alias("summary"))
            answered = kept(responses.batch_infer(asked, call, tasks, pool).drop("request"), "calls")
            wrong = answered.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "chunk_id").alias("error"))
            failed = failed.unionByName(wrong.select("doc_id", F.lit("extracting").alias("step"), "error"))
        failed = kept(failed, "quarantine")
        if call is not None:
            kept(answered.join(failed.select("doc_id"), "doc_id", "left_anti").drop("error", "summary"), "responses")
        ended = failed.select(F.col("doc_id").alias("failed_id"), F.col("step").alias("stopped"))
        way = arrived.select("doc_id").join(ended, F.col("doc_id").eqNullSafe(F.col("failed_id")) & F.col("stopped").isNotNull(), "left")
        gone = F.when(F.col("stopped") == "parsing", F.array(F.lit("parsing"), F.lit("failed"))).when(F.col("stopped") == "extracting", F.array(F.lit("parsing"), F.lit("extracting"), F.lit("failed"))).otherwise(F.array(F.lit("parsing"), F.lit("extracting"), F.lit("completed")))
        kept(way.select("doc_id", F.posexplode(F.concat(F.array(F.lit("uploaded")), gone)).alias("step", "status")), "status")

    documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_status(log: DataFrame, path: str, checkpoint: str, compact: int = 20) -> None:
    """Keeps the latest status of each document of a stream (doc_id, status, ts) under path, for current_status to read.

    The state is one row for each document; a batch writes only the documents that it changed, in a folder of its own name.
    Each `compact` batches what they wrote becomes one folder; the folders before go one compaction later, so that a reader
    that has listed them still finds their files.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/upto={number}")
        if compact and number and number % compact == 0:
            whole = current_status(spark, path)
            whole.write.mode("overwrite").parquet(f"{path}/whole={number}")
            _removed(spark, path, number - compact)

    latest = catalog.latest_status(log)
    latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _folders(spark: SparkSession, path: str) -> list:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(files, s.getPath()) for s in files.listStatus(where) if s.isDirectory() and "=" in s.getPath().getName()]


def _removed(spark: SparkSession, path: str, number: int) -> None:
    """Deletes the folders of batches before number, which a whole folder of that number or a later one holds."""
    for files, folder in _folders(spark, path):
        if int(folder.getName().split("=")[1]) < number:
            files.delete(folder, True)


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, status, ts, active: the latest of what all folders say; a row that two of them hold counts once."""
    folders = [folder.toString() for _, folder in _folders(spark, path)]
    return catalog.latest_status(spark.read.parquet(*folders).select("doc_id", "status", "ts"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, a file or a folder of files, as a stream."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parquet*")
