"""Folder ingest. Every landed file is parsed, validated, hashed and appended once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stoplens import fixed_values as fv
from stoplens.functions import calc
from stoplens.session import staged
from stoplens.sources import landed, sinks
from stoplens.sources.versions import stored


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_files(spark: SparkSession, paths: list[str], stop_path: str, batch_path: str, quarantine_path: str, epoch: int) -> None:
    """Load files whose content was not loaded by an earlier epoch; copies inside one call count once.

    The three writes may each be repeated: stops overwrite the partition of their content hash, quarantine and batch
    rows the partition of their epoch, and batch rows of this same epoch, which an attempt that died later may have
    left, do not count as loaded. Batch rows come last: what they name is whole. Read stops with :func:`ingested`.
    """
    stops, bad = landed.read_landed(spark, paths, strict=False)
    batches = stops.groupBy("file").agg(calc.content_hash(calc.row_hash(fv.SOURCE_FIELDS)).alias("content_hash"), F.count(F.lit(1)).alias("total_records"))
    batches = batches.groupBy("content_hash").agg(F.min_by(F.struct("file", "total_records"), "file").alias("b"))\
        .select("content_hash", "b.*").withColumn("epoch", F.lit(epoch).cast("bigint"))
    loaded = stored(spark, batch_path)
    if loaded is not None:
        batches = sinks.not_loaded(batches, loaded.where(F.col("epoch") != epoch), ["content_hash"])
    fresh = staged(batches, "ingest-batches")
    over = lambda rows, key, path: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    over(sinks.lookup_join(stops.drop("original"), fresh.select("file", "content_hash"), ["file"], "inner"), "content_hash", stop_path)
    over(bad.withColumn("epoch", F.lit(epoch).cast("bigint")), "epoch", quarantine_path)
    over(fresh, "epoch", batch_path)


def ingested(spark: SparkSession, stop_path: str, batch_path: str) -> DataFrame:
    """The stops of all batches that were entered."""
    entered = spark.read.parquet(batch_path).select("content_hash").distinct()
    return sinks.lookup_join(spark.read.parquet(stop_path), entered, ["content_hash"], "inner")


def start_ingest(spark: SparkSession, folder: str, stop_path: str, batch_path: str, quarantine_path: str,
                 checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watch a folder; each micro-batch hands its new file names to :func:`ingest_files`. The stream lists names alone:
    contents are read, in ranges, by the ingest."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder).select(F.col("path").alias("file"))

    def load(batch: DataFrame, epoch: int) -> None:
        paths = [r["file"] for r in batch.distinct().toLocalIterator()]
        if paths:
            ingest_files(batch.sparkSession, paths, stop_path, batch_path, quarantine_path, epoch)

    writer = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
