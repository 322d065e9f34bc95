"""Streams: running means and contingency tables, ingest, and windows. All state
is sums by key, so a stream's table equals the batch's over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_eval(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means so far; for batch and stream alike."""
    g = rows.groupBy(*keys).agg(F.sum(F.col("value") * F.col("weight")).alias("s"), F.sum("weight").alias("sum_weight"))
    return g.where("sum_weight > 0").select(*keys, (F.col("s") / F.col("sum_weight")).alias("mean"), "sum_weight")


def running_contingency(pairs: DataFrame) -> DataFrame:
    return pairs.where("true_id > 0 OR pred_id > 0").groupBy("volume", "true_id", "pred_id").agg(F.count("*").alias("n"))


def metric_windows(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and count per tumbling window and stage; in a stream, rows over
    ``late`` behind the latest are dropped and closed windows forgotten."""
    r = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return r.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "mean", "n")


def new_items(rows: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, however often it arrives within ``late``."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a stream over what is there now and leave its table at ``path``, which
    ``read_table`` reads: each micro-batch in complete mode replaces it, in append
    mode adds to it, in a folder of its number, so that a batch that is run again
    replaces what it has left."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch_sink(path, mode)).start().awaitTermination()


def batch_sink(path: str, mode: str):
    """In complete mode a batch is written beside the table, in a folder of its own,
    and published when it is whole: a file that names the folder is put in place of
    the one before by one rename. Readers see one batch or the next, never parts of
    one. The folder before last goes, as no reader that started since uses it."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if mode != "complete":
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            return
        folder = f"batch-{number}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{path}/{folder}")
        before = _published(spark, path)
        _publish(spark, path, [folder, *before[:1]])
        for old in before[1:]:
            _delete(spark, f"{path}/{old}")

    return put


CURRENT = "_current"  # the file with the names of the published folder and of the one before


def _filesystem(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, where, where.getFileSystem(conf)


def _published(spark: SparkSession, path: str) -> list[str]:
    _, _, where, files = _filesystem(spark, f"{path}/{CURRENT}")
    if not files.exists(where):
        return []
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode().split("\n")
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, folders: list[str]) -> None:
    jvm, conf, where, files = _filesystem(spark, f"{path}/{CURRENT}")
    _, _, beside, _ = _filesystem(spark, f"{path}/{CURRENT}-{uuid.uuid4().hex}")
    stream = files.create(beside)
    stream.write("\n".join(folders).encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getFileSystem(conf).getUri(), conf).rename(beside, where, options)


def _delete(spark: SparkSession, path: str) -> None:
    _, _, where, files = _filesystem(spark, path)
    files.delete(where, True)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that ``to_table`` has left: the published batch in complete mode, all
    batches in append mode. Without a batch it is empty."""
    published = _published(spark, path)
    if published:
        return spark.read.schema(schema).parquet(f"{path}/{published[0]}")
    _, _, where, files = _filesystem(spark, path)
    if not files.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*(f.name for f in schema.fields))
