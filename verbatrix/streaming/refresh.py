"""Streaming beyond one-shot builds: incremental refresh of units, notebook logs.

A build reads a whole corpus. Here a stream of files (rel_path,
content) keeps a table of units: of each micro-batch only files whose content
hash is new are parsed, and each batch is one partition of the table, so that
a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatrix.operators import markdown, trails

HASHES = "rel_path string, hash string, batch bigint"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _overwrite(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def refresh_units(files: DataFrame, path: str, checkpoint: str, library: str = markdown.LIBRARY, version: str = markdown.VERSION):
    """Writer of the stream ``files`` into the tables ``hashes`` and ``units`` under ``path``."""
    def batch_of(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _read(spark, f"{path}/hashes", HASHES).where(F.col("batch") < number)
        last = known.groupBy("rel_path").agg(F.max_by("hash", "batch").alias("hash"))
        new = batch.dropDuplicates(["rel_path"]).withColumn("hash", F.sha2("content", 256)).join(last, ["rel_path", "hash"], "left_anti")
        _overwrite(markdown.units(new, library, version).join(new.select(markdown.T.to_doc_id(F.col("rel_path")).alias("doc_id"), "rel_path"), "doc_id"), f"{path}/units", number)
        _overwrite(new.select("rel_path", "hash"), f"{path}/hashes", number)

    return files.writeStream.foreachBatch(batch_of).option("checkpointLocation", checkpoint)


def current_units(spark: SparkSession, path: str) -> DataFrame:
    """Units of the last version of each file."""
    hashes = spark.read.parquet(f"{path}/hashes")
    last = hashes.groupBy("rel_path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/units").join(last, ["rel_path", "batch"], "left_semi").drop("batch", "rel_path")


def trail_states(events: DataFrame, path: str, checkpoint: str):
    """Writer of a stream of notebook events into their log; ``trails.fold`` reads it.
    An event that comes twice is one, by its notebook and number."""
    unique = events.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["trail_id", "seq"])
    return unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each notebook: events closer than ``gap``; those later than ``late`` are dropped."""
    own = events.withWatermark("at", late).groupBy("trail_id", F.session_window("at", gap).alias("s"))
    return own.agg(F.count("*").alias("events")).select("trail_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
