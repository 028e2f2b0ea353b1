"""The barcode histogram over a stream of read files; what follows it needs a frozen histogram, so it stays in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def reads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def histogram(stream: DataFrame) -> DataFrame:
    """bc, n so far."""
    return stream.groupBy("bc").agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, bc, n for windows of event time; rows later than `late` are dropped, so the state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "bc").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bc", "n")


def start(hist: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keeps the histogram as an in-memory table for looking at; a checkpoint makes it restartable."""
    return hist.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
