"""Structured Streaming forms of the incremental behaviour; each drains its input with an available-now trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larchspan.session import scratch


def _drain(df: DataFrame, mode: str, out: str, checkpoint: str) -> None:
    """Runs a query to the end of what there is, one folder a batch; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_arrivals(spark: SparkSession, arrivals: DataFrame, files_per_batch: int = 2) -> DataFrame:
    """key, id, n: per key the smallest identifier met, as a running aggregate over micro-batches."""
    base = scratch(spark, "arrivals")
    arrivals.repartition(4, "id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/in")
    _drain(stream.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "update", f"{base}/out", f"{base}/state")
    got = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return got.groupBy("key").agg(F.max(F.struct("batch", "id", "n")).alias("m")).select("key", "m.id", "m.n")


def confirm(spark: SparkSession, series: DataFrame, level: float = 15.0, n: int = 2, min_days: float = 1.0) -> DataFrame:
    """uid, status, first, length: runs of values over `level` decibels; a run is confirmed once it has `n` values over
    `min_days`, pending while it is open and short, and state is all that later batches need of earlier ones."""
    base = scratch(spark, "confirm")
    day = F.datediff("ts", F.lit("2024-01-01"))
    flat = series.groupBy("uid", "ts").agg(F.max("lin").alias("lin")).withColumn("part", F.floor(day / 10))
    # arrivals ten days at a time, one after another: the file source reads in the order in which files were written, and
    # a unit's rows of one arrival are in one file
    for (part,) in sorted(flat.select("part").distinct().collect()):  # one row for ten days of the calendar
        flat.where(F.col("part") == part).select("uid", "ts", "lin").repartition(4, "uid").write.parquet(f"{base}/in/{part + 100_000:06d}")
    stream = spark.readStream.schema("uid long, ts timestamp, lin double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    out_schema = "uid long, status string, first_us long, length int"
    state_schema = "start long, last long, length int, best long"  # microseconds, -1 for none

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, length, best = state.get if state.exists else (-1, -1, 0, -1)
        rows = pd.concat(list(parts)).sort_values("ts")
        micros = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        for t, over in zip(micros, (rows["lin"] >= 10 ** (level / 10)).tolist(), strict=True):
            if over:
                start, last, length = (t if length == 0 else start), t, length + 1
                if best < 0 and length >= n and last - start >= min_days * 86_400_000_000:
                    best = start
            else:
                start, last, length = -1, -1, 0
        state.update((start, last, length, best))
        status = "confirmed" if best >= 0 else "pending" if length >= n else "none"
        first = best if best >= 0 else start if length >= n else -1
        yield pd.DataFrame({"uid": [key[0]], "status": [status], "first_us": [first], "length": [length]}).astype({"length": "int32"})

    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _drain(stream.groupBy("uid").applyInPandasWithState(step, out_schema, state_schema, "update", GroupStateTimeout.NoTimeout), "update", f"{base}/out", f"{base}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    got = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return got.groupBy("uid").agg(F.max(F.struct("batch", "status", "first_us", "length")).alias("m")).select("uid", "m.status", F.when(F.col("m.first_us") >= 0, F.timestamp_micros("m.first_us")).alias("first"), "m.length")
