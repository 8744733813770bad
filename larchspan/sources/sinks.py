"""Writers: layers, dated layers, resumable years, GeoJSON lines, ledgers and snapshot digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def layers(df: DataFrame, path: str, layer: str = "layer") -> None:
    """One folder per layer; Spark's committer makes the write all or nothing."""
    df.write.mode("overwrite").partitionBy(layer).parquet(path)


def dated(df: DataFrame, path: str, ts: str = "ts") -> None:
    """One folder per date."""
    df.withColumn("date", F.to_date(ts)).write.mode("overwrite").partitionBy("date").parquet(path)


def years(df: DataFrame, path: str, year: str = "year") -> None:
    """Replaces only the years that `df` holds, so a stopped run goes on where it was."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path)


def missing_years(spark: SparkSession, path: str, wanted: list[int], year: str = "year") -> list[int]:
    """Years of `wanted` that are not there yet."""
    try:
        there = {r[0] for r in spark.read.parquet(path).select(year).distinct().collect()}  # a row a year
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = set()
    return [y for y in wanted if y not in there]


def box_feature(properties: list[str], x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    """A GeoJSON feature of a box."""
    corner = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def geojson_lines(df: DataFrame, path: str, properties: list[str]) -> None:
    df.select(box_feature(properties).alias("value")).write.mode("overwrite").text(path)


def tables(frames: dict[str, DataFrame], path: str, csv: bool = False) -> None:
    """One parquet (or CSV) table per name."""
    for name, df in frames.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{path}/{name}") if csv else w.parquet(f"{path}/{name}")


def append_ledger(df: DataFrame, path: str) -> None:
    """Append-only rows with the time of writing."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def snapshot(frames: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, digest: a digest of each table's rows that does not depend on their order."""
    out = None
    for name, df in sorted(frames.items()):
        h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        word = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(word), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def differences(want: DataFrame, have: DataFrame) -> DataFrame:
    """name, problem: tables that are missing, extra, or differ between two snapshots."""
    j = want.select("name", F.col("n_rows").alias("_n"), F.col("digest").alias("_d")).join(have, "name", "full")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("_d").isNull(), "extra").when(F.col("n_rows") != F.col("_n"), "rows differ").when(F.col("digest") != F.col("_d"), "values differ")
    return j.select("name", problem.alias("problem")).where("problem is not null")
