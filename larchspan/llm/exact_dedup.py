"""Exact deduplication as a stateful stream with disk-backed keyed state that never expires.

1. Every row's normalised text (all of [\x20\x09-\x0D] deleted) is digested; (digest, doc_id, code points, content
   locator) goes to a table in the state's folder, under the batch's identifier.  The locator is the file and row number
   that the text was read from; rows that do not come straight from files are first written to the shared folder, so
   that they have one.
2. That table is read as a stream.  The state, in RocksDB without watermark or expiry, keeps per digest the row that
   stays (most code points, then smallest doc_id, then smallest locator), its locator, and how many rows it has met.
   Counts and the best row are combined within each task before the shuffle, so a hot digest sends one row per task.
3. Hits (digests of the batch with several rows) are verified on the full bytes: the batch's texts against each other
   and, where the digest was met in an earlier batch, against the text that a locator of then names, read from its
   file.  Texts that differ under one digest (collisions) are parted by their full bytes, now and in later batches.

A state folder can be used again: batches one after another give the rows that one run over all of them gives.  A batch
is written once under its identifier, which is `batch` or else a digest of its rows, and the stream reads a file once,
so repeating a batch, or resuming a broken run of it, changes nothing.

Groups are sent to all tasks as a broadcast while there are at most `BROADCAST_ROWS` of them; beyond that only groups of
at least `HOT_ROWS` rows are, and the other rows meet theirs by a shuffle, so no key of it has more rows than that.

Defined cases: null text counts as empty, and all empty or blank texts are equal; ties go to the smallest doc_id (a null
doc_id is larger than any), then the smallest locator, so of rows that repeat one doc_id one is kept; an empty table
gives an empty result; columns of any name (`_metadata`, `file`, `digest` ...) pass through `keep_best` as they are.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larchspan.llm.common import free_names
from larchspan.session import discard, exists, scratch

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",  # state goes to disk early: many partitions share an executor
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # state of a query that has ended is unloaded soon
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition claims megabytes in advance
}
BROADCAST_ROWS = 100_000
HOT_ROWS = 1000
_TABLE = "digest string, doc_id long, points long, file string, row long"


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digest(text: Column, bits: int = 256) -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes; fewer bits only to provoke collisions in tests."""
    full = F.sha2(normalised(text).cast("binary"), 256)
    return full if bits == 256 else F.substring(full, 1, bits // 4)


#: Plan nodes that hand on some of a file's rows as they are.
_PLAIN = frozenset(("Project", "Filter", "SubqueryAlias", "LogicalRelation"))


def _straight(docs: DataFrame, column: str) -> bool:
    """Is each row of `docs` one row of a file, and `column` that file's own?"""
    node = docs.select(docs[column])._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    want = node.output().apply(0).exprId().id()
    while node.nodeName() in _PLAIN:
        if not node.children().size():
            own = node.output()
            return want in {own.apply(i).exprId().id() for i in range(own.size())}
        node = node.children().head()
    return False


def located(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """`docs` with two more columns, whose names follow: the file and the row in it that hold each row's text."""
    file, row = free_names(docs, "_file", "_row")
    if _straight(docs, text_col):
        try:
            place = docs.metadataColumn("_metadata")
            return docs.select("*", place.getField("file_path").alias(file), place.getField("row_index").alias(row)), file, row
        except AnalysisException:  # files of a kind that has no row numbers
            pass
    path = scratch(docs.sparkSession, "rows")
    docs.write.parquet(path)
    again = docs.sparkSession.read.schema(docs.schema).parquet(path)
    place = again.metadataColumn("_metadata")
    return again.select("*", place.getField("file_path").alias(file), place.getField("row_index").alias(row)), file, row


def _order(points: str = "points", doc: str = "doc_id") -> Column:
    """The row that stays has the smallest such struct."""
    return F.struct((-F.col(points)).alias("less"), F.col(doc).isNull().alias("none"), F.col(doc).alias("doc_id"), F.col("file"), F.col("row"))


def stream_groups(spark: SparkSession, table: str, state_dir: str, files_per_batch: int = 2000) -> DataFrame:
    """Runs the stream over the files of `table` to its end -> (digest, best, n): the state of every digest met."""
    held = {k: spark.conf.get(k, None) for k in _STATE}
    updates = f"{state_dir}/updates"
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(_TABLE).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(table)
        groups = source.groupBy("digest").agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("n"))

        def write(batch: DataFrame, number: int) -> None:
            # a batch that is run again after a failure overwrites its own folder
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number:09d}")

        query = groups.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    schema = "digest string, best struct<less:long,none:boolean,doc_id:long,file:string,row:long>, n long"
    try:
        found = spark.read.option("basePath", updates).parquet(updates)
    except AnalysisException:  # no row at all
        return spark.createDataFrame([], schema)
    # the last update of a digest is its state
    return found.groupBy("digest").agg(F.max(F.struct("batch", "n", "best")).alias("u")).select("digest", "u.best", "u.n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, batch: str | None = None, bits: int = 256, files_per_batch: int = 2000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, row: one row per row of all batches of the state.

    `state_dir` names a state to go on with (with the same `text_col`); without it the state is new.
    """
    return _resolved(*located(docs, text_col), id_col, text_col, state_dir, batch, bits, files_per_batch)


def _rows(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(_TABLE).option("recursiveFileLookup", "true").parquet(*paths)


def _texts(spark: SparkSession, rows: DataFrame, text_col: str) -> DataFrame:
    """`rows` (with file, row) with `norm`, the normalised text that the locator names."""
    files = [r[0] for r in rows.select("file").distinct().collect()]  # the files of the input, which Spark lists to read it
    if not files:
        return rows.withColumn("norm", F.lit(None).cast("string"))
    held = spark.read.parquet(*files)
    place = held.metadataColumn("_metadata")
    held = held.select(place.getField("file_path").alias("file"), place.getField("row_index").alias("row"), normalised(held[text_col].cast("string")).alias("norm"))
    return held.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, ["file", "row"])


def _written(placed: DataFrame, table: str, batch: str | None, fixed: bool) -> str:
    """Writes a batch's rows into the table once -> the folder they are in."""
    spark = placed.sparkSession
    if batch is not None or not fixed:
        folder = f"{table}/b-{batch or 0}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            placed.write.mode("overwrite").parquet(folder)
        return folder
    aside = f"{table}/_{uuid.uuid4().hex}"  # Spark's readers pass over such names
    placed.write.parquet(aside)
    mark = F.xxhash64("digest", "doc_id", "points").cast("decimal(38,0)")
    n, total = _rows(spark, aside).agg(F.count(F.lit(1)), F.sum(mark)).first()
    folder = f"{table}/b-{n}-{total or 0}"
    if exists(spark, folder):
        discard(spark, aside)
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.rename(path(aside), path(folder)):
            raise OSError(f"cannot rename {aside}")
    return folder


def _matched(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """`rows` with best and n of their group; NULL for rows without a copy."""
    if hits.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(hits), "digest", "left")
    hot = hits.where(F.col("n") >= HOT_ROWS)
    if hot.count() > BROADCAST_ROWS:
        return rows.join(hits, "digest", "left")
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(hits.where(F.col("n") < HOT_ROWS), "digest", "left")
    return cold.unionByName(rows.join(F.broadcast(hot), "digest"))


def _resolved(placed: DataFrame, file: str, row: str, id_col: str, text_col: str, state_dir: str | None, batch: str | None, bits: int, files_per_batch: int) -> DataFrame:
    spark = placed.sparkSession
    fixed, state_dir = state_dir is not None, state_dir or scratch(spark, "dedup")
    text = placed[text_col].cast("string")
    own = placed.select(digest(text, bits).alias("digest"), placed[id_col].cast("long").alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"), F.col(file).alias("file"), F.col(row).alias("row"))
    folder = _written(own, f"{state_dir}/rows", batch, fixed)
    groups = stream_groups(spark, f"{state_dir}/rows", state_dir, files_per_batch)
    hits, rows = groups.where("n > 1"), _rows(spark, f"{state_dir}/rows")
    earlier = rows.where(~F.col("_metadata.file_path").contains(folder.rsplit("/", 1)[1] + "/")) if fixed else None
    _collisions(placed, text, hits, earlier, text_col, bits).write.mode("overwrite").parquet(f"{state_dir}/odd/{folder.rsplit('/', 1)[1]}")
    odd = spark.read.schema("digest string").option("recursiveFileLookup", "true").parquet(f"{state_dir}/odd").distinct()
    stays = F.coalesce((F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row")), F.lit(True))
    whole = _matched(rows, hits).select("digest", "doc_id", "file", "row", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"))
    if bits == 256 and not odd.take(1):
        return whole.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "file", "row")
    # digests that stand for several texts: their rows are grouped by the full bytes instead
    full = _texts(spark, rows.join(odd, "digest", "left_semi"), text_col)
    parted = full.groupBy("norm").agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("n"))
    again = full.join(parted, "norm").select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "file", "row")
    sure = whole.join(odd, "digest", "left_anti")
    if bits != 256:
        sure = _texts(spark, sure, text_col).withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))
    return sure.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "file", "row").unionByName(again)


def _collisions(placed: DataFrame, text: Column, hits: DataFrame, earlier: DataFrame | None, text_col: str, bits: int) -> DataFrame:
    """(digest) of hits whose texts in this batch are not all the same, or not the same as a text of an earlier batch.

    Smallest and largest bytes of a digest are equal just if all its texts are; both are combined within each task
    before the shuffle, so a hot group sends one text per task, not one per row.
    """
    few = hits.count() <= BROADCAST_ROWS
    keys = F.broadcast(hits.select("digest")) if few else hits.select("digest")
    own = placed.select(digest(text, bits).alias("digest"), normalised(text).alias("norm")).join(keys, "digest", "left_semi")
    spread = own.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    differ = F.col("low") != F.col("high")
    if earlier is not None:
        met = earlier.join(keys, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("file", "row")).alias("at")).select("digest", "at.file", "at.row")
        met = _texts(placed.sparkSession, met, text_col).select("digest", F.col("norm").alias("before"))
        spread = spread.join(met, "digest", "left")
        differ = differ | F.coalesce(F.col("before") != F.col("low"), F.lit(False))
    return spread.where(differ).select("digest")


def keep_best(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    placed, file, row = located(docs, text_col)
    state = scratch(docs.sparkSession, "dedup")
    gone = _resolved(placed, file, row, id_col, text_col, state, "0", 256, 2000).where(~F.col("kept")).select("file", "row")
    kept = without(placed, file, row, gone, f"{state}-gone").select(*[placed[c] for c in docs.columns])
    discard(docs.sparkSession, state)
    return kept


def without(placed: DataFrame, file: str, row: str, gone: DataFrame, path: str) -> DataFrame:
    """`placed` less the rows that `gone` (file, row) names; `gone` is written to `path`."""
    at, nth = free_names(placed, "_gone_file", "_gone_row")
    gone.select(F.col("file").alias(at), F.col("row").alias(nth)).write.parquet(path)
    gone = placed.sparkSession.read.schema(f"{at} string, {nth} long").parquet(path)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return placed.join(gone, (placed[file] == gone[at]) & (placed[row] == gone[nth]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
