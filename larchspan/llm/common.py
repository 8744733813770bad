"""What the text operators share: bounded batches of rows, ASCII-only tokens, word tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larchspan.session import checkpointed

#: The characters of [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the identifier and the text, under fixed names, whatever else `docs` has; in small Arrow batches."""
    docs = small_batches(docs)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def rows(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Lists of identifiers and of UTF-8 texts (None where null) from batches whose first two columns are these.

    A list ends once its texts exceed `limit` bytes, so memory depends on one text at most beyond that.
    """
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            b = t.as_py()
            ids.append(i)
            texts.append(b)
            size += len(b) if b else 0
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text; bytes.split() splits at just these characters."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """As words(), with A-Z in lower case (bytes.lower() leaves other characters alone)."""
    return text.lower().split() if text else []


class Numbering(dict):
    """Word -> 0, 1, 2 ... in order of first use.  (Holds no reference to itself, so it is freed as soon as it is dropped.)"""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def ids(self, tokens: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after another, and where each text begins (one more entry at the end)."""
        starts = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=starts[1:])
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), np.int64, int(starts[-1]))
        return flat, starts


def per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of `values` over each row's slice; empty slices give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def small_batches(docs: DataFrame, most: int = 1000) -> DataFrame:
    """`docs` in a session of its own whose Arrow batches have at most `most` rows: a batch of whole texts is held by the
    executor and by the Python worker at once.  The session is a copy of the caller's, whose settings stay as they are."""
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession
    if 0 < int(spark.conf.get(name)) <= most:
        return docs
    return moved(docs, session_with(spark, name, str(most)))


def session_with(spark: SparkSession, name: str, value: str) -> SparkSession:
    """A copy of a session with one setting of its own."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(name, value)
    return own


def moved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """`df` in another session."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


def checkpointed_alone(df: DataFrame) -> DataFrame:
    """`df` checkpointed, and the shuffle files that this took removed as it ends, not when the driver collects garbage."""
    own = session_with(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return moved(checkpointed(moved(df, own)), df.sparkSession)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many "_" behind it as it takes to be unlike every column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the identifier written as text; a null identifier counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of uint64 values (multiply and xor-shift, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
