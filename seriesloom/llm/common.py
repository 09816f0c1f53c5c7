"""Small helpers the text operators share."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 256
HASHES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, never learned from; a row without an id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def share_of(key: Column, share: float) -> Column:
    """A fixed share of keys by hash, the same in every run."""
    return F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1_000_000)) < int(share * 1_000_000)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python by Arrow: few rows a batch keep its size bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not context.getCheckpointDir():
        shared = conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column end to end, and where each starts (one more at the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = (int(starts[0]), int(starts[-1])) if len(starts) else (0, 0)
    return whole[first:last], (starts - first if len(starts) else np.zeros(1, np.int64))


def keep_rows(docs: DataFrame, kept: DataFrame, *keys: tuple[Column, str]) -> DataFrame:
    """Rows of ``docs`` whose key columns, nulls too, occur in the columns of ``kept``."""
    on = None
    for left, right in keys:
        same = left.eqNullSafe(kept[right])
        on = same if on is None else on & same
    return docs.join(kept, on, "left_semi")


def thinned(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose long ``column`` is not in the only column of ``wanted``, before they are shuffled.

    The hashes of the wanted values take at most ``HASHES`` values, whatever the input, so they are broadcast.  Values
    that share a hash with a wanted one pass: an exact join has to follow.  Where the hashes are used up, all rows pass.
    """
    hashed = wanted.select(F.pmod(F.xxhash64(wanted.columns[0]), F.lit(HASHES)).alias("__hash")).distinct()
    return rows.join(F.broadcast(hashed), F.pmod(F.xxhash64(rows[column]), F.lit(HASHES)) == hashed["__hash"], "left_semi")
