"""Helpers shared by the operators: table access, the shared folder, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
SLICE_BYTES = 8_000_000


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the Python workers of the session's application, once."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(full := os.path.join(at, name), os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._llm_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a temporary folder is set for this session; that is
    right only in local mode, so any other master raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder; what was shuffled on the way there is released at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return written(df, name, "zstd")
    finally:
        conf.set(key, before)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (local path, ``file:``, ``hdfs:``, ``s3:`` ...) and its path there."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most`` bytes at most; no row is split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        cut = (np.cumsum(lengths, dtype=np.int64) - lengths) // most
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as large strings, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(col.cast(pa.large_string()), "")


def crc_bucket(key: str, buckets: int):
    """crc32 of the key as text, modulo ``buckets``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % buckets


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; whatever else the table holds cannot clash."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()))


def schema_with(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns at the end."""
    more = T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])


#: Up to so many ids (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (one column of that name, distinct, stored).

    The ids are counted: a number that surely fits every executor is broadcast, so that the
    rows of ``df`` need not move; otherwise both sides are shuffled.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")
