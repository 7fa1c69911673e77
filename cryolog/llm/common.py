"""What the operators of this subpackage share: the shared folder, tables written there, keys of documents."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local session without one, as in tests, gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cryolog-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: keep an Arrow batch to some megabytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(docs: DataFrame, bytes_each: int, column: str = "text") -> int:
    """How many parts hold the texts of ``docs`` at about ``bytes_each`` bytes each."""
    return max(1, math.ceil(text_bytes(docs, column) / bytes_each))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a row, null-safe as a join key: repeated rows share it, and whatever is found for one holds for all."""
    return [F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("_id"), F.xxhash64(doc_id, text).alias("_row")]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as the struct _doc beside its row key, so that no column of it can clash."""
    return docs.select(F.struct("*").alias("_doc"), *row_key())


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its length, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
