"""Helpers shared by the corpus operators.

Operators take a frame plus the names of the columns they need and select those columns first, so any
other column of the input, whatever its name, can neither clash with nor reach the result.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to Python: a batch by number of rows can hold a thousand very long texts.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the batches that this session sends to Python by their bytes; a smaller setting stays.

    Spark reads this from the session when the plan runs, after the operator has returned, so it stays set.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(key).lower().rstrip("b")
    # With a unit, as a session may set it, the setting is taken as meant.
    if held.isdigit() and int(held) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``id`` and ``data``: the UTF-8 bytes of the text, empty where it is null."""
    return small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Only a local session may do without the setting, in
    a folder of this machine; on a cluster that is refused, since executors would write to disks of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()  # type: ignore[return-value]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of the checkpoints."""
    return f"{_checkpoint_folder(spark)}/{uuid.uuid4()}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame, written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was stored, wherever the path leads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
