"""What the operators share: the input table, Arrow batches of bounded size, digests.

Long jobs cut their lineage with ``materialize``: a table in ``spark.checkpoint.dir``,
read back, so that a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.tables import materialize, shared_dir, unused

__all__ = ["documents", "materialize", "sha256_hex", "shared_dir", "small_batches", "unused"]

#: Rows of an Arrow batch at most: with texts, more only cost memory on both sides.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are held to BATCH_ROWS rows."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256_hex(text):
    """Lower-case hex SHA-256 of a string column's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
