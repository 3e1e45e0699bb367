"""Tables in the folder that every executor can reach, to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


#: A key with more than this part of all rows is joined where the rows lie.
HOT_PART = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names, or a new local one where a single machine runs all of Spark.

    On a cluster a folder of one machine would lose rows, so a session without
    ``spark.checkpoint.dir`` is an error there.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors reach")
        named = "file://" + tempfile.mkdtemp(prefix="chronicle-")
        spark.conf.set(CHECKPOINT_DIR, named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    The table stays for as long as the session keeps the folder: a lost executor or a
    later action may read it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_split(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has a row for each key.

    ``weight`` is at least the number of a key's rows, and all weights sum to ``total`` at
    most, so fewer than HOT_PART keys have more than that part of it: they are sent to where
    their rows lie, and only the others meet by a shuffle.
    """
    hot = F.col(weight) * HOT_PART > total
    few = side.where(hot)
    met = rows.join(F.broadcast(few), key)  # fewer than HOT_PART rows
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(side.where(~hot), key)
    return met.unionByName(rest)
