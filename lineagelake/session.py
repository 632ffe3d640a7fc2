"""Small helpers around the session: reading tables, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, in the one that spark.checkpoint.dir names.

    Only where the session names none (tests, local mode) is a folder of our own set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        conf = sc.getConf().get("spark.checkpoint.dir")
        if conf is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="lineagelake-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder.

    A checkpoint keeps the estimate of its plan's size, and a join multiplies estimates, so
    over the rounds of a loop they grow to numbers of millions of digits that take the
    driver minutes to multiply. A table has its files' size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing is read from any more: a loop's, once
    the next round is stored."""
    for df in tables:
        if path := _PLACES.pop(df, None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def own_exchange(df: DataFrame, *keys: str) -> DataFrame:
    """Recompute integer keys so that a following join shuffles this side by itself.

    An aggregate keeps its hash partitioning, and a join that reuses it cannot be
    split by AQE when the other side has a hot key. The aggregate is the small side,
    so its second shuffle costs little, and the hot key is then split.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})
