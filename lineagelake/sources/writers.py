"""Writers: tables as tab-separated text, reads, assignments, profiles, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.sources.versioned import VersionedTable


def tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def catalog(df: DataFrame, path: str, after: int | None = None) -> int:
    """The catalogue as a new version, whole or not at all; returns its number. after: the
    version it was made from, for writers that may meet."""
    return VersionedTable(df.sparkSession, path).commit(df.withColumn("is_deleted", F.col("deleted").isNotNull()), ("is_deleted",), append=False, after=after)


def sketches(df: DataFrame, path: str) -> None:
    """Append to the sketch index, laid out by size bucket so that a search reads few."""
    df.write.mode("append").partitionBy("bucket").parquet(path)


def mapping(members: DataFrame, sequences: DataFrame, path: str, append: bool = False) -> None:
    """A mapping database's members (mapdb, shard, tax_id) and sequences (mapdb, shard,
    seq_name, tax_id). Sequences come first; members, which readers start from, name a shard
    only once its sequences are there. A write that fails leaves the version before."""
    spark = members.sparkSession
    VersionedTable(spark, f"{path}/sequences").commit(sequences, ("mapdb", "shard"), append)
    VersionedTable(spark, f"{path}/members").commit(members, ("mapdb", "shard"), append)


def hits(df: DataFrame, path: str) -> None:
    df.write.option("maxRecordsPerFile", 20_000_000).parquet(path)


def assignments(reads: DataFrame, assigned: DataFrame, path: str) -> None:
    """A line for each read; those without a match have their id and name only."""
    hit = F.struct((-F.col("prop")).alias("o"), F.format_string("%d:%.2f:%.2f:%.2f", "tax_id", "prop", "dist", "mean_dist").alias("s"))
    by = assigned.groupBy("read_id").agg(F.first("depth_w").alias("d"), F.first("core_w").alias("c"), F.array_sort(F.collect_list(hit)).alias("h"))
    rows = reads.select("read_id", "read_name").join(by, "read_id", "left")
    tail = F.concat_ws("\t", F.format_string("%.5f", "d"), F.format_string("%.5f", "c"), F.array_join(F.transform("h", lambda x: x["s"]), "\t"))
    line = F.concat_ws("\t", F.col("read_id").cast("string"), "read_name", F.when(F.col("h").isNotNull(), tail))
    rows.select(line.alias("value")).write.option("compression", "gzip").text(path)


def fastq(reads: DataFrame, chosen: DataFrame, path: str) -> None:
    """Chosen reads (read_id, first_tax), their names with id and first reference."""
    rows = reads.join(chosen, "read_id")
    text = F.concat(F.lit("@"), F.concat_ws(" ", "read_name", F.col("read_id").cast("string"), F.col("first_tax").cast("string")), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    rows.select(text.alias("value")).write.option("compression", "gzip").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)
