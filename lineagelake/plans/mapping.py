"""How the given tables stand for the engine's inputs.

Suppliers are references with an address of region, nation and their own key; line items
are hits of reads (orders) on one of four sequences of a supplier; documents are sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.config import LEVELS
from lineagelake.functions import barcode
from lineagelake.session import checkpoint, table


def _length(tax: str, slot: str) -> str:
    return f"CASE WHEN {slot} = 0 AND {tax} % 5 = 0 THEN 400 ELSE 5000 + ({tax} * 7919 + {slot} * 104729) % 45001 END"


HITS_COLUMNS = f"""l_orderkey AS read_id, l_suppkey AS tax_id, l_suppkey * 4 + l_partkey % 4 AS seq_id,
    CAST(floor(l_extendedprice) AS BIGINT) % ({_length('l_suppkey', '(l_partkey % 4)')}) AS site,
    round(100 * l_tax) AS mut, l_quantity + 50 AS nom, CAST(l_linenumber AS BIGINT) AS ord"""
SEQINFO_COLUMNS = f"s_suppkey * 4 + slot AS seq_id, CAST({_length('s_suppkey', 'slot')} AS BIGINT) AS seq_len, s_suppkey AS tax_id"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[x.strip() for x in _split(HITS_COLUMNS)])


def _split(columns: str) -> list[str]:
    """Columns of a select list, commas inside brackets left alone."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def seqinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    return slots.selectExpr(*[x.strip() for x in _split(SEQINFO_COLUMNS)])


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    # Cut here: eight names of one column would double Catalyst's constraints eight times.
    return checkpoint(both.select(key.alias("tax_id"), F.col("n_regionkey").cast("long").alias("u"), F.col("s_nationkey").cast("long").alias("s"), *[key.alias(x) for x in LEVELS[2:]]))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a catalogue: index, size, barcode, levels, superkingdom, species."""
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kingdom = F.when(F.col("r_name") == "AFRICA", "Bacteria").when(F.col("r_name") == "AMERICA", "Archaea").when(F.col("r_name") == "ASIA", "Viruses").when(F.col("r_name") == "EUROPE", "Eukaryota")
    placed = names.select(F.col("s_suppkey").alias("index"), F.round(F.col("s_acctbal") * 10_000).cast("long").alias("size"), kingdom.alias("superkingdom"), F.col("r_name").alias("region"), F.col("s_name").alias("species"))
    whole = placed.join(addresses(spark, sf_dir), F.col("index") == F.col("tax_id")).drop("tax_id")
    return whole.withColumn("barcode", barcode.build([F.col(x) for x in LEVELS]))
