"""Readers of the text formats: lists, taxonomy dumps, reads, alignments, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagelake.operators.catalog import active
from lineagelake.sources.versioned import VersionedTable


def genome_list(spark: SparkSession, path: str, blank: str | None = None) -> DataFrame:
    """Tab-separated list with a header; lines before it have no tab. `na` is null (or
    `blank`, for lists of updates, where it means no change); # in column names falls away."""
    lines = spark.read.text(path)
    head = lines.where(F.contains("value", F.lit("\t"))).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = [x.lstrip("# ").strip() for x in head[0].split("\t")]
    part = F.split("value", "\t", -1)
    clean = lambda c: F.when(c.isin("na", ""), F.lit(blank)).otherwise(c)
    rows = lines.where(F.contains("value", F.lit("\t")) & (F.col("value") != head[0]) & ~F.startswith("value", F.lit("#")))
    return rows.select(*[clean(F.get(part, F.lit(i))).alias(n) for i, n in enumerate(names)])


def catalog(spark: SparkSession, path: str, version: int | None = None, include_deleted: bool = False) -> DataFrame:
    """A catalogue that writers.catalog wrote, as of a version; rows marked as deleted only if asked for."""
    return active(VersionedTable(spark, path).read(version).drop("is_deleted"), include_deleted)


def mapping(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, sequences) that writers.mapping wrote."""
    return VersionedTable(spark, f"{path}/members").read(), VersionedTable(spark, f"{path}/sequences").read()


def taxonomy_names(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t", -1)
    return spark.read.text(path).select(p[0].cast("long").alias("taxid"), p[2].alias("name"), p[6].alias("name_class"))


def taxonomy_nodes(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t", -1)
    return spark.read.text(path).select(p[0].cast("long").alias("taxid"), p[2].cast("long").alias("parent"), p[4].alias("rank"))


def _placed(lines: DataFrame) -> DataFrame:
    """lines (value) with n, numbers from 0 in file order: places within partitions, and the
    partitions' sizes added up. No task sees all lines."""
    lines = lines.select("value", F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_part"))
    sizes = lines.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(F.broadcast(sizes.select("_part", "_first", before.alias("_before"))), "_part").select((F.col("_at") - F.col("_first") + F.col("_before")).alias("n"), "value")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines numbered from 0 in file order; plain or gzip, one file."""
    return _placed(spark.read.text(path))


def fastq(spark: SparkSession, path: str, mate: int = 1) -> DataFrame:
    """read_id (from 0, in file order), read_name, mate, seq, qual."""
    rows = _numbered(spark, path).withColumn("read_id", F.floor(F.col("n") / 4).cast("long"))
    line = lambda i: F.max(F.when(F.col("n") % 4 == i, F.col("value")))
    return rows.groupBy("read_id").agg(line(0).alias("h"), line(1).alias("seq"), line(3).alias("qual")).select("read_id", F.split(F.substring("h", 2, 1 << 20), r"\s")[0].alias("read_name"), F.lit(mate).alias("mate"), "seq", "qual")


def fasta(spark: SparkSession, path: str, mate: int = 1) -> DataFrame:
    """The same columns of FASTA, whose sequences may be wrapped; quality H throughout. A
    record is what stands between two `>` at line starts, however long."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    rows = _placed(raw).withColumnRenamed("n", "read_id")
    head = F.regexp_extract("value", r"^[^\s]*", 0)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select("read_id", head.alias("read_name"), F.lit(mate).alias("mate"), seq.alias("seq"), F.repeat(F.lit("H"), F.length(seq)).alias("qual"))


def fasta_names(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.startswith("value", F.lit(">")))
    return lines.select(F.regexp_extract("value", r"^>(\S*)", 1).alias("seq_name"), F.input_file_name().alias("file"))


def sam(spark: SparkSession, path: str, dialect: str = "short") -> tuple[DataFrame, DataFrame]:
    """(alignments for alignment.from_sam, sequences (ref, seq_len)). In the `long` dialect
    names end at |tax and the score stands one column later."""
    lines = _numbered(spark, path)
    p = F.split("value", "\t", -1)
    name = (lambda c: F.regexp_replace(c, r"\|tax.*$", "")) if dialect == "long" else (lambda c: c)
    head = lines.where(F.startswith("value", F.lit("@SQ"))).select(name(F.regexp_extract("value", r"\tSN:([^\t]*)", 1)).alias("ref"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("seq_len"))
    score: Column = F.element_at(F.split(F.get(p, F.lit(14 if dialect == "long" else 13)), ":"), -1).try_cast("double")
    rows = lines.where(~F.startswith("value", F.lit("@"))).select(
        F.col("n").alias("ord"), p[0].cast("long").alias("read_id"), p[1].cast("int").alias("flag"), F.when(p[1].cast("int").bitwiseAND(F.lit(128)) > 0, 2).otherwise(1).alias("mate"),
        name(p[2]).alias("ref"), p[3].cast("long").alias("pos"), p[5].alias("cigar"), p[9].alias("seq"), score.alias("score"),
    )
    return rows, head


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """read_id, read_name, depth_w, core_w and hits (tax_id, prop, dist, mean_dist) of an
    assignment file; reads without a match have nulls and no hits."""
    p = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(p.alias("p"))
    hits = F.transform(F.slice("p", F.lit(5), F.greatest(F.size("p") - 4, F.lit(0))), lambda x: F.struct(F.split(x, ":")[0].cast("long").alias("tax_id"), F.split(x, ":")[1].cast("double").alias("prop"), F.split(x, ":")[2].cast("double").alias("dist"), F.split(x, ":")[3].cast("double").alias("mean_dist")))
    return rows.select(F.col("p")[0].cast("long").alias("read_id"), F.col("p")[1].alias("read_name"), F.get("p", F.lit(2)).cast("double").alias("depth_w"), F.get("p", F.lit(3)).cast("double").alias("core_w"), hits.alias("hits"))


def profiles(spark: SparkSession, *paths: str) -> DataFrame:
    """(sample, grp, pct_total, pct_matched, taxon, n_total, n_found) of profile files, or of
    all profile.txt below folders; a sample is its file's folder."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "profile.txt").text(list(paths)).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("sample"), F.split("value", "\t").alias("p"))
    total = lines.where(F.col("p")[0] == "Total").select("sample", F.col("p")[1].cast("long").alias("n_total"), F.col("p")[2].cast("double").alias("n_found"))
    rows = lines.where(F.size("p") == 4)
    return rows.select("sample", F.col("p")[0].alias("grp"), F.col("p")[1].cast("double").alias("pct_total"), F.col("p")[2].cast("double").alias("pct_matched"), F.regexp_replace(F.col("p")[3], r" \([^(]*\)$", "").alias("taxon")).join(F.broadcast(total), "sample")


def rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, label) of a rule file; without a label, `*`. A rule file is written by hand,
    and read whole."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(p[0].alias("p"), F.coalesce(F.nullif(F.get(p, F.lit(1)), F.lit("")), F.lit("*")).alias("l"))
    return [(r.p, r.l) for r in rows.collect()]
