"""Truth sets for evaluation: what each simulated read is, rank by rank, and how well it was told."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.operators import profile
from lineagelake.operators.catalog import closure
from lineagelake.session import stored

# The ranks that evaluation compares, and for each dialect of read tables the
# header lines, the read's column and the column that tells where it comes from.
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")
KINDS = ("true", "wrong", "missed", "spurious", "none")
DIALECTS = {"CAMI": (4, 0, 2), "KEGG": (1, 1, 1), "NCBI": (1, 1, 1)}


def rank_ids(nodes: DataFrame, merged: DataFrame | None = None, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """nodes (id, parent, rank), merged (old, new): (taxid, an id for each rank), 0 where the
    taxid has no ancestor of that rank (itself included). Ids that were merged into others
    have the ranks of these."""
    ranked = nodes.where(F.col("rank").isin(*ranks)).select(F.col("id").alias("ancestor"), "rank")
    above = closure(nodes.select("id", "parent")).join(ranked, "ancestor")
    nearest = [F.min(F.when(F.col("rank") == r, F.struct("depth", "ancestor")))["ancestor"].alias(f"_{r}") for r in ranks]
    found = nodes.select("id").join(above.groupBy("id").agg(*nearest), "id", "left")
    out = found.select(F.col("id").alias("taxid"), *[F.coalesce(f"_{r}", F.lit(0)).alias(r) for r in ranks])
    if merged is None:
        return out
    old = merged.join(out, F.col("new") == F.col("taxid")).select(F.col("old").alias("taxid"), *ranks)
    return out.unionByName(old.join(out.select("taxid"), "taxid", "left_anti"))


def code_of(origin: Column, dialect: str) -> Column:
    """What a read table tells of a read's origin: a taxid, an organism's code of three
    letters, or an accession without its version."""
    if dialect == "CAMI":
        return origin
    return F.substring(origin, 1, 3) if dialect == "KEGG" else F.substring_index(origin, ".", 1)


def read_table(spark: SparkSession, path: str, dialect: str, codes: DataFrame | None = None) -> DataFrame:
    """(read, taxid) of a tab-separated read table, plain or gzip. codes (code, taxid) tells
    what the codes of KEGG and NCBI tables stand for; reads of other codes have a null taxid."""
    header, read, origin = DIALECTS[dialect]
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    # Header lines are the first of the file, which are in its first partition.
    p = F.split("value", "\t", -1)
    rows = lines.where((F.col("_at") >= header) & (F.col("value") != "")).select(F.get(p, F.lit(read)).alias("read"), code_of(F.get(p, F.lit(origin)), dialect).alias("code"))
    if dialect == "CAMI":
        return rows.select("read", F.col("code").try_cast("long").alias("taxid"))
    if codes is None:
        raise ValueError(f"{dialect} tables need codes")
    known = codes.groupBy("code").agg(F.min("taxid").cast("long").alias("taxid"))
    return rows.join(known, "code", "left").select("read", "taxid")


def truth(reads: DataFrame, ranked: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """reads (read, taxid): (read, an id for each rank as text), 0 where nothing is known."""
    both = reads.join(ranked, "taxid", "left")
    return both.select("read", *[F.coalesce(F.col(r), F.lit(0)).cast("string").alias(r) for r in ranks])


def _votes(members: DataFrame) -> DataFrame:
    """(grp, informal, taxid): the species that each group votes for."""
    named = members.select("grp", "unit", F.concat(F.when(F.col("formal"), "").otherwise("*"), F.col("taxid").cast("string")).alias("species"))
    votes = profile.species_vote(named, "grp", "unit", "species")
    return votes.select("grp", F.startswith("species", F.lit("*")).alias("informal"), F.regexp_replace("species", r"^\*", "").cast("long").alias("taxid"))


def predicted(assigned: DataFrame, members: DataFrame, ranked: DataFrame, ranks: tuple[str, ...] = RANKS, least: float = 0.8) -> DataFrame:
    """assigned (read_id, tax_id, prop, dist, mean_dist), members (tax_id, grp, unit, taxid,
    formal): (read, ids for each rank as text), by the species that the group of each
    reference votes for (profile.species_vote), handed to profile.interpret.

    Of the species that a group votes for each counts with the reference's share of the read;
    an informal one is told at ranks above species alone."""
    told = members.select("tax_id", "grp").distinct().join(_votes(members), "grp").drop("grp")
    rows = assigned.where("tax_id <> -1").join(told, "tax_id").join(ranked, "taxid", "left")
    return profile.interpret(rows.select("read_id", "prop", "dist", "mean_dist", "informal", *ranks), list(ranks), least).withColumnRenamed("read_id", "read")


def rank_scores(truths: DataFrame, guesses: DataFrame, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """profile.scores for each rank over the reads that both have: rank and its columns."""
    both = truths.select("read", *[F.col(r).alias(f"t_{r}") for r in ranks]).join(guesses.select("read", *[F.col(r).alias(f"p_{r}") for r in ranks]), "read")
    parts = [profile.scores(both.select(F.col(f"t_{r}").alias("truth"), F.col(f"p_{r}").alias("predicted"))).select(F.lit(r).alias("rank"), "*") for r in ranks]
    return reduce(DataFrame.unionByName, parts)


def graded(truths: DataFrame, assigned: DataFrame, members: DataFrame, ranked: DataFrame, ranks: tuple[str, ...] = RANKS, least: float = 0.8) -> DataFrame:
    """rank_scores(truths, predicted(assigned, members, ranked, ranks, least), ranks) for
    truths of one id a rank, without a row for each hit and species of its group.

    Of a group it counts how many of its species stand for an id, near (below 5 % of
    distance), less near (below 10 %) and far. Ids that count alike in all groups share a class,
    and a read's hits are added up by class. The classes by group travel to the tasks as
    arrays: a group's species are one class where no other group votes for them."""
    votes = _votes(members).join(ranked, "taxid", "left")
    far = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("far")

    def known(r: str) -> Column:
        unknown = {"species": (F.col("far") > 0) | F.col("informal"), "genus": F.col("far") > 1}.get(r, F.lit(False))
        return F.struct(F.lit(ranks.index(r)).alias("i"), F.when(unknown, 0).otherwise(F.coalesce(F.col(r), F.lit(0))).cast("long").alias("id"))

    each = votes.select("*", far).select("grp", "far", F.explode(F.array(*[known(r) for r in ranks])).alias("x"))
    counts = stored(each.groupBy("x.i", "x.id", "grp", "far").agg(F.count("*").cast("double").alias("n")))
    of_id = counts.groupBy("i", "id").agg(F.sort_array(F.collect_list(F.struct("grp", "far", "n"))).alias("v"))
    # What is unknown is a class of its own at each rank.
    kinds = stored(of_id.groupBy("i", "v", (F.col("id") == 0).alias("zero")).agg(F.min("id").alias("c"), F.collect_list("id").alias("ids")))
    rows = sorted((r.grp, r.far, r.i, r.c, r.n) for r in kinds.select("i", "c", F.explode("v").alias("x")).select("i", "c", "x.*").collect())
    names = sorted({(i, c) for _, _, i, c, _ in rows})
    number = {x: k for k, x in enumerate(names)}
    cells = sorted({(g, f) for g, f, _, _, _ in rows})
    at = {x: k for k, x in enumerate(cells)}
    entry = np.array([at[g, f] for g, f, _, _, _ in rows], np.int64)
    begin = np.searchsorted(entry, np.arange(len(cells) + 1))
    column, times = np.array([number[i, c] for _, _, i, c, _ in rows], np.int64), np.array([n for *_, n in rows])
    rank = np.array([i for i, _ in names], np.int64)
    zero = np.array([c == 0 for _, c in names], bool)
    codes = F.broadcast(assigned.sparkSession.createDataFrame([(g, f, k) for (g, f), k in at.items()], "grp long, far int, cell long"))
    classes = assigned.sparkSession.createDataFrame([(i, c, k) for (i, c), k in number.items()], "i int, c long, k long")

    d = F.greatest("dist", "mean_dist")
    near = assigned.where("tax_id <> -1").select("read_id", "tax_id", "prop", F.when(d >= 10, 2).when(d >= 5, 1).otherwise(0).alias("far"))
    hits = near.join(members.select("tax_id", F.col("grp").cast("long").alias("grp")).distinct(), "tax_id").join(codes, ["grp", "far"])
    reads = hits.groupBy("read_id").agg(F.collect_list("cell").alias("cells"), F.collect_list("prop").alias("props"))
    told = truths.select(F.col("read").alias("read_id"), *[F.col(r).cast("long").alias(f"t_{r}") for r in ranks])
    of_class = kinds.select("i", "c", F.explode("ids").alias("id")).join(F.broadcast(classes), ["i", "c"])
    for i, r in enumerate(ranks):
        told = told.join(of_class.where(F.col("i") == i).select(F.col("id").alias(f"t_{r}"), F.col("k").alias(f"k_{r}")), f"t_{r}", "left")
    truth_of = told.select("read_id", F.array(*[F.when(F.col(f"t_{r}") == 0, -2).otherwise(F.coalesce(f"k_{r}", F.lit(-1))).cast("long") for r in ranks]).alias("truths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ranks), 5), np.int64)
        for whole in batches:
            for start in range(0, len(whole), 4096):
                b = whole.slice(start, 4096)
                cell, prop = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
                read = np.repeat(np.arange(len(b)), np.diff(b.column(0).offsets.to_numpy()))
                size = begin[cell + 1] - begin[cell]
                place = np.repeat(begin[cell] - np.cumsum(size) + size, size) + np.arange(size.sum())
                slot = np.repeat(read, size) * len(names) + column[place]
                used, slot = np.unique(slot, return_inverse=True)
                enough = np.bincount(slot, np.repeat(prop, size) * times[place], len(used)) >= least
                read, k = np.divmod(used[enough], len(names))
                true = b.column(2).flatten().to_numpy().reshape(len(b), len(ranks))
                some, none, hit = (np.zeros((len(b), len(ranks)), bool) for _ in range(3))
                some[read[~zero[k]], rank[k[~zero[k]]]] = True
                none[read[zero[k]], rank[k[zero[k]]]] = True
                same = np.flatnonzero(true[read, rank[k]] == k)
                hit[read[same], rank[k[same]]] = True
                none |= ~some  # nothing told is unknown
                blank = true == -2
                kind = np.select([hit, blank & none, ~blank & some, ~blank], [0, 4, 1, 2], 3)
                for i in range(len(ranks)):
                    total[i] += np.bincount(kind[:, i], minlength=5)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ranks)), pa.int32()), *[pa.array(total[:, j]) for j in range(5)]], ["i", *KINDS])

    n = reads.join(truth_of, "read_id").select("cells", "props", "truths").mapInArrow(run, "i int, " + ", ".join(f"{x} long" for x in KINDS))
    sums = n.groupBy("i").agg(*[F.sum(x).alias(x) for x in KINDS])
    every = assigned.sparkSession.createDataFrame(list(enumerate(ranks)), "i int, rank string").join(sums, "i", "left")
    return every.select("rank", *profile.measures(*[F.coalesce(x, F.lit(0)) for x in KINDS]))
