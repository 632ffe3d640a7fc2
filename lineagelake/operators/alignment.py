"""From alignments to scored hits.

hits: read_id, tax_id, seq_id, site (long), mut, nom (double), and ord, which orders the
hits of a read. seqinfo: seq_id, seq_len, tax_id. addresses: tax_id and the levels u to a.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.config import FRAGMENTS, PRIORS
from lineagelake.functions.poisson import band_ratio_of
from lineagelake.session import stored

PAIRS = (("u", "p"), ("s", "n"), ("r", "m"))


def operations(cigar: Column, letters: str) -> Column:
    """Sum of the lengths of a CIGAR's operations of these letters."""
    found = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{letters}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def clips(cigar: Column) -> Column:
    """Lengths clipped at either end."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)[SH]"), F.lit(1)), lambda x: x.cast("long"))


def from_sam(sam: DataFrame, sequences: DataFrame, dialect: str = "short") -> DataFrame:
    """sam (ord, mate, flag, read_id, ref, pos, cigar, seq, score) and sequences (ref,
    seq_id, tax_id): hits, the first that passes for each read, mate and reference.

    Rejected: unmapped rows, unknown references, and rows clipped too far: by the `short`
    dialect more than 100 clipped, half the read, or more than 4 at both ends; by the
    `long` one more than 9 at both ends, or more clipped than matched."""
    c = sam.where("cigar <> '*'").withColumn("_clips", clips(F.col("cigar"))).withColumn("_clip", operations(F.col("cigar"), "SH"))
    both = lambda least: (F.size("_clips") > 1) & (F.array_min("_clips") > least)
    longest = F.coalesce(F.array_max("_clips"), F.lit(0))
    if dialect == "short":
        c = c.where(~((F.col("_clip") > 100) | (2 * F.col("_clip") >= F.length("seq")) | both(4)))
        length = F.when(F.col("flag") < 256, F.length("seq").cast("long")).otherwise(operations(F.col("cigar"), "SHMI"))
        mut = (2 * length - (F.col("score") + 1.5 * longest)) / 6
    else:
        matched = operations(F.col("cigar"), "MI")
        c = c.where(~(both(9) | (F.col("_clip") > matched)))
        length = F.col("_clip") + matched
        mut = (2 * length - (F.col("score") + 1.6 * longest)) / 5
    c = c.withColumn("mut", mut).withColumn("nom", length - F.col("mut"))
    c = c.join(sequences, "ref")
    first = Window.partitionBy("read_id", "mate", "tax_id").orderBy("ord")
    return c.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("read_id", "tax_id", "seq_id", F.col("pos").cast("long").alias("site"), "mut", "nom", "ord")


def merge_pairs(hits: DataFrame) -> DataFrame:
    """One hit for each read and reference: mates' values added, the first hit's place. Reads
    whose hit is shorter than the longest of theirs miss a mate, and pay a part of it."""
    merged = hits.groupBy("read_id", "tax_id").agg(F.sum("mut").alias("mut"), F.sum("nom").alias("nom"), F.min(F.struct("ord", "seq_id", "site")).alias("f"))
    short = F.max(F.col("mut") + F.col("nom")).over(Window.partitionBy("read_id")) - F.col("mut") - F.col("nom")
    return merged.withColumn("_d", short).select("read_id", "tax_id", "f.seq_id", "f.site", (F.col("mut") + 0.1 * F.col("_d")).alias("mut"), (F.col("nom") + 0.9 * F.col("_d")).alias("nom"))


def similarity(merged: DataFrame, mismatch: float = 0.05) -> DataFrame:
    """Adds score (centred by its expectation), lik = e^score and rel_sim (against the best
    hit of the read)."""
    a, b = math.log(mismatch), math.log(1 - mismatch)
    centre = mismatch * a + (1 - mismatch) * b
    scored = merged.withColumn("score", F.col("mut") * a + F.col("nom") * b - (F.col("mut") + F.col("nom")) * centre)
    best = F.max("score").over(Window.partitionBy("read_id"))
    return scored.withColumn("lik", F.exp("score")).withColumn("rel_sim", F.exp(F.col("score") - best))


def conservation(scored: DataFrame, addresses: DataFrame, priors=PRIORS) -> DataFrame:
    """(read_id, core_w): the chance that what a read hits is conserved.

    For each pair of levels: T counts the sub-clusters that any hit's references have in a
    cluster, P those that this read hits. P and T are averaged over the read's clusters,
    weighted by the best row of the cluster's lowest sub-cluster, and compared under two
    binomial models. The first pair in which every T is 1 ends the series."""
    # Addresses of the references that are hit: few rows, and no count of all hits by a hot cluster.
    levels = sorted({x for pair in PAIRS for x in pair})
    there = stored(addresses.join(scored.select("tax_id").distinct(), "tax_id", "left_semi").select("tax_id", *levels))
    totals = [there.select(up, down).distinct().groupBy(up).agg(F.count("*").alias("t")) for up, down in PAIRS]
    # One job tells where the series ends.
    most = [r.m for r in reduce(DataFrame.unionByName, [t.agg(F.max("t").alias("m")).select(F.lit(i).alias("i"), "m") for i, t in enumerate(totals)]).orderBy("i").collect()]
    used = next((i for i, m in enumerate(most) if (m or 1) == 1), len(PAIRS))
    miss = F.lit(1.0)
    out = scored.select("read_id").distinct()
    for (up, down), (prior, c, a), total in list(zip(PAIRS, priors, totals))[:used]:
        # Dealt by read once, which serves all that follows.
        placed = scored.select("read_id", "tax_id", "rel_sim").join(there.select("tax_id", up, down), "tax_id").repartition("read_id")
        hit = placed.groupBy("read_id", up, down).agg(F.max("rel_sim").alias("w"))
        each = hit.groupBy("read_id", up).agg(F.count("*").alias("p"), F.min_by("w", down).alias("w"))
        mean = each.join(total, up).groupBy("read_id").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"), (F.sum(F.col("t") * F.col("w")) / F.sum("w")).alias("t"))

        def like(weight: float, p: float) -> Column:
            return F.exp(F.greatest(F.lit(-700.0), math.log(weight) + F.col("p") * math.log(p) + (F.col("t") - F.col("p")) * math.log(1 - p)))

        q = like(prior, c) / (like(prior, c) + like(1 - prior, a))
        name = f"_q_{up}"
        out = out.join(mean.select("read_id", q.alias(name)), "read_id")
        miss = miss * (1 - F.col(name))
    return out.select("read_id", (1 - miss).alias("core_w"))


def bin_depths(hits: DataFrame, seqinfo: DataFrame, fragment: int) -> tuple[DataFrame, DataFrame]:
    """((seq_id, bin, n), (tax_id, mean)): hits in each bin of a sequence, and the mean depth
    of a reference over all bins, empty ones and one between two sequences included; half a
    hit where no bin has more than one."""
    bins = hits.groupBy("seq_id", F.floor(F.col("site") / fragment).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    present = seqinfo.join(hits.select("tax_id").distinct(), "tax_id", "left_semi")
    room = present.groupBy("tax_id").agg((F.sum(1 + F.floor(F.col("seq_len") / fragment)) + F.count("*") - 1).alias("room"))
    depth = bins.join(seqinfo.select("seq_id", "tax_id"), "seq_id").groupBy("tax_id").agg(F.sum("n").alias("hits"), F.max("n").alias("most"))
    mean = F.when(F.col("most") <= 1, 0.5).otherwise(F.col("hits") / F.col("room"))
    return bins, depth.join(room, "tax_id").select("tax_id", mean.alias("mean"))


def depth_weights(hits: DataFrame, seqinfo: DataFrame, fragments=FRAGMENTS, shortest: int = 500) -> DataFrame:
    """(read_id, depth_w): geometric mean over the fragment lengths of how well the depth at a
    hit fits its reference, averaged over the read's hits by rel_sim; 0 on short sequences."""
    found = hits.select("read_id", "tax_id", "seq_id", "site", "rel_sim")
    log_w = F.lit(0.0)
    for i, fragment in enumerate(fragments):
        bins, mean = bin_depths(hits, seqinfo, fragment)
        ratio = bins.join(seqinfo.select("seq_id", "tax_id"), "seq_id").join(mean, "tax_id").select("seq_id", F.col("bin").alias(f"_b{i}"), band_ratio_of(F.col("n"), F.col("mean")).alias(f"_r{i}"))
        found = found.withColumn(f"_b{i}", F.floor(F.col("site") / fragment).cast("long")).join(ratio, ["seq_id", f"_b{i}"])
        log_w = log_w + F.col(f"_r{i}")
    weight = F.when(F.col("seq_len") < shortest, 0.0).otherwise(F.exp(log_w / len(fragments)))
    weighed = found.join(seqinfo.select("seq_id", "seq_len"), "seq_id").withColumn("w", weight)
    return weighed.groupBy("read_id").agg((F.sum(F.col("w") * F.col("rel_sim")) / F.sum("rel_sim")).alias("depth_w"))


def near_best(scored: DataFrame, mismatch: float = 0.05) -> DataFrame:
    """Hits at most five mutations worse than the read's best. Stands after `conservation`
    and before `depth_weights`, which counts what is left."""
    return scored.where(F.col("rel_sim") >= (mismatch / (1 - mismatch)) ** 5)


def weigh(hits: DataFrame, seqinfo: DataFrame, addresses: DataFrame, mismatch: float = 0.05) -> DataFrame:
    """Scored hits with depth_w, core_w and weight = depth_w * core_w, the positive ones."""
    scored = stored(similarity(merge_pairs(hits), mismatch))
    core = conservation(scored, addresses)
    near = near_best(scored, mismatch)
    out = near.join(core, "read_id").join(depth_weights(near, seqinfo), "read_id").withColumn("weight", F.col("depth_w") * F.col("core_w")).where("weight > 0 and lik > 0")
    return out
