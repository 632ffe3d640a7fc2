"""Which references a sample holds: greedy cover, mixture by maximum likelihood, assignment.

Input is the scored hits of `alignment.weigh`: read_id, tax_id, mut, nom, lik, rel_sim,
depth_w, core_w, weight. Loops on the driver hold one number a candidate reference (a few
thousand at most); everything a read brings stays on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.operators.catalog import numbered
from lineagelake.session import checkpoint, discard, stored

UNASSIGNED = -1


def candidates(scored: DataFrame) -> DataFrame:
    return scored.where("core_w >= 0.01 and depth_w >= 0.01 and weight >= 0.001")


def cover(cands: DataFrame, n_reads: int, min_freq: float, min_num: float, cap: int = 5000, most: int = 64) -> tuple[list[tuple[int, float]], float]:
    """([(tax_id, support)] in order of picking, read limit). In turn the reference with the
    most support (sum of rel_sim * weight) is picked and takes away all reads that it hits
    with half the similarity of their best; it ends where 2.5 times the support is below
    the limit. Ties: the smaller id.

    Several references are picked in one round: by falling support, up to `most`, as long as
    each shares no read with those picked before it in the round. Supports never rise, so
    none behind can come before it, and its own has not changed: the order and the supports
    are those of one pick a round. Which of the first ones share reads is found in one pass,
    with at most as many rows as pairs of them.

    Hits are gathered by read once; what a round explains is dropped for good."""
    hit = F.struct("tax_id", (F.col("rel_sim") >= 0.5).alias("strong"), (F.col("rel_sim") * F.col("weight")).alias("s"))
    reads = stored(cands.groupBy("read_id").agg(F.sort_array(F.collect_list(hit)).alias("hits")))
    limit = max(n_reads * min_freq, min_num)
    picked: list[tuple[int, float]] = []
    while True:
        sums = reads.select(F.explode("hits").alias("h")).groupBy("h.tax_id").agg(F.sum("h.s").alias("s"))
        # Rounded, so that the order of additions decides no tie.
        first = [(r.tax_id, r.s) for r in sums.select("tax_id", F.round("s", 9).alias("s")).orderBy(F.desc("s"), "tax_id").limit(most).collect()]
        first = [p for p in first if p[1] * 2.5 >= limit]
        if not first:
            break
        ids = F.array(*[F.lit(t) for t, _ in first]).cast("array<long>")
        among = F.array_distinct(F.transform(F.filter("hits", lambda h: F.array_contains(ids, h["tax_id"])), lambda h: h["tax_id"]))
        met = reads.select(among.alias("m")).where(F.size("m") > 1).select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b")).where("a < b").distinct()
        shares = {(r.a, r.b) for r in met.collect()}  # at most most^2 / 2
        now: list[tuple[int, float]] = []
        for t, s in first:
            if any((min(t, u), max(t, u)) in shares for u, _ in now):
                break
            now.append((t, s))
        picked += now
        gone = F.array(*[F.lit(t) for t, _ in now]).cast("array<long>")
        left = reads.where(~F.exists("hits", lambda h: h["strong"] & F.array_contains(gone, h["tax_id"])))  # noqa: B023
        last, reads = reads, stored(left.select("read_id", F.filter("hits", lambda h: ~F.array_contains(gone, h["tax_id"])).alias("hits")).where(F.size("hits") > 0))  # noqa: B023
        discard(last)
    discard(reads)
    if len(picked) > cap:
        limit = max(n_reads * min_freq * 5, min_num * 2)
        picked = [p for p in picked if p[1] >= limit]
    return picked, limit


def bootstrap(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Rows as often as a Poisson draw of mean one says, the draw being a hash of the key."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # Cumulative Poisson probabilities of mean one.
    below = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    times = sum((F.when(u >= b, 1).otherwise(0) for b in below), F.lit(0))
    return rows.withColumn("_n", times).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def draws(n: int, replicates: int, spark, seed: int = 1) -> DataFrame:
    """(replicate, place, times): for each replicate n draws with replacement from n places, a
    draw being a hash of seed, replicate and its number; places that are not drawn have no row."""
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", "id")), 1, 15), 16, 10).cast("long")
    return rows.select("replicate", F.pmod(h, F.lit(max(n, 1))).alias("place")).groupBy("replicate", "place").agg(F.count("*").alias("times"))


def resampled(q: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """q (read_id, tax_id, q, w): (read_id, w, hits, times), a row a read, times[b - 1] how
    often replicate b drew it; exactly as many draws as reads."""
    rows = q.groupBy("read_id").agg(F.first("w").cast("double").alias("w"), F.sort_array(F.collect_list(F.struct("tax_id", "q"))).alias("hits"))
    rows = stored(numbered(rows, "read_id", name="place"))
    drawn = draws(rows.count(), replicates, q.sparkSession, seed)
    of_read = drawn.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "times"))).alias("m"))
    times = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)).cast("double"))
    return rows.join(of_read, "place", "left").select("read_id", "w", "hits", times.alias("times"))


def replicated(q: DataFrame, replicates: int, seed: int = 1, iterations: int = 200, tolerance: float = 1e-9, level: float = 0.95) -> dict[int, tuple[float, float, float]]:
    """tax_id: (share, low, high), the share of all reads and the interval that holds the
    middle `level` of its shares in the replicates, between order statistics linearly.

    All replicates go through one pass an iteration, as a matrix of shares: replicates times
    references numbers, which is what the driver holds and a task returns."""
    rows = checkpoint(resampled(q, replicates, seed))
    ids = np.array(sorted(r[0] for r in q.select("tax_id").distinct().collect()), np.int64)
    if not len(ids):
        return {}
    x = np.full((replicates + 1, len(ids)), 1.0 / len(ids))
    for _ in range(iterations):
        new = rows.select("w", F.col("hits.tax_id").alias("t"), F.col("hits.q").alias("q"), "times").mapInArrow(_expected_all(ids, x), "tax_id long, b int, s double").groupBy("b", "tax_id").agg(F.sum("s").alias("s"))
        last, x = x, np.zeros_like(x)
        for r in new.collect():
            x[r.b, np.searchsorted(ids, r.tax_id)] = r.s
        x /= np.maximum(x.sum(1, keepdims=True), 1e-300)
        if np.abs(x - last).max() < tolerance:
            break
    low, high = np.quantile(x[1:], [(1 - level) / 2, (1 + level) / 2], axis=0) if replicates else (x[0], x[0])
    return {int(t): (float(a), float(b), float(c)) for t, a, b, c in zip(ids, x[0], low, high)}


def _expected_all(ids: np.ndarray, x: np.ndarray):
    """Like _expected for all rows of x at once; row 0 takes each read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(x)
        for b in batches:
            if not len(b):
                continue
            size = np.diff(b.column(1).offsets.to_numpy())
            at = np.searchsorted(ids, b.column(1).flatten().to_numpy())
            q, read, w = b.column(2).flatten().to_numpy(), np.repeat(np.arange(len(b)), size), b.column(0).to_numpy()
            times = np.concatenate([np.ones((len(b), 1)), b.column(3).flatten().to_numpy().reshape(len(b), -1)], axis=1)
            for k in range(len(x)):
                v = q * x[k, at]
                d = np.bincount(read, v, len(b))
                share = np.divide(w * times[:, k], d, out=np.zeros(len(b)), where=d > 0)
                sums[k] += np.bincount(at, v * share[read], len(ids))
        k, t = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids[t]), pa.array(k.astype(np.int32)), pa.array(sums[k, t])], ["tax_id", "b", "s"])

    return run


def qmatrix(cands: DataFrame, picked: DataFrame) -> DataFrame:
    """(read_id, tax_id, q, w): the largest likelihood of each read and picked reference, and
    the weight of the read's best hit."""
    kept = cands.join(picked.select("tax_id").distinct(), "tax_id", "left_semi")
    best = kept.groupBy("read_id").agg(F.max(F.struct("rel_sim", "weight"))["weight"].alias("w"))
    return kept.groupBy("read_id", "tax_id").agg(F.max("lik").alias("q")).join(best, "read_id")


def mixture(q: DataFrame, iterations: int = 200, tolerance: float = 1e-9) -> dict[int, float]:
    """Shares x (sum one) that maximise sum of w ln(sum of q x), by expectation maximisation
    from equal shares. The problem is convex, so the optimum's value is the only one.

    A read's row is gathered once; an iteration is one pass over batches of reads, which
    adds up a part for each reference before anything is shuffled. The shares travel as one
    array of numbers, so an iteration's plan is the same whatever their count."""
    rows = stored(q.groupBy("read_id").agg(F.first("w").cast("double").alias("w"), F.collect_list(F.struct("tax_id", "q")).alias("hits")))
    ids = np.array(sorted(r[0] for r in q.select("tax_id").distinct().collect()), np.int64)
    if not len(ids):
        return {}
    x = np.full(len(ids), 1.0 / len(ids))
    total = rows.agg(F.sum("w")).first()[0]
    for _ in range(iterations):
        new = rows.select("w", F.col("hits.tax_id").alias("t"), F.col("hits.q").alias("q")).mapInArrow(_expected(ids, x), "tax_id long, s double").groupBy("tax_id").agg(F.sum("s").alias("s"))
        last, x = x, np.zeros(len(ids))
        for r in new.collect():
            x[np.searchsorted(ids, r.tax_id)] = r.s / total
        if np.abs(x - last).max() < tolerance:
            break
    discard(rows)
    return dict(zip(ids.tolist(), x.tolist()))


def _expected(ids: np.ndarray, x: np.ndarray):
    """Batches (w, t, q: the read's references and likelihoods) to expected weights by reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(ids))
        for b in batches:
            if not len(b):
                continue
            size = np.diff(b.column(1).offsets.to_numpy())
            at = np.searchsorted(ids, b.column(1).flatten().to_numpy())
            v = b.column(2).flatten().to_numpy() * x[at]
            read = np.repeat(np.arange(len(b)), size)
            d = np.bincount(read, v, len(b))
            w = np.divide(b.column(0).to_numpy(), d, out=np.zeros(len(b)), where=d > 0)
            sums += np.bincount(at, v * w[read], len(ids))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(sums[some])], ["tax_id", "s"])

    return run


def _divide(a: Column, b: Column) -> Column:
    return a / F.when(b == 0, 1.0).otherwise(b)


def assign(scored: DataFrame, shares: DataFrame, addresses: DataFrame, n_reads: int, limit: float) -> DataFrame:
    """shares (tax_id, x): read_id, tax_id, prop, dist, mean_dist, depth_w and core_w of each
    read's references.

    References with fewer reads than the limit are one, UNASSIGNED, whose prior is the
    limit's share. Hits are weighed by likelihood and share, those below a tenth of the
    read's best fall away, and what is unassigned stays only at the top of a read."""
    matched = scored.select("read_id").distinct().count()
    known = shares.where(F.col("x") * matched >= limit)
    prior = limit / n_reads
    m = scored.join(known, "tax_id", "left").withColumn("tax_id", F.when(F.col("x").isNull(), UNASSIGNED).otherwise(F.col("tax_id")))
    read = Window.partitionBy("read_id")
    m = m.withColumn("v", F.col("lik") * F.coalesce("x", F.lit(prior)))
    m = m.withColumn("v", (F.col("v") + 1e-301) / (F.max("v").over(read) + 1e-300)).where("v >= 0.1").withColumn("prop", F.col("v") / F.sum("v").over(read))
    enough = m.groupBy("tax_id").agg(F.sum("prop").alias("_t")).where(F.col("_t") >= limit).select("tax_id", F.lit(True).alias("_ok"))
    m = m.join(enough, "tax_id", "left").withColumn("tax_id", F.when(F.col("_ok"), F.col("tax_id")).otherwise(UNASSIGNED)).drop("_ok")
    order = read.orderBy(F.desc("prop"), "mut", "tax_id", "nom")
    m = m.withColumn("_n", F.row_number().over(order)).where((F.col("tax_id") != UNASSIGNED) | (F.col("_n") == 1)).withColumn("prop", F.col("prop") / F.sum("prop").over(read))
    part = F.col("weight") * F.col("prop")
    means = m.groupBy("tax_id").agg((100 * _divide(F.sum(part * F.col("mut")), F.sum(part * (F.col("mut") + F.col("nom"))))).alias("mean_dist"))
    m = m.join(means, "tax_id").withColumn("dist", 100 * F.col("mut") / (F.col("mut") + F.col("nom")))
    # What is unassigned is a cluster of its own.
    m = m.join(addresses.select("tax_id", F.col("u").alias("_u")), "tax_id", "left").withColumn("_u", F.coalesce("_u", F.lit(UNASSIGNED)))
    core = m.where("core_w > 0.001").groupBy("_u").agg(_divide(F.sum(F.col("prop") * F.col("core_w")), F.sum("prop")).alias("_c"))
    m = m.join(core, "_u", "left").withColumn("_r", F.col("core_w") / F.coalesce("_c", F.lit(1.0)))
    m = m.withColumn("core_w", _divide(F.sum(F.col("_r") * F.col("prop")).over(read), F.sum("prop").over(read)))
    return m.select("read_id", "tax_id", "prop", "dist", "mean_dist", "depth_w", "core_w")


def specific_reads(assigned: DataFrame, ids: list[int], ratio: float = 0.5) -> DataFrame:
    """Reads whose first reference is among ids and whose share of them is at least ratio."""
    first = F.max(F.struct("prop", (-F.col("dist")).alias("d"), (-F.col("tax_id")).alias("t")))["t"] * -1
    by = assigned.where("depth_w > 0").groupBy("read_id").agg(first.alias("first_tax"), F.sum(F.when(F.col("tax_id").isin(ids), F.col("prop")).otherwise(0.0)).alias("share"))
    return by.where(F.col("first_tax").isin(ids) & (F.col("share") >= ratio))
