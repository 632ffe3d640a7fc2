"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked until their margins are the
targets; documents are then kept with the probability that their cell's weight asks for.

Scale: the cells are one partial aggregation of the texts' counts, so a source with a third
of all rows is a few partial sums. Any number of values has a cell of its own. A raking step
is a partial sum by a margin's values whose factors are joined back to the cells, and nothing
but single numbers comes to the driver. Rates are broadcast to the documents only if their count is
below BROADCAST_CELLS, else joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.session import checkpoint

MARGINS = ("source", "lang", "topic")
BROADCAST_CELLS = 200_000
SWEEPS = 5  # between checks


@dataclass(frozen=True)
class Mix:
    """The target share of a value is its share of tokens to the power `temper`, made to sum
    to one; 1 leaves a margin as it is, 0 makes it even. `targets` overrides this with
    given shares. `budget` is the share of all tokens to keep."""

    temper: tuple[tuple[str, float], ...] = (("source", 0.85), ("lang", 0.9), ("topic", 0.9))
    targets: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()
    budget: float = 0.9
    seed: int = 17
    tolerance: float = 1e-6
    max_blocks: int = 40


def tokens_of(text: Column) -> Column:
    """Tokens counted as words and single marks, of any script."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(0)).cast("long")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic from surface marks of the whole text; without tokens: none."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    # The patterns need one of these strings, which are cheaper to look for.
    low = F.lower(text)
    legal = F.contains(low, F.lit("licen")) | F.contains(low, F.lit("all rights reserved")) | F.contains(low, F.lit("copyright"))
    bars = (F.length(text) - F.length(F.replace(text, F.lit(" | "), F.lit("")))) / 3
    return (
        F.when(n_tokens == 0, "none")
        .when(legal & text.rlike(r"(?i)\b(licen[cs]e|all rights reserved|copyright)\b"), "legal")
        .when(bars * 4 > words, "tabular")
        .when(words < 60, "brief")
        .when(words < 600, "article")
        .otherwise("long")
    )


def _told(docs: DataFrame, mix: Mix) -> DataFrame:
    """docs as (row, key, draw): all columns in one struct, so that no name can clash; the
    margins' values and n_tokens; and the row's draw from [0, 1), a hash of its id or, where
    it has none, of its text."""
    text = F.col("text").cast("string")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    bits = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(mix.seed), F.col("doc_id").cast("long"))).otherwise(F.xxhash64(F.lit(mix.seed), text, F.lit(0)))
    draw = bits.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    counted = docs.select(F.struct(*docs.columns).alias("row"), name("source"), name("lang"), text.alias("text"), tokens_of(text).alias("n_tokens"), draw.alias("draw"))
    return counted.select("row", F.struct("source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens").alias("key"), "draw")


def cells(docs: DataFrame, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """docs with the margins and n_tokens: tokens and rows of each cell."""
    return docs.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def _targets(table: DataFrame, mix: Mix, margins: tuple[str, ...]) -> DataFrame:
    """Adds the target share of each margin's value, over the values that have tokens. With
    given targets, values that they don't name have none."""
    given, temper = dict(mix.targets), dict(mix.temper)
    spark = table.sparkSession
    total = table.agg(F.sum("tokens")).first()[0]
    for m in margins:
        raw = table.groupBy(m).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("_share"))
        if m in given:
            wanted = spark.createDataFrame([(str(v), float(w)) for v, w in given[m]], "_value string, _raw double").groupBy("_value").agg(F.sum("_raw").alias("_raw"))
            raw = raw.join(wanted, raw[m] == wanted["_value"], "left").select(m, F.coalesce("_raw", F.lit(0.0)).alias("_raw"))
        else:
            raw = raw.select(m, F.pow("_share", F.lit(temper.get(m, 1.0))).alias("_raw"))
        raw = checkpoint(raw)
        whole = raw.agg(F.sum("_raw")).first()[0]
        table = table.join(raw.select(m, (F.col("_raw") / F.lit(float(whole or 1))).alias(f"target_{m}")), m)
    return table


def rake(table: DataFrame, mix: Mix, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """The cell table with `weight` (shares of tokens that sum to one) raked to the targets,
    and `margins_off`, by how much the margin that is farthest off misses its target.

    A step adds up the weights by a margin's values, partially before anything is shuffled,
    and joins the factors back: cells of one value are in no task together. Sweeps are
    checked in blocks against `tolerance`. Cells without tokens get no weight. If no such
    weights exist, sweeps end where a block comes no closer (by a hundredth), or after
    `max_blocks` blocks, and margins_off says so."""
    table = checkpoint(table.where("tokens > 0"))
    total = table.agg(F.sum("tokens")).first()[0]
    now = checkpoint(_targets(table, mix, margins).withColumn("weight", F.col("tokens") / F.lit(float(total or 1))))
    values = now.agg(*[F.count_distinct(m).alias(m) for m in margins]).first()
    last = worst = math.inf
    for _ in range(mix.max_blocks):
        for _ in range(SWEEPS):
            for m in margins:
                sums = now.groupBy(m).agg(F.sum("weight").alias("_sum"))
                sums = F.broadcast(sums) if values[m] <= BROADCAST_CELLS else sums.withColumn(m, F.concat(m, F.lit("")))
                scaled = F.when(F.col("_sum") > 0, F.col("weight") * F.col(f"target_{m}") / F.col("_sum")).otherwise(0.0)
                # Cut at each step: the sum and the cells it is joined to have one plan.
                now = checkpoint(now.join(sums, m).withColumn("weight", scaled).drop("_sum"))
        # The last margin was just scaled; the others tell how far off the weights are.
        off = [now.groupBy(m).agg(F.abs(F.sum("weight") - F.max(f"target_{m}")).alias("off")).select("off") for m in margins]
        worst = reduce(DataFrame.unionByName, off).agg(F.max("off")).first()[0]
        if worst is None or worst <= mix.tolerance or worst > 0.99 * last:
            break
        last = worst
    return now.withColumn("margins_off", F.lit(None if worst is None else float(worst)).cast("double"))


def probabilities(raked: DataFrame, mix: Mix, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """Adds `probability`: min(1, s * weight / tokens), with s such that the expected tokens
    are `budget` of all. Exact: what a factor would take beyond a cell's tokens is kept whole,
    and the factor of the rest found anew, until no more cells are whole. The factor only
    rises, so cells that are whole stay so; a round is one sum over the cells."""
    sums = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    left, weight = mix.budget * (sums[0] or 0), sums[1] or 0.0
    ratio, scale, n_whole = F.col("weight") / F.col("tokens"), 0.0, 0
    while weight > 0:
        scale = left / weight
        whole = raked.where(ratio * F.lit(scale) >= 1).agg(F.count("*"), F.sum("tokens"), F.sum("weight")).first()
        if whole[0] == n_whole:
            break
        n_whole, left, weight = whole[0], mix.budget * sums[0] - whole[1], sums[1] - whole[2]
        if left <= 0:  # a budget of all, up to rounding
            break
    return raked.withColumn("probability", F.least(F.lit(1.0), F.lit(float(scale)) * ratio))


def _marked(told: DataFrame, mix: Mix) -> DataFrame:
    """told (row, key, draw): adds mixed: tokens, weight, probability and verdict."""
    table = cells(told.select("key.*"))
    raked = checkpoint(probabilities(rake(table, mix), mix))
    rates = raked.select(F.struct(*MARGINS).alias("cell"), F.struct("weight", "tokens", "probability", "margins_off").alias("rate"))
    rates = F.broadcast(rates) if raked.count() <= BROADCAST_CELLS else rates
    out = told.join(rates, F.struct(*[F.col(f"key.{m}").alias(m) for m in MARGINS]) == F.col("cell"), "left")
    p = F.coalesce(F.col("rate.probability"), F.lit(0.0))
    return out.select("row", F.struct(F.col("key.topic").alias("topic"), F.col("key.n_tokens").alias("n_tokens"), F.coalesce(F.col("rate.weight") / F.col("rate.tokens"), F.lit(0.0)).alias("token_weight"), p.alias("probability"), (F.col("draw") < p).alias("kept"), F.col("rate.margins_off").alias("margins_off")).alias("mixed"))


def assign(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs (doc_id, text, source, lang, ...): doc_id, source, lang, topic, n_tokens,
    token_weight (the mixture's weight of one token), probability, kept and margins_off (by
    how much the worst margin misses its target; null without a weight) for each row.

    Null sources and languages count as the empty value. Null and empty texts have no
    tokens, no weight, probability 0 and are not kept. The draw is a hash of doc_id (of the
    text where it is null), so it repeats, rows of one id are drawn alike, and a lost task
    draws as before. An empty table gives no rows; columns of other names are not read.
    """
    # Texts are read once; what is kept of a row is some 40 bytes.
    told = _told(docs.select(F.col("doc_id").cast("long"), "text", "source", "lang"), mix)
    slim = checkpoint(told.select(F.struct("row.doc_id", "row.source", "row.lang").alias("row"), "key", "draw"))
    return _marked(slim, mix).select("row.*", "mixed.*")


def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs that are drawn, with all their columns, whatever their names."""
    return _marked(_told(docs, mix), mix).where("mixed.kept").select("row.*")
