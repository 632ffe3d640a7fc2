"""Abundance profiles: distance bands, roll-up over address levels, taxa, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.operators.mixture import UNASSIGNED

# Report level and the largest distance in percent that counts for it.
BANDS = (("~", "u", None), ("u", "u", 10.0), ("s", "s", 5.0), ("r", "r", 2.0), ("p", "p", 1.0))


def _hits(assigned: DataFrame) -> DataFrame:
    weight = F.col("depth_w") * F.col("core_w") * F.col("prop")
    return assigned.where(F.col("tax_id") != UNASSIGNED).select("read_id", "tax_id", F.greatest("dist", "mean_dist").alias("d"), weight.alias("w"))


def summary(assigned: DataFrame, n_reads: int) -> DataFrame:
    """One row: total, matched reads, share unmatched and share of uncertain matches."""
    matched = assigned.agg(F.count_distinct("read_id").alias("matched"))
    certain = _hits(assigned).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("certain"))
    both = matched.join(certain, how="inner", on=F.lit(True))
    rest = F.col("matched") - F.col("certain")
    return both.select(F.lit(n_reads).cast("long").alias("total"), "matched", (100 * (n_reads - F.col("matched")) / n_reads).alias("unmatched_pct"), (100 * rest / n_reads).alias("uncertain_pct"), F.when(F.col("matched") > 0, 100 * rest / F.col("matched")).alias("uncertain_matched_pct"))


def bands(assigned: DataFrame) -> DataFrame:
    """(tax_id, b0 to b4): weight of each reference at all distances, and at most 10, 5, 2, 1."""
    sums = [F.sum(F.col("w") if most is None else F.when(F.col("d") <= most, F.col("w")).otherwise(0.0)).alias(f"b{i}") for i, (_, _, most) in enumerate(BANDS)]
    return _hits(assigned).groupBy("tax_id").agg(*sums)


def rollup(banded: DataFrame, addresses: DataFrame) -> DataFrame:
    """(grp, weight, refs): each reference adds its band to the group of that band's level.
    Levels have measures of their own, so this is no GROUP BY ROLLUP. refs: the references
    by falling weight."""
    placed = banded.join(addresses, "tax_id")
    rows = F.array(*[F.struct(F.concat(F.lit(name), F.col(level).cast("string")).alias("grp"), F.col(f"b{i}").alias("weight")) for i, (name, level, _) in enumerate(BANDS)])
    flat = placed.select("tax_id", "b0", F.explode(rows).alias("x")).select("tax_id", "b0", "x.*").where("weight > 0")
    refs = F.array_sort(F.collect_list(F.struct((-F.round("b0", 7)).alias("o"), "tax_id")))
    return flat.groupBy("grp").agg(F.sum("weight").alias("weight"), F.transform(refs, lambda x: x["tax_id"]).alias("refs"))


def taxon_votes(banded: DataFrame, addresses: DataFrame, labels: DataFrame, share: float = 0.1) -> DataFrame:
    """labels (tax_id, label): (grp, taxon) where the members of each reference's p group vote
    with its weight; the first, and in brackets those with a tenth of its votes."""
    members = addresses.select("tax_id", "p").join(labels, "tax_id").groupBy("p", "label").agg(F.count("*").alias("n"))
    placed = banded.join(addresses, "tax_id")
    rows = F.array(*[F.struct(F.concat(F.lit(name), F.col(level).cast("string")).alias("grp"), F.col(f"b{i}").alias("weight")) for i, (name, level, _) in enumerate(BANDS)])
    flat = placed.select("p", F.explode(rows).alias("x")).select("p", "x.*").where("weight > 0").groupBy("p", "grp").agg(F.sum("weight").alias("weight"))
    votes = flat.join(members, "p").groupBy("grp", "label").agg(F.round(F.sum(F.col("weight") * F.col("n")), 7).alias("v"))
    top = votes.groupBy("grp").agg(F.max("v").alias("top"))
    kept = votes.join(top, "grp").where(F.col("v") >= share * F.col("top"))
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("o"), "label"))), lambda x: x["label"])
    text = F.when(F.size("names") > 1, F.concat(F.element_at("names", 1), F.lit(" ("), F.array_join(F.slice("names", F.lit(2), F.size("names")), "/"), F.lit(")"))).otherwise(F.element_at("names", 1))
    return kept.groupBy("grp").agg(names.alias("names")).select("grp", text.alias("taxon"))


def profile(assigned: DataFrame, addresses: DataFrame, labels: DataFrame, n_reads: int, min_freq: float = 0.0001) -> DataFrame:
    """(grp, pct_total, pct_matched, taxon, refs) of groups with at least min_freq of reads."""
    banded = bands(assigned)
    matched = assigned.agg(F.count_distinct("read_id").alias("matched"))
    groups = rollup(banded, addresses).where(F.col("weight") / n_reads >= min_freq).join(taxon_votes(banded, addresses, labels), "grp")
    return groups.join(F.broadcast(matched), how="inner", on=F.lit(True)).select("grp", (100 * F.col("weight") / n_reads).alias("pct_total"), (100 * F.col("weight") / F.col("matched")).alias("pct_matched"), "taxon", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


def as_text(profiled: DataFrame) -> DataFrame:
    """Lines of a profile file, largest groups first."""
    line = F.format_string("%s\t%.4f\t%.4f\t%s (%s)", "grp", "pct_total", "pct_matched", "taxon", "refs")
    return profiled.orderBy(F.desc("pct_total"), F.desc("grp")).select(line.alias("value"))


def label_of(taxon: Column, rules: list[tuple[str, str]], default: str = "non") -> Column:
    """The label of the first rule whose pattern is found, rules being ordered by label and
    pattern."""
    ordered = sorted(rules, key=lambda r: (r[1], r[0]))
    return reduce(lambda acc, r: F.when(taxon.rlike(r[0]), r[1]).otherwise(acc), reversed(ordered), F.lit(default))


def report(samples: DataFrame, names: list[str], level: str, low: float = 0.0, absolute: bool = False) -> DataFrame:
    """samples (sample, grp, pct_matched, n_found, n_total): a row for each group of a level,
    and `Unknown` for what is left, a column for each name, and the total.

    A group below `low` percent of a sample's reads is left out of it. absolute: reads, not
    percents. The names are given, so the pivot needs no pass to find them."""
    pct = F.col("pct_matched") * F.col("n_found") / F.col("n_total")
    value = F.round(F.col("pct_matched") / 100 * F.col("n_found")) if absolute else pct
    rows = samples.where(F.startswith("grp", F.lit(level)) & (pct >= low)).select("sample", "grp", value.alias("v"))
    rows = rows.where("v > 0") if absolute else rows  # groups that round to no read are left out
    whole = F.col("n_total").cast("double") if absolute else F.lit(100.0)
    totals = samples.groupBy("sample").agg(F.first("n_total").alias("n_total")).select("sample", whole.alias("whole"))
    known = rows.groupBy("sample").agg(F.sum("v").alias("k"))
    dark = totals.join(known, "sample", "left").select("sample", F.lit("Unknown").alias("grp"), (F.col("whole") - F.coalesce("k", F.lit(0.0))).alias("v"))
    table = rows.unionByName(dark).groupBy("grp").pivot("sample", names).agg(F.sum("v"))
    filled = [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names]
    return table.select("grp", *filled).withColumn("total", reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names]))


def species_vote(members: DataFrame, group: str, unit: str, species: str) -> DataFrame:
    """Species of each group by its distinct units: those with a tenth of the most, or four;
    formally named ones (without a star) before others. (group, votes, species)"""
    counts = members.groupBy(group, species).agg(F.count_distinct(unit).alias("n"))
    most = F.max("n").over(Window.partitionBy(group))
    kept = counts.withColumn("_most", most).where((F.col("n") * 10 >= F.col("_most")) | (F.col("n") >= 4))
    formal = ~F.startswith(species, F.lit("*"))
    some = F.max(formal.cast("int")).over(Window.partitionBy(group))
    return kept.withColumn("_some", some).where(formal | (F.col("_some") == 0)).select(group, F.col("n").alias("votes"), F.col(species).alias("species"))


def scores(pairs: DataFrame) -> DataFrame:
    """pairs (truth, predicted), comma-separated ids with 0 for unknown: one row of counts,
    precision, recall and F1. A pair agrees if any known ids do; else both unknown, wrong,
    missed, or made up, in this order."""
    t, p = F.split("truth", ","), F.split("predicted", ",")
    known = lambda a: F.exists(a, lambda x: x != "0")
    unknown = lambda a: F.array_contains(a, "0")
    agree = known(F.array_intersect(t, p))
    kind = F.when(agree, "true").when(unknown(t) & unknown(p), "none").when(known(t) & known(p), "wrong").when(known(t), "missed").otherwise("spurious")
    n = pairs.select(kind.alias("k")).agg(*[F.coalesce(F.sum(F.when(F.col("k") == x, 1).otherwise(0)), F.lit(0)).alias(x) for x in ("true", "wrong", "missed", "spurious", "none")])
    return n.select(*measures(*[F.col(x) for x in ("true", "wrong", "missed", "spurious", "none")]))


def measures(true: Column, wrong: Column, missed: Column, spurious: Column, none: Column) -> list[Column]:
    fp, fn = wrong + spurious, wrong + missed
    return [true.alias("n_true"), fp.alias("n_false_positive"), fn.alias("n_false_negative"), none.alias("n_both_unknown"), F.try_divide(true, true + fp).alias("precision"), F.try_divide(true, true + fn).alias("recall"), F.try_divide(2 * true, 2 * true + fp + fn).alias("f1")]


def chosen(reported: DataFrame, names: list[str], label: str | None = None, without_empty: bool = False) -> DataFrame:
    """A report's rows by falling total. label: a column; rows labelled `non` go.
    without_empty: samples that have nothing in the rows that stay go too."""
    rows = reported.where(F.col(label) != "non") if label else reported
    if without_empty:
        sums = rows.agg(*[F.coalesce(F.sum(F.col(f"`{n}`")), F.lit(0.0)).alias(n) for n in names]).first()
        rows = rows.drop(*[n for n in names if not sums[n] > 0])
    return rows.orderBy(F.desc("total"), "grp")


def transposed(reported: DataFrame, key: str, keys: list[str], names: list[str]) -> DataFrame:
    """A row for each sample, a column for each of the report's given keys."""
    long = reported.select(key, *[F.col(f"`{n}`") for n in names]).unpivot([key], names, "sample", "_v")
    return long.groupBy("sample").pivot(key, keys).agg(F.sum("_v"))


def file_lines(profiled: DataFrame, summarised: DataFrame) -> DataFrame:
    """Lines of a profile file: the three rows of the summary, then the groups."""
    head = F.array(
        F.format_string("Total\t%d\t%.3f", "total", F.col("matched").cast("double")), F.format_string("Unmatched\t%.3f\t%.3f", "unmatched_pct", F.lit(0.0)),
        F.format_string("Uncertain_match\t%.3f\t%.3f", "uncertain_pct", F.coalesce("uncertain_matched_pct", F.lit(0.0))),
    )
    first = summarised.select(F.posexplode(head).alias("n", "value"))
    rest = as_text(profiled).select((F.lit(3) + F.monotonically_increasing_id()).alias("n"), "value")
    return first.select(F.col("n").cast("long"), "value").unionByName(rest).orderBy("n").select("value")


def interpret(assigned: DataFrame, ranks: list[str], least: float = 0.8) -> DataFrame:
    """assigned (read_id, prop, dist, mean_dist, informal, an id for each rank): for each read
    and rank the ids that at least `least` of it agree on, comma-separated, else 0.

    The species of what is 5 % away or informal, and the genus of what is 10 % away, is unknown."""
    far = F.greatest("dist", "mean_dist")
    known = {r: F.col(r) for r in ranks}
    if "species" in known:
        known["species"] = F.when((far >= 5) | F.col("informal"), 0).otherwise(F.col("species"))
    if "genus" in known:
        known["genus"] = F.when(far >= 10, 0).otherwise(F.col("genus"))
    each = F.array(*[F.struct(F.lit(r).alias("rank"), F.coalesce(known[r], F.lit(0)).cast("long").alias("id")) for r in ranks])
    votes = assigned.select("read_id", "prop", F.explode(each).alias("x")).groupBy("read_id", "x.rank", "x.id").agg(F.sum("prop").alias("p"))
    ids = lambda r: F.array_sort(F.collect_set(F.when((F.col("rank") == r) & (F.col("p") >= least), F.col("id"))))
    return votes.groupBy("read_id").agg(*[F.when(F.size(ids(r)) > 0, F.array_join(ids(r).cast("array<string>"), ",")).otherwise("0").alias(r) for r in ranks])


# What a taxonomy of so many levels names.
DEPTHS = {6: "Class", 7: "Genus", 8: "Species", 9: "Subspecies", 10: "Reference"}


def traditional(samples: DataFrame, names: list[str], cutoff: float = 0.001, clean: bool = False) -> DataFrame:
    """samples (sample, taxon, v): level, taxonomy and a column for each sample, of taxonomies
    with at least `cutoff`. Synonyms in brackets are merged and named with their species; clean:
    only species, without those whose name is informal (with a star), nor such synonyms."""
    rows = samples.where(F.col("v") >= cutoff).withColumn("t", F.regexp_replace("taxon", r" \([^)]+\)", "")).withColumn("p", F.split("taxon", r"\|"))
    table = rows.groupBy("t").pivot("sample", names).agg(F.sum("v"))
    eighth = F.get("p", F.lit(7))
    main = F.regexp_replace(eighth, r" \([^)]*\)$", "")
    other = F.split(F.regexp_extract(eighth, r" \(([^)]*)\)$", 1), "/")
    merged = rows.where(eighth.isNotNull()).select(main.alias("main"), F.explode(other).alias("o")).groupBy("main").agg(F.array_sort(F.collect_set(F.when(F.col("o") != "", F.col("o")))).alias("os"))
    if clean:
        merged = merged.where(~F.startswith("main", F.lit("*"))).withColumn("os", F.filter("os", lambda x: ~F.startswith(x, F.lit("*"))))
    label = F.when(F.size("os") > 0, F.concat("main", F.lit(" ("), F.array_join("os", "/"), F.lit(")"))).otherwise(F.col("main"))
    parts = table.withColumn("p", F.split("t", r"\|")).withColumn("main", F.get("p", F.lit(7)))
    both = parts.join(merged.select("main", label.alias("label")), "main", "left").where(F.col("main").isNull() | F.col("label").isNotNull())
    name = F.array_join(F.when(F.col("main").isNull(), F.col("p")).otherwise(F.concat(F.slice("p", 1, 7), F.array("label"), F.slice("p", F.lit(9), F.size("p")))), "|")
    level = reduce(lambda acc, d: F.when(F.size("p") == d[0], d[1]).otherwise(acc), DEPTHS.items(), F.lit(None).cast("string"))
    out = both.where(~F.endswith("t", F.lit("|"))).select(level.alias("level"), name.alias("taxonomy"), *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
    return out.where("level = 'Species'") if clean else out.where("level is not null")


# Ranks of a taxonomy from the top, and how many of the last ones a group's
# level is too coarse for.
RANKS = ("superkingdom", "kingdom", "phylum", "class", "order", "family", "genus", "species", "subspecies")
TOO_FINE = {"~": 3, "u": 2, "s": 1}


def taxonomy(banded: DataFrame, addresses: DataFrame, labels: DataFrame, names: DataFrame, ranks: tuple[str, ...] = RANKS, share: float = 0.1) -> DataFrame:
    """labels (tax_id, a column for each rank), names (tax_id, organism_name, accession):
    (grp, weight, taxonomy, refs), one row for each group that rollup has.

    At each rank the members of each reference's p group vote with the reference's weight
    in the group: the first label, and in brackets those with `share` of its votes, by falling
    votes, ties by name. A null label is `-` and votes. Ranks stand joined by bars from the
    top down to what the group's level can tell; a p group ends with the name and accession
    of its heaviest reference."""
    groups = rollup(banded, addresses)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(F.col(f"`{r}`").cast("string"), F.lit("-")).alias("label")) for i, r in enumerate(ranks)])
    members = addresses.select("tax_id", "p").join(labels, "tax_id").select("p", F.explode(cells).alias("x")).groupBy("p", "x.i", "x.label").agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.concat(F.lit(name), F.col(level).cast("string")).alias("grp"), F.col(f"b{i}").alias("weight")) for i, (name, level, _) in enumerate(BANDS)])
    flat = banded.join(addresses, "tax_id").select("p", F.explode(rows).alias("x")).select("p", "x.*").where("weight > 0").groupBy("p", "grp").agg(F.sum("weight").alias("weight"))
    # Rounded, so that the order of additions decides no tie.
    votes = flat.join(members, "p").groupBy("grp", "i", "label").agg(F.round(F.sum(F.col("weight") * F.col("n")), 7).alias("v"))
    top = votes.groupBy("grp", "i").agg(F.max("v").alias("top"))
    kept = votes.join(top, ["grp", "i"]).where(F.col("v") >= share * F.col("top"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("o"), "label"))), lambda x: x["label"])
    one = F.when(F.size("ls") > 1, F.concat(F.col("ls")[0], F.lit(" ("), F.array_join(F.slice("ls", F.lit(2), F.size("ls")), "/"), F.lit(")"))).otherwise(F.col("ls")[0])
    told = kept.groupBy("grp", "i").agg(listed.alias("ls")).select("grp", "i", one.alias("t"))
    path = told.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("path"))
    level = F.substring("grp", 1, 1)
    cut = reduce(lambda acc, x: F.when(level == x[0], x[1]).otherwise(acc), TOO_FINE.items(), F.lit(0))
    first = names.select(F.col("tax_id").alias("_first"), F.concat_ws(": ", F.coalesce("organism_name", F.lit("-")), F.coalesce("accession", F.lit("-"))).alias("_name"))
    named = groups.withColumn("_first", F.col("refs")[0]).join(path, "grp", "left").join(first, "_first", "left")
    whole = F.slice(F.coalesce("path", F.array().cast("array<string>")), F.lit(1), F.greatest(F.size("path") - cut, F.lit(0)))
    whole = F.when(level == "p", F.concat(whole, F.array(F.coalesce("_name", F.lit("-"))))).otherwise(whole)
    return named.select("grp", "weight", F.array_join(whole, "|").alias("taxonomy"), "refs")


def full_profile(assigned: DataFrame, addresses: DataFrame, labels: DataFrame, names: DataFrame, n_reads: int, min_freq: float = 0.0001, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """profile() with taxonomies of all ranks: (grp, pct_total, pct_matched, taxon, refs)."""
    matched = assigned.agg(F.count_distinct("read_id").alias("matched"))
    groups = taxonomy(bands(assigned), addresses, labels, names, ranks).where(F.col("weight") / n_reads >= min_freq)
    refs = F.array_join(F.transform("refs", lambda x: x.cast("string")), ",")
    return groups.join(F.broadcast(matched), how="inner", on=F.lit(True)).select("grp", (100 * F.col("weight") / n_reads).alias("pct_total"), (100 * F.col("weight") / F.col("matched")).alias("pct_matched"), F.col("taxonomy").alias("taxon"), refs.alias("refs"))


DARK = "Dark Matter"


def full_report(samples: DataFrame, names: list[str], levels: list[str], low: float = 0.0, absolute: bool = False, label: Column | None = None, labelled_only: bool = False) -> DataFrame:
    """samples (sample, grp, pct_matched, taxon, n_found, n_total): grp, label, a column for
    each name, species, taxon and total, of groups of any of the levels.

    Values are percents of a sample's reads, or with `absolute` its reads, of which groups
    that round to none are left out. `Unknown` has what the groups of the first level leave
    over. A group's taxon is that of the first sample, by the order of names, that has it;
    species is its eighth part, or `-`. label: an expression over `taxon`, which then has no
    last bracket; without one all are `non`. labelled_only: groups labelled `non` go."""
    pct = F.col("pct_matched") * F.col("n_found") / F.col("n_total")
    value = F.round(F.col("pct_matched") / 100 * F.col("n_found")) if absolute else pct
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("sample"))
    here = samples.where(F.col("sample").isin(names))
    wanted = reduce(lambda a, x: a | F.startswith("grp", F.lit(x)), levels, F.lit(False))
    rows = here.where(wanted & (pct >= low)).select("sample", "grp", "taxon", place.alias("_place"), value.alias("v"))
    rows = rows.where("v > 0") if absolute else rows
    whole = F.col("n_total").cast("double") if absolute else F.lit(100.0)
    totals = here.groupBy("sample").agg(F.first("n_total").alias("n_total")).select("sample", whole.alias("whole"))
    known = rows.where(F.startswith("grp", F.lit(levels[0]))).groupBy("sample").agg(F.sum("v").alias("k"))
    dark = totals.join(known, "sample", "left").select("sample", F.lit("Unknown").alias("grp"), F.lit(DARK).alias("taxon"), F.lit(0).alias("_place"), (F.col("whole") - F.coalesce("k", F.lit(0.0))).alias("v"))
    both = rows.unionByName(dark)
    cells = [F.coalesce(F.sum(F.when(F.col("sample") == n, F.col("v"))), F.lit(0.0)).alias(n) for n in names]
    total = F.sum(F.when(F.col("grp") == "Unknown", 0.0).otherwise(F.col("v"))).alias("total")
    table = both.groupBy("grp").agg(*cells, F.min(F.struct("_place", "taxon"))["taxon"].alias("taxon"), total)
    bare = F.regexp_replace("taxon", r"\([^(]*$", "")
    named = table.withColumn("_taxon", F.col("taxon")).withColumn("taxon", bare).withColumn("label", F.lit("non") if label is None else label)
    species = F.when(F.col("_taxon") == DARK, "-").otherwise(F.coalesce(F.get(F.split("_taxon", r"\|"), F.lit(7)), F.lit("-")))
    out = named.select("grp", "label", *[F.col(f"`{n}`") for n in names], species.alias("species"), F.col("_taxon").alias("taxon"), "total")
    return out.where("label <> 'non'") if labelled_only else out
