"""The catalogue of references: selection, ingest, updates."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.config import LEVELS

# Named selections (tag, least size, most size, super-kingdoms; "-": none).
PRESETS = {
    "Virus": ("p==a", 0, 100_000_000, ("Viroids", "Viruses")),
    "representative": ("r==a", 0, 100_000_000, ("Bacteria", "Archaea")),
    "subpopulation": ("p!=r;p==a", 0, 100_000_000, ("Bacteria", "Archaea")),
    "Eukaryota": ("p==a", 0, 200_000_000, ("Eukaryota", "-")),
}
# Size buckets of the sketch index (name, largest entry, least and most asked).
SIZE_BUCKETS = (
    ("virus", 120_000, 0, 250_000),
    ("default", 6_000_000, 50_000, 10_000_000),
    ("large", 12_000_000, 2_500_000, 25_000_000),
    ("eukaryota", 120_000_000_000, 5_000_000, 250_000_000_000),
)


# SHA-256 of nothing.
EMPTY = hashlib.sha256().hexdigest()


def active(catalog: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Rows that are not marked as deleted."""
    return catalog if include_deleted else catalog.where(F.col("deleted").isNull())


def tag_filter(tag: str, level=F.col) -> Column:
    """Clauses like `a==b;c!=d`, all of which must hold: the numbers at two levels agree or
    not. Only the first and the last letter of a clause name levels; all that has no `==`
    asks for a difference."""
    out = F.lit(True)
    for clause in filter(None, (c.strip() for c in tag.split(";"))):
        a, b = clause[0], clause[-1]
        if a not in LEVELS or b not in LEVELS:
            raise ValueError(f"no such level in {clause!r}")
        out = out & (level(a) == level(b) if "==" in clause else level(a) != level(b))
    return out


def select(catalog: DataFrame, values: dict[str, str] | None = None, least=None, most=None, group: str | None = None, tag: str = "", strict_group: bool = False) -> DataFrame:
    """Rows whose columns are among comma-separated values, in a size range (both ends
    included), in an address group (a pattern anywhere in the address, or its strict prefix)
    and that meet the tag. Unknown columns are refused."""
    found = catalog
    for c, v in (values or {}).items():
        if c not in catalog.columns:
            raise KeyError(f"no column {c!r}")
        found = found.where(F.col(c).cast("string").isin(v.split(",")))
    if least is not None:
        found = found.where(F.col("size") >= least)
    if most is not None:
        found = found.where(F.col("size") <= most)
    if group:
        at = (F.col("barcode") == group) | F.startswith("barcode", F.lit(group + ".")) if strict_group else F.col("barcode").rlike(group)
        found = found.where(at)
    return found.where(tag_filter(tag)) if tag else found


def preset(catalog: DataFrame, name: str) -> DataFrame:
    tag, least, most, kingdoms = PRESETS[name]
    named = catalog.where(F.coalesce("superkingdom", F.lit("-")).isin(*kingdoms))
    return select(named, None, least, most, tag=tag)


def size_bucket(size: Column) -> Column:
    """The first bucket that takes an entry of this size."""
    return reduce(lambda acc, b: F.when(size <= b[1], b[0]).otherwise(acc), reversed(SIZE_BUCKETS), F.lit(None).cast("string"))


def buckets_asked(size: Column) -> Column:
    """Buckets in which to look for neighbours of this size; they overlap on purpose."""
    asked = F.array(*[F.when(size.between(b[2], b[3]), b[0]) for b in SIZE_BUCKETS])
    return F.filter(asked, lambda x: x.isNotNull())


def eligible(listed: DataFrame) -> DataFrame:
    """Listed references to take in: with a url or file, not excluded, latest, full. A
    column that the list lacks passes."""
    has = lambda c: F.col(c) if c in listed.columns else F.lit(None).cast("string")
    there = has("ftp_path").isNotNull() | has("file_path").isNotNull() | has("url_path").isNotNull()
    ok = has("excluded_from_refseq").isNull() & (F.coalesce(has("version_status"), F.lit("latest")) == "latest") & (F.coalesce(has("genome_rep"), F.lit("Full")) == "Full")
    return listed.where(there & ok)


def url_path(ftp_path: Column) -> Column:
    """Where the sequence of an assembly folder lies."""
    whole = F.concat(ftp_path, F.lit("/"), F.substring_index(ftp_path, "/", -1), F.lit("_genomic.fna.gz"))
    return F.when(F.endswith(ftp_path, F.lit(".fna.gz")), ftp_path).otherwise(whole)


def version(accession: Column) -> Column:
    """The number after the last dot, or 1."""
    return F.when(F.contains(accession, F.lit(".")), F.coalesce(F.substring_index(accession, ".", -1).try_cast("int"), F.lit(1))).otherwise(1)


def rank_of(value: Column, order: list[str], last: int | None = None) -> Column:
    """Place of a value in an order; what is not in it comes last."""
    return reduce(lambda acc, x: F.when(value == x[1], x[0]).otherwise(acc), enumerate(order), F.lit(len(order) if last is None else last))


def phylum_priority(superkingdom: Column, kingdom: Column, phylum: Column, first: list[str]) -> Column:
    """Order in which phyla are indexed: smaller first."""
    outside = F.coalesce(superkingdom.isin("Archaea", "Bacteria"), F.lit(False))
    large = kingdom.isNull() | kingdom.isin("Metazoa", "Viridiplantae")
    return F.when(outside, 0).otherwise(100) + F.when(large, 10).otherwise(0) + F.when(F.coalesce(phylum.isin(*first), F.lit(False)), 1).otherwise(0)


def first_of_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """rows with their content's hash and whether they are its first row (least key). The
    least key is a pre-aggregated minimum, so many copies of one text meet in no task. A null
    content is like an empty one; neither is content, so no row of it is a first one."""
    hashed = rows.withColumn("sha256", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256))
    first = hashed.groupBy("sha256").agg(F.min(key).alias("_first"))
    return hashed.join(first.withColumn("sha256", F.concat("sha256", F.lit(""))), "sha256").withColumn("is_first", (F.col(key) == F.col("_first")) & (F.col("sha256") != EMPTY)).drop("_first")


def upsert(catalog: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(catalogue with the given columns updated, log of (key, field, old, new)). Null and
    empty values leave a field as it is; rows that the catalogue lacks are not added. Of
    several updates of a field the largest value stands, and no row is multiplied."""
    clean = updates.groupBy(key).agg(*[F.max(F.when(F.col(c) != "", F.col(c))).alias(f"_{c}") for c in columns])
    both = catalog.join(clean, key, "left")
    now = {c: F.coalesce(f"_{c}", F.col(c).cast("string")) for c in columns}
    merged = both.select(*[now[c].cast(catalog.schema[c].dataType).alias(c) if c in now else F.col(c) for c in catalog.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old_value"), F.col(f"_{c}").alias("new_value")) for c in columns])
    log = both.select(key, F.explode(cells).alias("x")).select(key, "x.*").where("new_value is not null and not new_value <=> old_value")
    return merged, log


def closure(nodes: DataFrame, max_rounds: int = 32) -> DataFrame:
    """nodes (id, parent), roots their own parent or none: (id, ancestor, depth), itself
    included. Paths double each round, so a tree of depth d takes log2 d joins."""
    from lineagelake.session import checkpoint

    clean = checkpoint(nodes.where("parent is not null and parent <> id").select("id", "parent"))
    paths = checkpoint(clean.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    span = 1
    for _ in range(max_rounds):
        far = paths.where(F.col("depth") == span).select("id", F.col("ancestor").alias("_mid"))
        more = far.join(paths.select(F.col("id").alias("_mid"), "ancestor", (F.col("depth") + span).alias("depth")), "_mid").select("id", "ancestor", "depth")
        if not more.limit(1).count():
            return paths.unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
        paths, span = checkpoint(paths.unionByName(more)), span * 2
    raise RuntimeError("the tree is too deep, or has a cycle")


def star_informal(name: Column, formal: Column) -> Column:
    """Informal species names get a star in front."""
    return F.when(formal, name).otherwise(F.concat(F.lit("*"), name))


def card(catalog: DataFrame, group: str, label: str, share: float = 0.1) -> DataFrame:
    """Of each group: members, its first member, and its labels with more than a share of
    the most frequent one, most frequent first."""
    counts = catalog.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    top = counts.groupBy(group).agg(F.max("n").alias("top"))
    votes = counts.join(top, group).where(F.col("n") > share * F.col("top"))
    listed = votes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), label))).alias("v"))
    names = F.array_join(F.transform("v", lambda x: F.concat_ws(":", x[label], (-x["n"]).cast("string"))), "|")
    return catalog.groupBy(group).agg(F.count("*").alias("members"), F.min("index").alias("first_index")).join(listed.select(group, names.alias("labels")), group, "left")


def pack(items: DataFrame, capacity: int, spread: int = 16) -> DataFrame:
    """items (index, size): (index, size, shard), shards filled by falling size class up to
    about `capacity`. Sums before each item come from sums of small groups of a size class,
    so that no task sees all items."""
    classed = items.withColumn("_class", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("long")).withColumn("_sub", F.pmod(F.col("index"), F.lit(spread)))
    groups = classed.groupBy("_class", "_sub").agg(F.sum("size").alias("_sum"))
    before = Window.orderBy(F.desc("_class"), "_sub").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.coalesce(1).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_class", "_sub").orderBy(F.desc("size"), "index").rowsBetween(Window.unboundedPreceding, -1)
    run = classed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(groups), ["_class", "_sub"])
    return run.select("index", "size", F.floor((F.col("_before") + F.col("_in")) / capacity).cast("long").alias("shard"))


def conform(rows: DataFrame, columns: list[str], blank: str | None = None) -> DataFrame:
    """The given columns in their order; those that are missing are null or `blank`."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(blank).cast("string").alias(c) for c in columns])


def pick(catalog: DataFrame, chosen: DataFrame, key: str = "index") -> DataFrame:
    """Rows that a list names, each once however often it is named."""
    return catalog.join(chosen.select(key).distinct(), key, "left_semi")


def novel(listed: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Listed rows none of whose fields' values is known: by rows of (field, value), so that
    "or" needs no nested loop. Nulls match nothing."""
    values = lambda df, *c: df.select(*c, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).where("x.v is not null")
    met = values(listed, key).join(values(known).distinct(), "x", "left_semi").select(key).distinct()
    return listed.join(met, key, "left_anti")


def stem(accession: Column) -> Column:
    """An accession without its version."""
    return F.regexp_replace(accession, r"\.[^.]*$", "")


def refresh(catalog: DataFrame, listed: DataFrame, columns: list[str], accession: str = "assembly_accession") -> DataFrame:
    """Catalogue rows whose accession stem is listed take the newest listed row's columns."""
    newest = F.max(F.struct(version(F.col(accession)).alias("v"), *[F.col(c).alias(f"_{c}") for c in columns])).alias("new")
    found = listed.where(F.col(accession).isNotNull()).groupBy(stem(F.col(accession)).alias("_stem")).agg(newest)
    both = catalog.withColumn("_stem", stem(F.col(accession))).join(found, "_stem", "left")
    return both.select(*[F.coalesce(F.col("new")[f"_{c}"], F.col(c)).alias(c) if c in columns else F.col(c) for c in catalog.columns])


def lineage(nodes: DataFrame, ranks: list[str]) -> DataFrame:
    """nodes (id, parent, rank, name): (id, a column for each rank), the name of the nearest
    ancestor of that rank, itself included."""
    named = nodes.where(F.col("rank").isin(*ranks)).select(F.col("id").alias("ancestor"), "rank", "name")
    above = closure(nodes.select("id", "parent")).join(named, "ancestor")
    nearest = [F.min(F.when(F.col("rank") == r, F.struct("depth", "name")))["name"].alias(r) for r in ranks]
    return nodes.select("id").join(above.groupBy("id").agg(*nearest), "id", "left")


def fill(catalog: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that are null are taken from `found`; what is there stays."""
    other = found.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return catalog.join(other, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in catalog.columns])


def ingest_keys(category: str = "refseq_category", level: str = "assembly_level", accession: str = "assembly_accession") -> list[Column]:
    """Order of taking in: category, assembly level, newest version, accession."""
    return [rank_of(F.col(category), ["reference genome", "representative genome"]), rank_of(F.col(level), ["Complete Genome", "Chromosome"]), F.desc(version(F.col(accession))), F.col(accession)]


def numbered(rows: DataFrame, *order: Column | str, name: str = "n", start: int = 0) -> DataFrame:
    """rows with consecutive numbers in an order. Rows are sorted by range over all tasks;
    only the sizes of the partitions are added up in one."""
    from lineagelake.session import checkpoint

    placed = checkpoint(rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = sizes.select("_part", (before - F.col("_first") + start).alias("_offset"))
    return placed.join(F.broadcast(offset), "_part").withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def allocate(rows: DataFrame, catalog: DataFrame, *order: Column | str, key: str = "index") -> DataFrame:
    """New rows with keys from the catalogue's largest on."""
    most = catalog.agg(F.max(key)).first()[0]
    return numbered(rows, *order, name=key, start=(most or 0) + 1)


def first_shards(items: DataFrame, capacity: int) -> DataFrame:
    """One row: items, their size and the number of shards to begin with."""
    return items.agg(F.count("*").alias("n_items"), F.sum("size").alias("size"), F.ceil(F.sum("size") / F.lit(capacity)).cast("long").alias("shards"))


def discover(members: DataFrame, names: str) -> DataFrame:
    """Members of the mapping databases of a comma-separated list; a missing one is an error."""
    wanted = [x for x in names.split(",") if x]
    found = members.where(F.col("mapdb").isin(*wanted))
    there = {r[0] for r in found.select("mapdb").distinct().collect()}
    if missing := sorted(set(wanted) - there):
        raise KeyError(f"no mapping database {missing}")
    return found


def sequence_dictionary(members: DataFrame) -> DataFrame:
    """members (mapdb, shard, seq_name, tax_id): adds seq_id, numbers from 0 by database, shard and name."""
    return numbered(members, "mapdb", "shard", "seq_name", "tax_id", name="seq_id")


def representatives(rows: DataFrame, group: str, key: str, columns: list[str]) -> DataFrame:
    """The first member (least key) of each group, with these columns."""
    first = F.min(F.struct(key, *columns)).alias("_first")
    return rows.groupBy(group).agg(first).select(group, *[F.col("_first")[c].alias(c) for c in (key, *columns)])


def append_members(present: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(key, mark) of a mapping database that is added to: 1 for what is there, each once, 2
    for what is chosen and not there."""
    there = present.select(key).distinct()
    new = chosen.select(key).distinct().join(there, key, "left_anti")
    return there.select(key, F.lit(1).alias("mark")).unionByName(new.select(key, F.lit(2).alias("mark")))
