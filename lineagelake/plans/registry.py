"""The registered queries over the given tables, and their SQL for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.config import LEVELS, PRIORS, THRESHOLDS
from lineagelake.functions import barcode
from lineagelake.operators import alignment, mixture, neighbours, profile, sketch
from lineagelake.operators import catalog as cat
from lineagelake.plans import mapping
from lineagelake.session import checkpoint, stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
K, S = 23, 64
RULES = [("^(red|blue) ", "colour"), ("ring$", "shape"), ("^small", "size"), ("widget", "zz")]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c), digits).alias(c)


ADDRESSES = f"addresses AS (SELECT s_suppkey AS tax_id, CAST(n_regionkey AS BIGINT) AS u, CAST(s_nationkey AS BIGINT) AS s, {', '.join(f's_suppkey AS {x}' for x in LEVELS[2:])} FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
CATALOG = f"""{ADDRESSES}, catalog AS (SELECT s_suppkey AS "index", CAST(round(s_acctbal * 10000) AS BIGINT) AS size, r_name AS region, s_name AS species,
  CASE r_name WHEN 'AFRICA' THEN 'Bacteria' WHEN 'AMERICA' THEN 'Archaea' WHEN 'ASIA' THEN 'Viruses' WHEN 'EUROPE' THEN 'Eukaryota' END AS superkingdom,
  {', '.join('a.' + x for x in LEVELS)}, {" || '.' || ".join(f"'{x}' || a.{x}" for x in LEVELS)} AS barcode
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN addresses a ON a.tax_id = s_suppkey)"""


@query(f"""WITH {CATALOG} SELECT "index", size, barcode, region FROM catalog WHERE region IN ('ASIA', 'EUROPE') AND size BETWEEN 0 AND 60000000 AND s <> r""")
def catalog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cat.select(mapping.catalog(spark, sf_dir), {"region": "ASIA,EUROPE"}, 0, 60_000_000, tag="s!=r")
    return found.select("index", "size", "barcode", "region")


@query(f"""WITH {CATALOG} SELECT 'Virus' AS preset, "index", barcode FROM catalog WHERE superkingdom IN ('Viroids', 'Viruses') AND size BETWEEN 0 AND 100000000 AND p = a
UNION ALL SELECT 'representative', "index", barcode FROM catalog WHERE superkingdom IN ('Bacteria', 'Archaea') AND size BETWEEN 0 AND 100000000 AND r = a
UNION ALL SELECT 'subpopulation', "index", barcode FROM catalog WHERE superkingdom IN ('Bacteria', 'Archaea') AND size BETWEEN 0 AND 100000000 AND p <> r AND p = a
UNION ALL SELECT 'Eukaryota', "index", barcode FROM catalog WHERE coalesce(superkingdom, '-') IN ('Eukaryota', '-') AND size BETWEEN 0 AND 200000000 AND p = a""")
def catalog_presets(spark, sf_dir):
    rows = mapping.catalog(spark, sf_dir)
    parts = [cat.preset(rows, name).select(F.lit(name).alias("preset"), "index", "barcode") for name in cat.PRESETS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {CATALOG} SELECT "index", u, s, r, 'u' || u || '.s' || s || '.r' || r AS prefix FROM catalog WHERE starts_with(barcode, 'u1.') OR barcode SIMILAR TO '.*s1[0-9]*\\..*'""")
def barcode_levels(spark, sf_dir):
    found = mapping.catalog(spark, sf_dir).select("index", "barcode")
    found = cat.select(found, group="u1", strict_group=True).unionByName(cat.select(found, group=r"s1[0-9]*\.")).distinct()
    return found.withColumn("b", barcode.parse(F.col("barcode"))).select("index", "b.u", "b.s", "b.r", barcode.prefix(F.col("barcode"), "r").alias("prefix"))


@query("""SELECT o_orderkey AS id, 'x/GCF_' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '.fna.gz' ELSE '/GCF_' || o_orderkey || '_genomic.fna.gz' END AS url_path,
CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE CAST(o_orderkey % 3 AS INT) END AS version FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' AND o_custkey % 11 <> 0""")
def ingest_eligible(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    base = F.concat(F.lit("x/GCF_"), key.cast("string"))
    listed = o.select(
        key.alias("id"), F.when(F.col("o_custkey") % 11 != 0, F.when(key % 4 == 0, F.concat(base, F.lit(".fna.gz"))).otherwise(base)).alias("ftp_path"), F.when(F.col("o_orderpriority") == "5-LOW", "yes").alias("excluded_from_refseq"),
        F.when(F.col("o_orderstatus") == "F", "latest").otherwise("replaced").alias("version_status"), F.when(key % 3 == 0, "GCF_1.x").otherwise(F.concat(F.lit("GCF_1."), (key % 3).cast("string"))).alias("accession"),
    )
    return cat.eligible(listed).select("id", cat.url_path(F.col("ftp_path")).alias("url_path"), cat.version(F.col("accession")).alias("version"))


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT doc_id, sha256, doc_id = min(doc_id) OVER (PARTITION BY sha256) AND sha256 <> sha256('') AS is_first FROM h""")
def content_dedup(spark, sf_dir):
    return cat.first_of_content(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "sha256", "is_first")


@query("""SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END AS category_rank,
CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 0 ELSE 100 END + CASE WHEN p_size % 5 = 0 OR p_name LIKE 'red%' THEN 10 ELSE 0 END + CASE WHEN p_name LIKE '%ring' THEN 1 ELSE 0 END AS priority FROM part""")
def ingest_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kingdom = F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string")).when(F.startswith("p_name", F.lit("red")), "Metazoa").otherwise("Fungi")
    above = F.when(F.col("p_brand") == "Brand#1", "Archaea").when(F.col("p_brand") == "Brand#2", "Bacteria")
    phylum = F.when(F.endswith("p_name", F.lit("ring")), "first")
    rank = cat.rank_of(F.col("p_type"), ["ECONOMY", "STANDARD"])
    return p.select(F.col("p_partkey").alias("id"), rank.alias("category_rank"), cat.phylum_priority(above, kingdom, phylum, ["first"]).alias("priority")).orderBy("priority", "category_rank", "id")


@query("""WITH RECURSIVE nodes AS (SELECT CAST(r_regionkey AS BIGINT) + 1000000000 AS id, CAST(NULL AS BIGINT) AS parent FROM region UNION ALL
SELECT CAST(n_nationkey AS BIGINT) + 2000000000, CAST(n_regionkey AS BIGINT) + 1000000000 FROM nation UNION ALL SELECT s_suppkey, CAST(s_nationkey AS BIGINT) + 2000000000 FROM supplier),
walk AS (SELECT id, id AS ancestor, 0 AS depth FROM nodes UNION ALL SELECT w.id, n.parent, w.depth + 1 FROM walk w JOIN nodes n ON n.id = w.ancestor WHERE n.parent IS NOT NULL)
SELECT id, ancestor, CAST(depth AS INT) AS depth FROM walk""")
def lineage_closure(spark, sf_dir):
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey").cast("long") + 1_000_000_000).alias("id"), F.lit(None).cast("long").alias("parent"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 2_000_000_000).alias("id"), (F.col("n_regionkey").cast("long") + 1_000_000_000).alias("parent"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey").cast("long") + 2_000_000_000).alias("parent"))
    return cat.closure(region.unionByName(nation).unionByName(supplier))


@query("""SELECT p_partkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A') THEN p_name ELSE '*' || p_name END AS name FROM part""")
def informal_names(spark, sf_dir):
    formal = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("ok")).distinct()
    both = table(spark, sf_dir, "part").join(formal, "p_partkey", "left")
    return both.select(F.col("p_partkey").alias("id"), cat.star_informal(F.col("p_name"), F.coalesce("ok", F.lit(False))).alias("name"))


@query("""SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old_value, 'AUTOMOBILE' AS new_value FROM customer WHERE c_custkey % 7 = 0 AND c_mktsegment <> 'AUTOMOBILE'
UNION ALL SELECT c_custkey, 'c_name', c_name, upper(c_name) FROM customer WHERE c_custkey % 7 = 0 AND c_name <> upper(c_name)""")
def catalog_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    updates = c.where("c_custkey % 7 in (0, 1)").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "AUTOMOBILE").otherwise("").alias("c_mktsegment"), F.when(F.col("c_custkey") % 7 == 0, F.upper("c_name")).alias("c_name"))
    return cat.upsert(c, updates, "c_custkey", ["c_mktsegment", "c_name"])[1]


@query("""WITH g AS (SELECT s_nationkey, s_suppkey, 'b' || (s_suppkey % 6) AS label FROM supplier), c AS (SELECT s_nationkey, label, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT s_nationkey, string_agg(label || ':' || n, '|' ORDER BY n DESC, label) AS labels FROM (SELECT *, max(n) OVER (PARTITION BY s_nationkey) AS top FROM c) WHERE n > 0.1 * top GROUP BY ALL)
SELECT s_nationkey AS grp, count(*) AS members, min(s_suppkey) AS first_index, any_value(labels) AS labels FROM g JOIN t USING (s_nationkey) GROUP BY ALL""")
def cluster_card(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("index"), F.concat(F.lit("b"), (F.col("s_suppkey") % 6).cast("string")).alias("label"))
    return cat.card(s, "grp", "label")


@query("""WITH d AS (SELECT doc_id AS "index", n_chars AS size, CAST(floor(log2(CAST(greatest(n_chars, 1) AS DOUBLE))) AS BIGINT) AS c, doc_id % 16 AS b FROM documents)
SELECT "index", size, CAST(floor(coalesce(sum(size) OVER (ORDER BY c DESC, b, size DESC, "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 200000) AS BIGINT) AS shard FROM d""")
def shard_packing(spark, sf_dir):
    return cat.pack(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("n_chars").alias("size")), 200_000)


@query("""SELECT s_suppkey AS "index", CASE WHEN s_acctbal <= 12 THEN 'virus' WHEN s_acctbal * 10000 <= 6000000 THEN 'default' WHEN s_acctbal * 10000 <= 12000000 THEN 'large' ELSE 'eukaryota' END AS bucket,
concat_ws(',', CASE WHEN s_acctbal * 10000 BETWEEN 0 AND 250000 THEN 'virus' END, CASE WHEN s_acctbal * 10000 BETWEEN 50000 AND 10000000 THEN 'default' END, CASE WHEN s_acctbal * 10000 BETWEEN 2500000 AND 25000000 THEN 'large' END, CASE WHEN s_acctbal * 10000 BETWEEN 5000000 AND 250000000000 THEN 'eukaryota' END) AS asked FROM supplier""")
def size_buckets(spark, sf_dir):
    size = F.col("s_acctbal") * 10_000
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("index"), cat.size_bucket(size).alias("bucket"), F.array_join(cat.buckets_asked(size), ",").alias("asked"))


@query("""WITH chosen AS (SELECT DISTINCT l_suppkey AS "index" FROM lineitem WHERE l_returnflag = 'R'), present AS (SELECT DISTINCT l_suppkey AS "index" FROM lineitem WHERE l_linenumber = 7)
SELECT "index", CASE WHEN "index" IN (SELECT "index" FROM present) THEN 1 ELSE 2 END AS mark FROM (SELECT "index" FROM chosen UNION SELECT "index" FROM present)""")
def mapping_append(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    index = F.col("l_suppkey").alias("index")
    return cat.append_members(li.where("l_linenumber = 7").select(index), li.where("l_returnflag = 'R'").select(index), "index")


SAM = """s AS (SELECT *, list_transform(regexp_extract_all(cigar, '([0-9]+)[SH]', 1), lambda x: CAST(x AS BIGINT)) AS clips FROM (SELECT l_orderkey AS read_id, l_suppkey AS tax_id, l_suppkey * 4 + l_partkey % 4 AS seq_id, CAST(l_extendedprice AS BIGINT) AS site, l_linenumber,
(l_linenumber - 1) || 'S' || CAST(l_quantity AS BIGINT) || 'M2I' || (l_partkey % 9) || 'H' AS cigar, CAST(l_quantity + 90 AS BIGINT) AS len, l_quantity AS score FROM lineitem))"""


@query(f"""WITH {SAM}, ok AS (SELECT * FROM s WHERE NOT (list_sum(clips) > 100 OR 2 * list_sum(clips) >= len OR list_min(clips) > 4)),
f AS (SELECT *, row_number() OVER (PARTITION BY read_id, tax_id ORDER BY l_linenumber, seq_id, site, cigar, score) AS n FROM ok)
SELECT read_id, tax_id, count(*) AS n_hits, round(sum((2 * len - (score + 1.5 * list_max(clips))) / 6), 4) AS mut FROM f WHERE n = 1 GROUP BY ALL""")
def sam_hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    seq = F.col("l_suppkey") * 4 + F.col("l_partkey") % 4
    cigar = F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit("S"), F.col("l_quantity").cast("long").cast("string"), F.lit("M2I"), (F.col("l_partkey") % 9).cast("string"), F.lit("H"))
    rows = li.select(F.struct("l_linenumber", seq.alias("seq"), F.col("l_extendedprice").alias("site"), cigar.alias("cigar"), "l_quantity").alias("ord"), F.lit(1).alias("mate"), F.lit(0).alias("flag"), F.col("l_orderkey").alias("read_id"), F.concat(F.lit("seq"), seq.cast("string")).alias("ref"), F.col("l_extendedprice").alias("pos"), cigar.alias("cigar"), F.repeat(F.lit("A"), (F.col("l_quantity") + 90).cast("int")).alias("seq"), F.col("l_quantity").alias("score"))
    refs = mapping.seqinfo(spark, sf_dir).select(F.concat(F.lit("seq"), F.col("seq_id").cast("string")).alias("ref"), "seq_id", "tax_id")
    return alignment.from_sam(rows, refs).groupBy("read_id", "tax_id").agg(F.count("*").alias("n_hits"), F.round(F.sum("mut"), 4).alias("mut"))


A, B = math.log(0.05), math.log(0.95)
HITS = f"hits AS (SELECT {mapping.HITS_COLUMNS} FROM lineitem)"
MERGED = f"""{HITS}, m0 AS (SELECT read_id, tax_id, sum(mut) AS m, sum(nom) AS n, min({{'ord': ord, 'seq_id': seq_id, 'site': site}}) AS f FROM hits GROUP BY ALL),
m1 AS (SELECT *, max(m + n) OVER (PARTITION BY read_id) - m - n AS d FROM m0),
merged AS (SELECT read_id, tax_id, f.seq_id AS seq_id, f.site AS site, m + 0.1 * d AS mut, n + 0.9 * d AS nom FROM m1)"""
SCORED = f"""{MERGED}, s0 AS (SELECT *, mut * ({A!r}) + nom * ({B!r}) - (mut + nom) * ({0.05 * A + 0.95 * B!r}) AS score FROM merged),
scored AS (SELECT *, exp(score) AS lik, exp(score - max(score) OVER (PARTITION BY read_id)) AS rel_sim FROM s0)"""
NEAR = f"{SCORED}, near AS (SELECT * FROM scored WHERE rel_sim >= {(0.05 / 0.95) ** 5!r})"


def _merged(spark, sf_dir):
    return alignment.merge_pairs(mapping.hits(spark, sf_dir))


def _scored(spark, sf_dir):
    return alignment.similarity(_merged(spark, sf_dir))


@query(f"WITH {MERGED} SELECT read_id, tax_id, seq_id, site, round(mut, 6) AS mut, round(nom, 6) AS nom FROM merged")
def merge_pairs(spark, sf_dir):
    return _merged(spark, sf_dir).select("read_id", "tax_id", "seq_id", "site", _r("mut"), _r("nom"))


@query(f"WITH {NEAR} SELECT read_id, tax_id, round(score, 3) + 0.0 AS score, round(rel_sim, 4) AS rel_sim FROM near")
def similarity_scores(spark, sf_dir):
    return alignment.near_best(_scored(spark, sf_dir)).select("read_id", "tax_id", _r("score", 3), _r("rel_sim", 4))


def _core_sql() -> str:
    parts = []
    for i, ((up, down), (prior, c, a)) in enumerate(zip(alignment.PAIRS[:2], PRIORS)):
        like = lambda w, p: f"exp(greatest(-700.0, {math.log(w)!r} + p * ({math.log(p)!r}) + (t - p) * ({math.log(1 - p)!r})))"
        parts.append(f"""t{i} AS (SELECT {up} AS k, count(DISTINCT {down}) AS t FROM placed GROUP BY 1), h{i} AS (SELECT read_id, {up} AS k, {down} AS d, max(rel_sim) AS w FROM placed GROUP BY ALL),
e{i} AS (SELECT read_id, k, count(*) AS p, arg_min(w, d) AS w FROM h{i} GROUP BY ALL), a{i} AS (SELECT read_id, sum(p * w) / sum(w) AS p, sum(t * w) / sum(w) AS t FROM e{i} JOIN t{i} USING (k) GROUP BY 1),
q{i} AS (SELECT read_id, {like(prior, c)} / ({like(prior, c)} + {like(1 - prior, a)}) AS q FROM a{i})""")
    return f"{SCORED}, {ADDRESSES}, placed AS (SELECT * FROM scored JOIN addresses USING (tax_id)), {', '.join(parts)}"


@query(f"WITH {_core_sql()} SELECT read_id, round(1 - (1 - q0.q) * (1 - q1.q), 6) AS core_w FROM q0 JOIN q1 USING (read_id)")
def conservation_weights(spark, sf_dir):
    """Levels r to m have one sub-cluster each here, which ends the series after two pairs."""
    return alignment.conservation(stored(_scored(spark, sf_dir)), mapping.addresses(spark, sf_dir)).select("read_id", _r("core_w"))


def _depth_sql(fragment: int) -> str:
    return f"""SELECT {fragment} AS fragment, tax_id, CASE WHEN most <= 1 THEN 0.5 ELSE round(hits / room, 6) END AS mean, hits FROM
(SELECT tax_id, CAST(sum(n) AS BIGINT) AS hits, max(n) AS most FROM (SELECT seq_id, tax_id, floor(site / {fragment}) AS b, count(*) AS n FROM near GROUP BY ALL) GROUP BY 1)
JOIN (SELECT tax_id, sum(1 + seq_len // {fragment}) + count(*) - 1 AS room FROM seqinfo WHERE tax_id IN (SELECT tax_id FROM near) GROUP BY 1) USING (tax_id)"""


SEQINFO = f"seqinfo AS (SELECT {mapping.SEQINFO_COLUMNS} FROM supplier, range(4) AS r(slot))"


@query(f"WITH {NEAR}, {SEQINFO} {_depth_sql(487)} UNION ALL {_depth_sql(2000)}")
def depth_means(spark, sf_dir):
    near, info = checkpoint(alignment.near_best(_scored(spark, sf_dir))), mapping.seqinfo(spark, sf_dir)
    parts = []
    for fragment in (487, 2000):
        bins, mean = alignment.bin_depths(near, info, fragment)
        sums = bins.join(info.select("seq_id", "tax_id"), "seq_id").groupBy("tax_id").agg(F.sum("n").alias("hits"))
        parts.append(mean.join(sums, "tax_id").select(F.lit(fragment).alias("fragment"), "tax_id", _r("mean"), "hits"))
    return parts[0].unionByName(parts[1])


def _weighed(spark, sf_dir):
    return alignment.weigh(mapping.hits(spark, sf_dir), mapping.seqinfo(spark, sf_dir), mapping.addresses(spark, sf_dir))


def _weight_sql() -> str:
    """CTE weighed: near hits with depth_w, core_w and weight. Means times sqrt 2 are below 20
    in the given tables, where the model is the exact Poisson mass; past it SQL has null."""
    parts = [f"{_core_sql()}, near AS (SELECT * FROM scored WHERE rel_sim >= {(0.05 / 0.95) ** 5!r}), {SEQINFO}, core AS (SELECT read_id, 1 - (1 - q0.q) * (1 - q1.q) AS core_w FROM q0 JOIN q1 USING (read_id))"]
    for i, fragment in enumerate((487, 2000)):
        p = lambda x, m: f"({x} * ln({m}) - {m} - lgamma({x} + 1.0))"
        low, high = f"(mean / {math.sqrt(2)!r})", f"(mean * {math.sqrt(2)!r})"
        parts.append(f"""bin{i} AS (SELECT seq_id, tax_id, CAST(floor(site / {fragment}) AS BIGINT) AS b, count(*) AS n FROM near GROUP BY ALL),
room{i} AS (SELECT tax_id, sum(1 + seq_len // {fragment}) + count(*) - 1 AS room FROM seqinfo WHERE tax_id IN (SELECT tax_id FROM near) GROUP BY 1),
mean{i} AS (SELECT tax_id, CASE WHEN max(n) <= 1 THEN 0.5 ELSE CAST(sum(n) AS DOUBLE) / any_value(room) END AS mean FROM bin{i} JOIN room{i} USING (tax_id) GROUP BY 1),
ratio{i} AS (SELECT seq_id, b, CASE WHEN n > ceil({high}) THEN CASE WHEN n - ceil({high}) >= 20 * sqrt(ceil({high})) THEN -230.2585 WHEN {high} <= 20 THEN least(0.0, {p('n', high)} - {p(f'ceil({high})', high)}) END
WHEN n < floor({low}) THEN CASE WHEN {low} <= 170 THEN least(0.0, {p('n', low)} - {p(f'floor({low})', low)}) END ELSE 0.0 END AS r{i} FROM bin{i} JOIN mean{i} USING (tax_id))""")
    return ", ".join(parts) + f""", dw AS (SELECT read_id, sum(CASE WHEN seq_len < 500 THEN 0 ELSE exp((r0 + r1) / 2) END * rel_sim) / sum(rel_sim) AS depth_w FROM near n JOIN seqinfo USING (seq_id)
JOIN ratio0 a ON a.seq_id = n.seq_id AND a.b = CAST(floor(site / 487) AS BIGINT) JOIN ratio1 b ON b.seq_id = n.seq_id AND b.b = CAST(floor(site / 2000) AS BIGINT) GROUP BY 1),
weighed AS MATERIALIZED (SELECT n.*, depth_w, core_w, depth_w * core_w AS weight FROM near n JOIN core USING (read_id) JOIN dw USING (read_id) WHERE depth_w * core_w > 0 AND lik > 0)"""


@query(f"WITH {_weight_sql()} SELECT read_id, tax_id, round(rel_sim, 6) AS rel_sim, round(depth_w, 6) AS depth_w, round(core_w, 6) AS core_w, round(weight, 6) AS weight FROM weighed")
def scored_hits(spark, sf_dir):
    return _weighed(spark, sf_dir).select("read_id", "tax_id", _r("rel_sim"), _r("depth_w"), _r("core_w"), _r("weight"))


PICKS = 16  # that SQL unrolls; the given tables have two to nine


def _cover_sql() -> str:
    parts = [f"{_weight_sql()}, lim AS MATERIALIZED (SELECT count(*) AS n_reads, greatest(count(*) * 0.0001, 12.0) AS lim FROM orders), c0 AS MATERIALIZED (SELECT read_id, tax_id, lik, rel_sim, weight, rel_sim * weight AS s FROM weighed WHERE core_w >= 0.01 AND depth_w >= 0.01 AND weight >= 0.001)"]
    for i in range(PICKS):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT tax_id, s FROM (SELECT tax_id, round(sum(s), 9) AS s FROM c{i} GROUP BY 1), lim WHERE s * 2.5 >= lim ORDER BY s DESC, tax_id LIMIT 1),
c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE tax_id <> (SELECT tax_id FROM p{i}) AND read_id NOT IN (SELECT read_id FROM c{i} WHERE rel_sim >= 0.5 AND tax_id = (SELECT tax_id FROM p{i})))""")
    picks = " UNION ALL ".join(f"SELECT {i} AS place, tax_id, s FROM p{i}" for i in range(PICKS))
    return f"{', '.join(parts)}, picks AS MATERIALIZED ({picks})"


@query(f"WITH {_cover_sql()} SELECT CAST(place AS INT) AS place, tax_id, round(s, 6) AS support, CAST(lim AS DOUBLE) AS read_limit FROM picks, lim")
def greedy_cover(spark, sf_dir):
    cands = mixture.candidates(_weighed(spark, sf_dir))
    picked, limit = mixture.cover(cands, table(spark, sf_dir, "orders").count(), 0.0001, 12.0)
    return spark.createDataFrame([(i, t, round(float(s), 6), float(limit)) for i, (t, s) in enumerate(picked)], "place int, tax_id long, support double, read_limit double")


def _by_nation(rows: DataFrame, spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tax_id"), F.col("s_nationkey").cast("long").alias("nation"))
    return rows.join(nation, "tax_id").withColumn("tax_id", F.col("nation")).drop("nation")


NATION = f"{NEAR}, n0 AS (SELECT read_id, CAST(s_nationkey AS BIGINT) AS tax_id, mut, nom, lik, rel_sim FROM near JOIN supplier ON s_suppkey = tax_id)"
ROUNDS = 40


def _em(q: str, rounds: int = ROUNDS) -> str:
    """CTEs of `rounds` sweeps over q (read_id, tax_id, q, w), from equal shares; at last shares (tax_id, x)."""
    parts = [f"tot AS MATERIALIZED (SELECT sum(w) AS total FROM (SELECT read_id, any_value(w) AS w FROM {q} GROUP BY 1))", f"x0 AS MATERIALIZED (SELECT tax_id, 1.0 / count(*) OVER () AS x FROM (SELECT DISTINCT tax_id FROM {q}))"]
    for i in range(rounds):
        parts.append(f"d{i} AS MATERIALIZED (SELECT read_id, sum(q * x) AS d FROM {q} JOIN x{i} USING (tax_id) GROUP BY 1), x{i + 1} AS MATERIALIZED (SELECT a.tax_id, sum(w * q * x / d) / any_value(total) AS x FROM {q} a JOIN x{i} USING (tax_id) JOIN d{i} USING (read_id), tot GROUP BY 1)")
    return f"{', '.join(parts)}, shares AS MATERIALIZED (SELECT tax_id, x FROM x{rounds})"


def _em_sql() -> str:
    return f"{NATION}, qn AS MATERIALIZED (SELECT read_id, tax_id, max(lik) AS q, 1.0 AS w FROM n0 GROUP BY ALL), {_em('qn')}"


def _nation_hits(spark, sf_dir):
    return checkpoint(_by_nation(alignment.near_best(_scored(spark, sf_dir)), spark, sf_dir).select("read_id", "tax_id", "mut", "nom", "lik", "rel_sim").withColumns({c: F.lit(1.0) for c in ("depth_w", "core_w", "weight")}))


def _shares(spark, hits):
    q = mixture.qmatrix(hits, hits.select("tax_id").distinct())
    found = mixture.mixture(q, iterations=ROUNDS, tolerance=0.0)
    return spark.createDataFrame([(t, x) for t, x in found.items()], "tax_id long, x double")


@query(f"WITH {_em_sql()} SELECT tax_id, round(x, 6) AS x FROM shares")
def mixture_shares(spark, sf_dir):
    return _shares(spark, _nation_hits(spark, sf_dir)).select("tax_id", _r("x"))


ASSIGNED = f"""{_em_sql()}, lim AS (SELECT 0.0399 * (SELECT count(DISTINCT read_id) FROM n0) AS lim, (SELECT count(*) FROM orders) AS n_reads, (SELECT count(DISTINCT read_id) FROM n0) AS matched),
k AS (SELECT tax_id, x FROM shares, lim WHERE x * matched >= lim),
g0 AS (SELECT n.read_id, n.mut, n.nom, CASE WHEN k.x IS NULL THEN -1 ELSE n.tax_id END AS tax_id, lik * coalesce(k.x, lim / n_reads) AS v FROM n0 n LEFT JOIN k USING (tax_id), lim),
g1 AS (SELECT * REPLACE ((v + 1e-301) / (max(v) OVER (PARTITION BY read_id) + 1e-300) AS v) FROM g0), g2 AS (SELECT *, v / sum(v) OVER (PARTITION BY read_id) AS prop FROM g1 WHERE v >= 0.1),
ok AS (SELECT tax_id FROM g2, lim GROUP BY tax_id, lim HAVING sum(prop) >= lim), g3 AS (SELECT * REPLACE (CASE WHEN tax_id IN (SELECT tax_id FROM ok) THEN tax_id ELSE -1 END AS tax_id) FROM g2),
g4 AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY prop DESC, mut, tax_id, nom) AS rn FROM g3), g5 AS (SELECT read_id, tax_id, mut, nom, prop / sum(prop) OVER (PARTITION BY read_id) AS prop FROM g4 WHERE tax_id <> -1 OR rn = 1),
md AS (SELECT tax_id, 100 * sum(prop * mut) / sum(prop * (mut + nom)) AS mean_dist FROM g5 GROUP BY 1), assigned AS (SELECT *, 100 * mut / (mut + nom) AS dist FROM g5 JOIN md USING (tax_id))"""


def _assigned(spark, sf_dir):
    hits = _nation_hits(spark, sf_dir)
    matched = hits.select("read_id").distinct().count()
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tax_id"), F.col("n_regionkey").cast("long").alias("u"))
    return mixture.assign(hits, _shares(spark, hits), nations, table(spark, sf_dir, "orders").count(), 0.0399 * matched)


@query(f"WITH {ASSIGNED} SELECT tax_id, count(*) AS n_hits, round(sum(prop), 4) AS reads, round(any_value(mean_dist), 6) AS mean_dist, round(sum(dist), 3) AS dist FROM assigned GROUP BY 1")
def read_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("tax_id").agg(F.count("*").alias("n_hits"), F.round(F.sum("prop"), 4).alias("reads"), F.round(F.max("mean_dist"), 6).alias("mean_dist"), F.round(F.sum("dist"), 3).alias("dist"))


PLAIN = f"""{NEAR}, {ADDRESSES}, assigned AS (SELECT read_id, tax_id, rel_sim / sum(rel_sim) OVER (PARTITION BY read_id) AS prop, 100 * mut / (mut + nom) AS dist FROM near),
banded AS (SELECT tax_id, sum(prop) AS b0, sum(CASE WHEN dist <= 10 THEN prop ELSE 0 END) AS b1, sum(CASE WHEN dist <= 5 THEN prop ELSE 0 END) AS b2, sum(CASE WHEN dist <= 2 THEN prop ELSE 0 END) AS b3, sum(CASE WHEN dist <= 1 THEN prop ELSE 0 END) AS b4 FROM assigned GROUP BY 1),
flat AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT tax_id, p, '{name}' || {level} AS grp, b{i} AS weight, b0 FROM banded JOIN addresses USING (tax_id)" for i, (name, level, _) in enumerate(profile.BANDS))}) WHERE weight > 0)"""


def _plainly_assigned(spark, sf_dir):
    near = alignment.near_best(_scored(spark, sf_dir))
    prop = F.expr("rel_sim / sum(rel_sim) over (partition by read_id)")
    return near.select("read_id", "tax_id", prop.alias("prop"), (100 * F.col("mut") / (F.col("mut") + F.col("nom"))).alias("dist"), F.lit(0.0).alias("mean_dist"), F.lit(1.0).alias("depth_w"), F.lit(1.0).alias("core_w"))


@query(f"WITH {PLAIN} SELECT grp, round(sum(weight), 4) AS weight, count(*) AS n_refs FROM flat GROUP BY 1")
def profile_rollup(spark, sf_dir):
    found = profile.rollup(profile.bands(_plainly_assigned(spark, sf_dir)), mapping.addresses(spark, sf_dir))
    return found.select("grp", _r("weight", 4), F.size("refs").cast("long").alias("n_refs"))


@query(f"""WITH {PLAIN}, v AS (SELECT grp, s_name[10:12] AS label, round(sum(weight), 7) AS v FROM flat JOIN supplier ON s_suppkey = p GROUP BY ALL), t AS (SELECT *, max(v) OVER (PARTITION BY grp) AS top FROM v)
SELECT grp, count(*) AS n_labels, arg_max(label, v) AS top_label FROM t WHERE v >= 0.1 * top GROUP BY 1""")
def taxon_votes(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tax_id"), F.substring("s_name", 10, 3).alias("label"))
    found = profile.taxon_votes(profile.bands(_plainly_assigned(spark, sf_dir)), mapping.addresses(spark, sf_dir), labels)
    names = F.split(F.regexp_replace("taxon", r"\)$", ""), r" \(|/")
    return found.select("grp", F.size(names).cast("long").alias("n_labels"), names[0].alias("top_label"))


@query(f"""WITH {NEAR}, a AS (SELECT read_id, tax_id, round(rel_sim / sum(rel_sim) OVER (PARTITION BY read_id), 9) AS prop, round(100 * mut / (mut + nom), 9) AS dist FROM near),
f AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY prop DESC, dist, tax_id) AS n FROM a)
SELECT read_id, min(tax_id) FILTER (WHERE n = 1) AS first_tax, round(coalesce(sum(prop) FILTER (WHERE tax_id IN (1, 2, 3)), 0), 6) AS share FROM f GROUP BY 1 HAVING first_tax IN (1, 2, 3) AND sum(CASE WHEN tax_id IN (1, 2, 3) THEN prop ELSE 0 END) >= 0.3""")
def specific_reads(spark, sf_dir):
    a = _plainly_assigned(spark, sf_dir).withColumn("prop", F.round("prop", 9)).withColumn("dist", F.round("dist", 9))
    return mixture.specific_reads(a, [1, 2, 3], 0.3).select("read_id", "first_tax", _r("share"))


SWEEPS = 15  # of the flagship's mixture


def _abundance_sql() -> str:
    bands = ", ".join(f"sum(w{f' * (d <= {most})::INT' if most else ''}) AS b{i}" for i, (_, _, most) in enumerate(profile.BANDS))
    return f"""{_cover_sql()}, kept AS MATERIALIZED (SELECT * FROM c0 WHERE tax_id IN (SELECT tax_id FROM picks)), bw AS (SELECT read_id, arg_max(weight, {{'a': rel_sim, 'b': weight}}) AS w FROM kept GROUP BY 1),
qm AS MATERIALIZED (SELECT read_id, tax_id, max(lik) AS q, any_value(w) AS w FROM kept JOIN bw USING (read_id) GROUP BY ALL), {_em('qm', SWEEPS)}, mt AS (SELECT count(DISTINCT read_id) AS matched FROM weighed),
k AS (SELECT tax_id, x FROM shares, lim, mt WHERE x * matched >= lim), g0 AS (SELECT n.read_id, mut, nom, depth_w, core_w, weight, CASE WHEN x IS NULL THEN -1 ELSE n.tax_id END AS tax_id, lik * coalesce(x, lim / n_reads) AS v FROM weighed n LEFT JOIN k USING (tax_id), lim),
g1 AS (SELECT * REPLACE ((v + 1e-301) / (max(v) OVER (PARTITION BY read_id) + 1e-300) AS v) FROM g0), g2 AS MATERIALIZED (SELECT *, v / sum(v) OVER (PARTITION BY read_id) AS prop FROM g1 WHERE v >= 0.1),
ok AS (SELECT tax_id FROM g2, lim GROUP BY tax_id, lim HAVING sum(prop) >= lim), g3 AS (SELECT * REPLACE (CASE WHEN tax_id IN (SELECT tax_id FROM ok) THEN tax_id ELSE -1 END AS tax_id) FROM g2),
g4 AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY prop DESC, mut, tax_id, nom) AS rn FROM g3), g5 AS MATERIALIZED (SELECT * REPLACE (prop / sum(prop) OVER (PARTITION BY read_id) AS prop) FROM g4 WHERE tax_id <> -1 OR rn = 1),
md AS (SELECT tax_id, 100 * sum(weight * prop * mut) / CASE WHEN sum(weight * prop * (mut + nom)) = 0 THEN 1 ELSE sum(weight * prop * (mut + nom)) END AS mean_dist FROM g5 GROUP BY 1),
g6 AS (SELECT g.*, mean_dist, 100 * mut / (mut + nom) AS dist, coalesce(a.u, -1) AS cu FROM g5 g JOIN md USING (tax_id) LEFT JOIN addresses a USING (tax_id)), cc AS (SELECT cu, sum(prop * core_w) / sum(prop) AS c FROM g6 WHERE core_w > 0.001 GROUP BY 1),
g7 AS (SELECT g.*, sum(core_w / coalesce(c, 1) * prop) OVER (PARTITION BY read_id) / sum(prop) OVER (PARTITION BY read_id) AS core2 FROM g6 g LEFT JOIN cc USING (cu)), m2 AS (SELECT count(DISTINCT read_id) AS matched2 FROM g7),
banded AS MATERIALIZED (SELECT tax_id, {bands} FROM (SELECT tax_id, greatest(dist, mean_dist) AS d, depth_w * core2 * prop AS w FROM g7 WHERE tax_id <> -1) GROUP BY 1),
flat AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f"SELECT tax_id, p, '{name}' || {level} AS grp, b{i} AS weight, b0 FROM banded JOIN addresses USING (tax_id)" for i, (name, level, _) in enumerate(profile.BANDS))}) WHERE weight > 0),
vt AS (SELECT grp, s_name AS label, round(sum(weight), 7) AS v FROM flat JOIN supplier ON s_suppkey = p GROUP BY ALL), v2 AS (SELECT *, max(v) OVER (PARTITION BY grp) AS top, row_number() OVER (PARTITION BY grp ORDER BY v DESC, label) AS n FROM vt),
tx AS (SELECT grp, max(label) FILTER (WHERE n = 1) || coalesce(' (' || string_agg(label, '/' ORDER BY v DESC, label) FILTER (WHERE n > 1) || ')', '') AS taxon FROM v2 WHERE v >= 0.1 * top GROUP BY grp),
gs AS (SELECT grp, sum(weight) AS weight, string_agg(CAST(tax_id AS VARCHAR), ',' ORDER BY round(b0, 7) DESC, tax_id) AS refs FROM flat GROUP BY 1)"""


@query(f"WITH {_abundance_sql()} SELECT grp, round(100 * weight / n_reads, 4) AS pct_total, round(100 * weight / matched2, 4) AS pct_matched, taxon, refs FROM gs JOIN tx USING (grp), lim, m2 WHERE weight / n_reads >= 0.0001")
def abundance_profile(spark, sf_dir):
    """Reads to profile: scores, cover, mixture, assignment, roll-up."""
    scored = stored(_weighed(spark, sf_dir))
    n_reads = table(spark, sf_dir, "orders").count()
    addresses = mapping.addresses(spark, sf_dir)
    cands = mixture.candidates(scored)
    picked, limit = mixture.cover(cands, n_reads, 0.0001, 12.0)
    chosen = spark.createDataFrame([(t,) for t, _ in picked], "tax_id long")
    shares = mixture.mixture(mixture.qmatrix(cands, chosen), iterations=SWEEPS, tolerance=0.0)
    assigned = stored(mixture.assign(scored, spark.createDataFrame(list(shares.items()), "tax_id long, x double"), addresses, n_reads, limit))
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tax_id"), F.col("s_name").alias("label"))
    found = profile.profile(assigned, addresses, labels, n_reads)
    return found.select("grp", _r("pct_total", 4), _r("pct_matched", 4), "taxon", "refs")


YEARS = [str(y) for y in range(1992, 2002)]


def _year(x: str) -> str:
    return f"coalesce(sum(CASE WHEN sample = '{x}' THEN v END), 0) AS \"{x}\""


@query(f"""WITH g AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS sample, 's' || (l_suppkey % 25) AS grp, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), t AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS sample, count(*) AS n_total FROM lineitem GROUP BY ALL),
r AS (SELECT sample, grp, 100.0 * n / n_total AS v FROM g JOIN t USING (sample) WHERE 100.0 * n / n_total >= 0.5), u AS (SELECT * FROM r UNION ALL SELECT sample, 'Unknown', 100.0 - coalesce(k, 0) FROM (SELECT DISTINCT sample FROM g) LEFT JOIN (SELECT sample, sum(v) AS k FROM r GROUP BY 1) USING (sample))
SELECT grp, {', '.join(f'round("{y}", 6) AS "y{y}"' for y in YEARS)}, round({' + '.join(f'"{y}"' for y in YEARS)}, 4) AS total FROM (SELECT grp, {', '.join(map(_year, YEARS))} FROM u WHERE sample IN ({', '.join(f"'{y}'" for y in YEARS)}) GROUP BY 1)""")
def sample_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("sample"), F.concat(F.lit("s"), (F.col("l_suppkey") % 25).cast("string")).alias("grp"), "l_returnflag")
    total = li.groupBy("sample").agg(F.count("*").alias("n_total"), F.sum(F.when(F.col("l_returnflag") != "N", 1).otherwise(0)).alias("n_found"))
    groups = li.where("l_returnflag <> 'N'").groupBy("sample", "grp").agg(F.count("*").alias("n")).join(total, "sample")
    samples = groups.withColumn("pct_matched", 100.0 * F.col("n") / F.col("n_found"))
    found = profile.report(samples.where(F.col("sample").isin(YEARS)), YEARS, "s", low=0.5)
    return found.select("grp", *[F.round(F.col(f"`{y}`"), 6).alias(f"y{y}") for y in YEARS], _r("total", 4))


@query("""SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '^(red|blue) ') THEN 'colour' WHEN regexp_matches(p_name, 'ring$') THEN 'shape' WHEN regexp_matches(p_name, '^small') THEN 'size' WHEN regexp_matches(p_name, 'widget') THEN 'zz' ELSE 'non' END AS label FROM part""")
def label_rules(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), profile.label_of(F.col("p_name"), RULES).alias("label"))


@query("""WITH p AS (SELECT CAST(quality AS VARCHAR) AS t, CASE WHEN n_chars % 3 = 0 THEN '0' WHEN text LIKE '% | %' THEN '2' ELSE '1' END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE t = p AND t <> '0') AS tp, count(*) FILTER (WHERE t <> p AND t <> '0' AND p <> '0') AS w, count(*) FILTER (WHERE t <> '0' AND p = '0') AS m, count(*) FILTER (WHERE t = '0' AND p <> '0') AS s, count(*) FILTER (WHERE t = '0' AND p = '0') AS n FROM p)
SELECT tp AS n_true, w + s AS n_false_positive, w + m AS n_false_negative, n AS n_both_unknown, round(tp / (tp + w + s), 6) AS precision, round(tp / (tp + w + m), 6) AS recall, round(2 * tp / (2 * tp + 2 * w + s + m), 6) AS f1 FROM c""")
def evaluation_scores(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    guess = F.when(F.col("n_chars") % 3 == 0, "0").when(F.contains("text", F.lit(" | ")), "2").otherwise("1")
    found = profile.scores(both.select(F.col("quality").cast("string").alias("truth"), guess.alias("predicted")))
    return found.select("n_true", "n_false_positive", "n_false_negative", "n_both_unknown", _r("precision"), _r("recall"), _r("f1"))


@query("""WITH c AS (SELECT l_suppkey AS grp, p_name AS species, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '*' ELSE '' END || p_name AS p_name FROM part) ON l_partkey = p_partkey GROUP BY ALL),
k AS (SELECT *, max(n) OVER (PARTITION BY grp) AS most FROM c), f AS (SELECT *, max(CASE WHEN species LIKE '*%' THEN 0 ELSE 1 END) OVER (PARTITION BY grp) AS formal FROM k WHERE n * 10 >= most OR n >= 4)
SELECT grp, n AS votes, species FROM f WHERE species NOT LIKE '*%' OR formal = 0""")
def species_vote(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.when(F.col("p_size") % 2 == 0, "*").otherwise(""), F.col("p_name")).alias("name"))
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_suppkey").alias("grp"), "l_orderkey", F.col("name").alias("species"))
    return profile.species_vote(rows, "grp", "l_orderkey", "species")


@query("""WITH u AS (SELECT o_orderkey, CAST(('0x' || substring(md5('1:' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM orders),
n AS (SELECT o_orderkey, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT AS n FROM u)
SELECT o_orderkey, CAST(unnest(range(1, n + 1)) AS INT) AS copy FROM n WHERE n > 0""")
def bootstrap_sample(spark, sf_dir):
    return mixture.bootstrap(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""WITH n AS (SELECT count(*) AS n FROM orders) SELECT CAST(b AS INT) AS replicate, ('0x' || substring(md5('7:' || b || ':' || i), 1, 15))::BIGINT % n AS place, count(*) AS times FROM n, range(n) AS r(i), range(1, 6) AS s(b) GROUP BY ALL""")
def bootstrap_draws(spark, sf_dir):
    """Five replicates of as many draws with replacement as there are orders."""
    return mixture.draws(table(spark, sf_dir, "orders").count(), 5, spark, seed=7)


@query()
def bootstrap_shares(spark, sf_dir):
    """Shares of nations with the interval of twenty replicates."""
    hits = _nation_hits(spark, sf_dir)
    found = mixture.replicated(mixture.qmatrix(hits, hits.select("tax_id").distinct()), 20, iterations=ROUNDS, tolerance=1e-7)
    return spark.createDataFrame([(t, round(x, 6), round(a, 6), round(b, 6)) for t, (x, a, b) in found.items()], "tax_id long, x double, low double, high double")


TERMS = " + ".join(f"{f} * " + (f"lead(code, {j}) OVER w" if j else "code") for j, f in enumerate(sketch.multipliers(K)))
(M1, F1), (M2, F2) = sketch.HALVES


def _sketch_sql(source: str, key: str, x: str = "") -> str:
    """CTEs with the sketches of a table's texts; x is put behind their names."""
    return f"""chars{x} AS (SELECT {key}, generate_subscripts(c, 1) AS i, CAST(unicode(unnest(c)) AS BIGINT) AS code FROM (SELECT {key}, string_split(text, '') AS c FROM {source} WHERE length(text) >= {K})),
sums{x} AS (SELECT {key}, {TERMS} AS v FROM chars{x} WINDOW w AS (PARTITION BY {key} ORDER BY i)),
mers{x} AS (SELECT DISTINCT {key}, v % {M1} * {F1} % {M1} * 2147483648 + v % {M2} * {F2} % {M2} AS h FROM sums{x} WHERE v IS NOT NULL),
sk{x} AS (SELECT {key}, h, row_number() OVER (PARTITION BY {key} ORDER BY h) AS n FROM mers{x}), held{x} AS (SELECT {key}, h FROM sk{x} WHERE n <= {S}), lists{x} AS (SELECT {key}, list(h ORDER BY h) AS hs FROM held{x} GROUP BY 1)"""


def _distance_sql(x: str, a: str, b: str) -> str:
    """CTE dd{x}: (a, b, dist) of the pairs in met{x}, whose arrays are ah and bh."""
    return f"""un{x} AS (SELECT *, list_sort(list_distinct(list_concat(ah, bh)))[1:{S}] AS un FROM met{x}), ds{x} AS (SELECT {a}, {b}, len(list_intersect(list_intersect(un, ah), bh)) / len(un) AS j FROM un{x}),
dd{x} AS (SELECT {a}, {b}, CASE WHEN j > 0 THEN greatest(0.0, -ln(2 * j / (1 + j)) / {K}) ELSE 1.0 END AS dist FROM ds{x} WHERE j > 0)"""


SKETCHES = _sketch_sql("documents", "doc_id")
# Every earlier row that shares a hash is compared.
NEAREST = f"""{SKETCHES}, pairs AS (SELECT DISTINCT a.doc_id, b.doc_id AS parent FROM held a JOIN held b USING (h) WHERE b.doc_id < a.doc_id),
met AS (SELECT p.doc_id, p.parent, a.hs AS ah, b.hs AS bh FROM pairs p JOIN lists a ON a.doc_id = p.doc_id JOIN lists b ON b.doc_id = p.parent), {_distance_sql("", "doc_id", "parent")},
nearest AS (SELECT doc_id, arg_min(parent, {{'d': round(dist, 12), 'p': parent}}) AS parent, min(dist) AS dist FROM dd GROUP BY 1)"""


def _sketches(spark, sf_dir):
    return sketch.sketches(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", K, S)


@query(f"WITH {SKETCHES} SELECT doc_id, len(hs) AS n_hashes, hs[1] AS least, hs[-1] AS largest FROM lists")
def kmer_sketches(spark, sf_dir):
    return _sketches(spark, sf_dir).where(F.col("size") >= K).select("doc_id", F.size("hashes").cast("long").alias("n_hashes"), F.element_at("hashes", 1).alias("least"), F.element_at("hashes", -1).alias("largest"))


@query(f"WITH {NEAREST} SELECT doc_id, parent, round(dist, 6) AS dist FROM nearest")
def nearest_neighbours(spark, sf_dir):
    return neighbours.nearest_earlier(_sketches(spark, sf_dir), "doc_id", K, S).select("doc_id", "parent", _r("dist"))


def _roots(level: str, threshold: float) -> str:
    return f"""w_{level} AS (SELECT doc_id, doc_id AS root FROM documents UNION ALL SELECT w.doc_id, n.parent FROM w_{level} w JOIN nearest n ON n.doc_id = w.root WHERE n.dist <= {threshold!r}),
r_{level} AS (SELECT doc_id, min(root) AS {level} FROM w_{level} GROUP BY 1)"""


@query(f"WITH RECURSIVE {NEAREST}, {', '.join(_roots(x, t) for x, t in zip(LEVELS, THRESHOLDS))} SELECT d.doc_id, {', '.join(LEVELS[:-1])}, d.doc_id AS a FROM documents d {' '.join(f'JOIN r_{x} ON r_{x}.doc_id = d.doc_id' for x in LEVELS[:-1])}")
def cluster_addresses(spark, sf_dir):
    return sketch.addresses(_sketches(spark, sf_dir), "doc_id", K, S)


SEARCH = f"""{SKETCHES}, {_sketch_sql("benchmark", "item_id", "_b")}, pairs_s AS (SELECT DISTINCT a.item_id AS query, b.doc_id FROM held_b a JOIN held b USING (h)),
met_s AS (SELECT p.query, p.doc_id, a.hs AS ah, b.hs AS bh FROM pairs_s p JOIN lists_b a ON a.item_id = p.query JOIN lists b ON b.doc_id = p.doc_id), {_distance_sql("_s", "query", "doc_id")},
found AS (SELECT query, doc_id, dist FROM (SELECT *, min(dist) OVER (PARTITION BY query) AS best FROM dd_s WHERE dist <= 0.1) WHERE 1 - dist >= 0.98 * (1 - best))"""


def _found(spark, sf_dir, held):
    asked = sketch.sketches(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), "query", "text", K, S)
    return neighbours.search(asked, held, "doc_id", K, S)


@query(f"WITH {SEARCH} SELECT query, doc_id, round(dist, 6) AS dist FROM found")
def sketch_search(spark, sf_dir):
    """Benchmark passages are searched for among all documents."""
    return _found(spark, sf_dir, checkpoint(_sketches(spark, sf_dir))).select("query", "doc_id", _r("dist"))


SAMPLES = f"""chars_m AS (SELECT source, doc_id, generate_subscripts(c, 1) AS i, CAST(unicode(unnest(c)) AS BIGINT) AS code FROM (SELECT source, doc_id, string_split(text, '') AS c FROM documents WHERE length(text) >= {K})),
sums_m AS (SELECT source, {TERMS} AS v FROM chars_m WINDOW w AS (PARTITION BY doc_id ORDER BY i)), mers_m AS (SELECT source, v % {M1} * {F1} % {M1} * 2147483648 + v % {M2} * {F2} % {M2} AS h FROM sums_m WHERE v IS NOT NULL),
often AS (SELECT source, h, row_number() OVER (PARTITION BY source ORDER BY h) AS n FROM (SELECT source, h FROM mers_m GROUP BY ALL HAVING count(*) >= 2)),
samples AS (SELECT source, list(h ORDER BY h) AS hs FROM often WHERE n <= {S} GROUP BY 1)"""


@query(f"WITH {SAMPLES} SELECT m.source, count(*) AS n_kmers, any_value(len(hs)) AS n_hashes, any_value(hs[1]) AS least, any_value(hs[-1]) AS largest, any_value(CAST(list_sum(list_transform(hs, lambda x: x % 1000003)) AS BIGINT)) AS digest FROM mers_m m JOIN samples USING (source) GROUP BY 1")
def sample_sketch(spark, sf_dir):
    """Each source's documents are the reads of a sample; k-mers that occur twice in it count."""
    found = sketch.sample_sketches(table(spark, sf_dir, "documents"), "source", "text", K, S)
    digest = F.aggregate("hashes", F.lit(0).cast("long"), lambda acc, x: acc + x % 1000003)
    return found.select("source", "n_kmers", F.size("hashes").cast("long").alias("n_hashes"), F.element_at("hashes", 1).alias("least"), F.element_at("hashes", -1).alias("largest"), digest.alias("digest"))


def queries() -> dict:
    from lineagelake.plans import extended, indexed, sqltext, taxa  # these register their own

    assert extended and indexed and sqltext and taxa
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
