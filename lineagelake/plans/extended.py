"""More queries: ingest, lineage, mapping databases, search output, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineagelake.config import LEVELS
from lineagelake.operators import catalog as cat
from lineagelake.operators import profile, sketch
from lineagelake.plans import mapping
from lineagelake.plans.registry import ADDRESSES, PLAIN, _plainly_assigned, _r, query
from lineagelake.session import table


@query("""SELECT o_orderkey AS id FROM orders o WHERE o_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderkey % 10 = 0 AND k.o_custkey = o.o_custkey)
AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderkey % 10 = 0 AND CAST(floor(k.o_totalprice) AS BIGINT) = CAST(floor(o.o_totalprice) AS BIGINT))""")
def novel_references(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("accession"), F.floor("o_totalprice").cast("long").alias("file_path"))
    return cat.novel(o.where("id % 2 = 1"), o.where("id % 10 = 0"), "id", ["accession", "file_path"]).select("id")


@query("""WITH n AS (SELECT l_partkey, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), u AS (SELECT l_partkey, max(l_suppkey) AS f FROM lineitem JOIN n USING (l_partkey) WHERE l_returnflag = 'R' AND l_linenumber = v GROUP BY 1)
SELECT p_partkey AS id, 'GCF_' || p_partkey || '.' || coalesce(v, 1) AS accession, coalesce('f' || f, 'old') AS url FROM part LEFT JOIN n ON n.l_partkey = p_partkey LEFT JOIN u ON u.l_partkey = p_partkey""")
def version_refresh(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("GCF_"), F.col("p_partkey").cast("string"), F.lit(".1")).alias("accession"), F.lit("old").alias("url"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    key = F.concat(F.lit("GCF_"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    # Of one version the largest supplier number stands, so it leads the url here.
    listed = li.groupBy(key.alias("accession")).agg(F.concat(F.lit("f"), F.max("l_suppkey").cast("string")).alias("url"))
    return cat.refresh(part, listed, ["accession", "url"], "accession")


NODES = """nodes AS (SELECT CAST(r_regionkey AS BIGINT) + 1000000000 AS id, CAST(NULL AS BIGINT) AS parent, 'kingdom' AS rank, r_name AS name FROM region
UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 2000000000, CAST(n_regionkey AS BIGINT) + 1000000000, 'family', n_name FROM nation UNION ALL SELECT s_suppkey, CAST(s_nationkey AS BIGINT) + 2000000000, 'species', s_name FROM supplier)"""


def _nodes(spark, sf_dir):
    lit = lambda x: F.lit(x).alias("rank")
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey").cast("long") + 1_000_000_000).alias("id"), F.lit(None).cast("long").alias("parent"), lit("kingdom"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 2_000_000_000).alias("id"), (F.col("n_regionkey").cast("long") + 1_000_000_000).alias("parent"), lit("family"), F.col("n_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey").cast("long") + 2_000_000_000).alias("parent"), lit("species"), F.col("s_name").alias("name"))
    return region.unionByName(nation).unionByName(supplier)


@query(f"""WITH {NODES} SELECT n.id, CASE n.rank WHEN 'kingdom' THEN n.name WHEN 'family' THEN p.name ELSE g.name END AS kingdom, CASE n.rank WHEN 'family' THEN n.name WHEN 'species' THEN p.name END AS family,
CASE n.rank WHEN 'species' THEN n.name END AS species FROM nodes n LEFT JOIN nodes p ON p.id = n.parent LEFT JOIN nodes g ON g.id = p.parent""")
def taxid_lineage(spark, sf_dir):
    return cat.lineage(_nodes(spark, sf_dir), ["kingdom", "family", "species"])


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE n_name END AS family, CASE WHEN s_suppkey % 4 = 0 THEN 'mine' ELSE r_name END AS kingdom
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def taxonomy_fill(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "own").alias("family"), F.when(F.col("s_suppkey") % 4 == 0, "mine").alias("kingdom"))
    return cat.fill(own, cat.lineage(_nodes(spark, sf_dir), ["kingdom", "family"]), "id", ["kingdom", "family"])


@query("""SELECT c_name AS organism_name, CAST(NULL AS VARCHAR) AS taxid, c_custkey AS "index" FROM customer""")
def conform_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"), F.col("c_name").alias("organism_name"), "c_acctbal")
    return cat.conform(rows, ["organism_name", "taxid", "index"])


@query("""SELECT o_orderkey AS id, 1000000 + row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_custkey % 9 + 1 DESC, 'GCF_' || o_orderkey || '.' || (o_custkey % 9 + 1)) AS "index" FROM orders""")
def ingest_numbers(spark, sf_dir):
    """Keys of new rows in the order of taking in, from the catalogue's largest on."""
    status = F.when(F.col("o_orderstatus") == "F", "reference genome").when(F.col("o_orderstatus") == "O", "representative genome")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "Complete Genome").when(F.col("o_orderpriority") == "2-HIGH", "Chromosome")
    accession = F.concat(F.lit("GCF_"), F.col("o_orderkey").cast("string"), F.lit("."), (F.col("o_custkey") % 9 + 1).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("refseq_category"), level.alias("assembly_level"), accession.alias("assembly_accession"))
    known = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 0 + 1_000_000).cast("long").alias("index"))
    return cat.allocate(rows, known, *cat.ingest_keys()).select("id", "index")


@query("""SELECT count(*) AS n_items, CAST(sum(n_chars) AS BIGINT) AS size, CAST(ceil(sum(n_chars) / 200000.0) AS BIGINT) AS shards FROM documents""")
def shard_count(spark, sf_dir):
    return cat.first_shards(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size")), 200_000)


def _members(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("db"), (F.col("l_suppkey") % 4).cast("string")).alias("mapdb"), (F.col("l_suppkey") % 3).alias("shard"), F.concat(F.lit("seq"), (F.col("l_suppkey") * 4 + F.col("l_partkey") % 4).cast("string")).alias("seq_name"), F.col("l_suppkey").alias("tax_id")).distinct()


MEMBERS = "members AS (SELECT DISTINCT 'db' || (l_suppkey % 4) AS mapdb, l_suppkey % 3 AS shard, 'seq' || (l_suppkey * 4 + l_partkey % 4) AS seq_name, l_suppkey AS tax_id FROM lineitem)"


@query(f"WITH {MEMBERS} SELECT mapdb, shard, count(*) AS n_seqs, count(DISTINCT tax_id) AS n_refs FROM members WHERE mapdb IN ('db1', 'db3') GROUP BY ALL")
def mapping_discovery(spark, sf_dir):
    return cat.discover(_members(spark, sf_dir), "db1,db3").groupBy("mapdb", "shard").agg(F.count("*").alias("n_seqs"), F.count_distinct("tax_id").alias("n_refs"))


@query(f"WITH {MEMBERS} SELECT seq_name, tax_id, row_number() OVER (ORDER BY mapdb, shard, seq_name, tax_id) - 1 AS seq_id FROM members")
def sequence_dictionary(spark, sf_dir):
    return cat.sequence_dictionary(_members(spark, sf_dir)).select("seq_name", "tax_id", "seq_id")


@query("""SELECT s_suppkey AS "index", s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7)""")
def selection_list(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("index"), "s_name")
    return cat.pick(rows, table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_suppkey").alias("index")))


def _prefix(i: int) -> str:
    return " || '.' || ".join(f"'{x}' || {x}" for x in LEVELS[: i + 1])


SEARCHED = "found AS (SELECT CAST(l_linenumber AS BIGINT) AS query, l_suppkey AS tax_id, round(min(l_extendedprice) / 1000000, 6) AS dist FROM lineitem GROUP BY ALL)"


@query(f"""WITH {ADDRESSES}, {SEARCHED}, placed AS ({' UNION ALL '.join(f"SELECT tax_id, {i} AS level, {t!r} AS most, {_prefix(i)} AS grp FROM addresses" for i, t in enumerate(sketch.THRESHOLDS))}),
size AS (SELECT grp, count(*) AS members FROM placed GROUP BY 1) SELECT query, grp, level, min(dist) AS dist, arg_min(tax_id, {{'d': dist, 't': tax_id}}) AS best, any_value(members) AS members
FROM found JOIN placed USING (tax_id) JOIN size USING (grp) WHERE dist <= most GROUP BY query, grp, level""")
def search_groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    found = li.groupBy(F.col("l_linenumber").cast("long").alias("query"), F.col("l_suppkey").alias("tax_id")).agg(F.round(F.min("l_extendedprice") / 1_000_000, 6).alias("dist"))
    return sketch.groups(found, mapping.addresses(spark, sf_dir), "tax_id")


@query("""WITH c AS (SELECT s_nationkey, s_suppkey, s_name, CAST(round(s_acctbal * 10000) AS BIGINT) AS size FROM supplier) SELECT s_nationkey AS grp, s_suppkey AS "index", s_name AS organism_name, size FROM c QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 1""")
def group_representatives(spark, sf_dir):
    """The first member of each group, with its details."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("index"), F.col("s_name").alias("organism_name"), F.round(F.col("s_acctbal") * 10_000).cast("long").alias("size"))
    return cat.representatives(rows, "grp", "index", ["organism_name", "size"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REPORTED = """r AS (SELECT 'c' || (o_custkey % 12) AS grp, CASE WHEN o_custkey % 12 < 5 THEN 'known' ELSE 'non' END AS label, o_orderpriority AS sample, round(sum(o_totalprice), 2) AS v FROM orders WHERE NOT (o_custkey % 12 < 5 AND o_orderpriority = '5-LOW') GROUP BY ALL)"""


def _sample_sum(p: str) -> str:
    return f"round(coalesce(sum(CASE WHEN sample = '{p}' THEN v END), 0), 1) AS \"{p}\""


def _reported(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("not (o_custkey % 12 < 5 and o_orderpriority = '5-LOW')")
    grp = F.concat(F.lit("c"), (F.col("o_custkey") % 12).cast("string")).alias("grp")
    wide = o.groupBy(grp, F.when(F.col("o_custkey") % 12 < 5, "known").otherwise("non").alias("label")).pivot("o_orderpriority", PRIORITIES).agg(F.round(F.sum("o_totalprice"), 2))
    filled = [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in PRIORITIES]
    return wide.select("grp", "label", *filled).withColumn("total", sum(F.col(f"`{n}`") for n in PRIORITIES))


@query(f"""WITH {REPORTED} SELECT grp, {', '.join(map(_sample_sum, PRIORITIES[:4]))} FROM r WHERE label <> 'non' GROUP BY grp""")
def report_filtered(spark, sf_dir):
    """Labelled groups alone, samples without any of them left out, largest first."""
    found = profile.chosen(_reported(spark, sf_dir), PRIORITIES, "label", without_empty=True)
    return found.select("grp", *[F.round(F.col(f"`{n}`"), 1).alias(n) for n in found.columns if n in PRIORITIES])


@query(f"""WITH {REPORTED} SELECT sample, {', '.join(f"round(coalesce(sum(CASE WHEN grp = 'c{i}' THEN v END), 0), 1) AS c{i}" for i in range(12))} FROM (SELECT * FROM r UNION ALL SELECT 'c0', 'known', '5-LOW', 0.0) GROUP BY sample""")
def report_transposed(spark, sf_dir):
    keys = [f"c{i}" for i in range(12)]
    found = profile.transposed(_reported(spark, sf_dir), "grp", keys, PRIORITIES)
    return found.select("sample", *[F.round(k, 1).alias(k) for k in keys])


@query(f"""WITH {PLAIN}, m AS (SELECT count(DISTINCT read_id) AS matched, (SELECT count(*) FROM orders) AS total, sum(prop) AS certain FROM assigned)
SELECT total, matched, round(100.0 * (total - matched) / total, 4) AS unmatched_pct, abs(round(100 * (matched - certain) / total, 4)) AS uncertain_pct FROM m""")
def profile_summary(spark, sf_dir):
    found = profile.summary(_plainly_assigned(spark, sf_dir), table(spark, sf_dir, "orders").count())
    return found.select("total", "matched", _r("unmatched_pct", 4), F.abs(F.round("uncertain_pct", 4)).alias("uncertain_pct"))


@query("""WITH a AS (SELECT l_orderkey AS read_id, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS prop, l_discount * 100 AS d, l_linestatus = 'O' AS informal, l_suppkey AS species, l_suppkey % 10 AS genus FROM lineitem),
f AS (SELECT read_id, round(prop, 9) AS prop, CASE WHEN round(d, 4) >= 5 OR informal THEN 0 ELSE species END AS species, CASE WHEN round(d, 4) >= 10 THEN 0 ELSE genus END AS genus FROM a),
s AS (SELECT read_id, string_agg(CAST(species AS VARCHAR), ',' ORDER BY species) AS species FROM (SELECT read_id, species FROM f GROUP BY ALL HAVING sum(prop) >= 0.8) GROUP BY 1),
g AS (SELECT read_id, string_agg(CAST(genus AS VARCHAR), ',' ORDER BY genus) AS genus FROM (SELECT read_id, genus FROM f GROUP BY ALL HAVING sum(prop) >= 0.8) GROUP BY 1)
SELECT read_id, coalesce(s.species, '0') AS species, coalesce(g.genus, '0') AS genus FROM (SELECT DISTINCT read_id FROM f) LEFT JOIN s USING (read_id) LEFT JOIN g USING (read_id)""")
def interpreted_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    prop = F.round(F.expr("l_quantity / sum(l_quantity) over (partition by l_orderkey)"), 9)
    rows = li.select(F.col("l_orderkey").alias("read_id"), prop.alias("prop"), F.round(F.col("l_discount") * 100, 4).alias("dist"), F.lit(0.0).alias("mean_dist"), (F.col("l_linestatus") == "O").alias("informal"), F.col("l_suppkey").alias("species"), (F.col("l_suppkey") % 10).alias("genus"))
    return profile.interpret(rows, ["species", "genus"])


@query("""WITH x AS (SELECT n_name, CASE WHEN s_suppkey % 5 = 0 THEN '*' ELSE '' END || 'sp' || (s_suppkey % 7) AS main, s_suppkey % 2 AS sample, s_suppkey % 3 AS o, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 100),
t AS (SELECT 'k|p|c|o|f|g|' || n_name || '|' || main AS t, main, round(sum(CASE WHEN sample = 0 THEN v ELSE 0 END), 2) AS a, round(sum(CASE WHEN sample = 1 THEN v ELSE 0 END), 2) AS b FROM x GROUP BY ALL),
l AS (SELECT main, string_agg(DISTINCT 'syn' || o, '/' ORDER BY 'syn' || o) FILTER (WHERE o > 0) AS os FROM x GROUP BY 1)
SELECT 'Species' AS level, t || coalesce(' (' || os || ')', '') AS taxonomy, a, b FROM t JOIN l USING (main)""")
def traditional_report(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    main = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "*").otherwise(""), F.lit("sp"), (F.col("s_suppkey") % 7).cast("string"))
    other = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit(" (syn"), (F.col("s_suppkey") % 3).cast("string"), F.lit(")"))).otherwise("")
    rows = s.select(F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b").alias("sample"), F.concat(F.lit("k|p|c|o|f|g|"), "n_name", F.lit("|"), main, other).alias("taxon"), F.col("s_acctbal").alias("v"))
    found = profile.traditional(rows, ["a", "b"], cutoff=100)
    return found.select("level", "taxonomy", _r("a", 2), _r("b", 2))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'ZZ' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def catalog_merged(spark, sf_dir):
    """The catalogue after an update list that names keys twice and one that is not there."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.col("c_custkey")
    listed = c.where(key % 7 == 0).select(F.explode(F.array(F.struct("c_custkey", F.lit("AA").alias("c_mktsegment")), F.struct("c_custkey", F.lit("ZZ").alias("c_mktsegment")), F.struct((key + 10_000_000).alias("c_custkey"), F.lit("QQ").alias("c_mktsegment")))).alias("x")).select("x.*")
    return cat.upsert(c, listed, "c_custkey", ["c_mktsegment"])[0]

