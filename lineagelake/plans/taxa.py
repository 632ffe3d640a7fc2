"""Queries with taxonomies by rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineagelake.operators import profile, rules, truth
from lineagelake.plans import mapping
from lineagelake.plans.registry import PLAIN, YEARS, _plainly_assigned, _r, query
from lineagelake.session import stored, table

# Ranks of a supplier: (rank, SQL that both engines read).
LABELS = (
    ("superkingdom", "r_name"), ("kingdom", "concat('k', s_suppkey % 3)"), ("phylum", "n_name"), ("class", "CASE WHEN s_suppkey % 4 > 0 THEN concat('c', s_suppkey % 4) END"), ("order", "concat('o', s_nationkey % 2)"),
    ("family", "concat('f', s_suppkey % 5)"), ("genus", "concat('g', s_suppkey % 6)"), ("species", "concat(CASE WHEN s_suppkey % 3 = 0 THEN '*' ELSE '' END, 's', s_suppkey % 7)"), ("subspecies", "concat('b', s_suppkey % 11)"),
)
_CUT = " ".join(f"WHEN {k!r} THEN {len(LABELS) - n}" for k, n in profile.TOO_FINE.items())
TAXONOMY = f"""{PLAIN}, labelled AS (SELECT s_suppkey AS tax_id, {', '.join(f'{e} AS l{i}' for i, (_, e) in enumerate(LABELS))} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
member AS ({' UNION ALL '.join(f"SELECT a.p, {i} AS i, coalesce(l{i}, '-') AS label, count(*) AS n FROM labelled JOIN addresses a USING (tax_id) GROUP BY ALL" for i in range(len(LABELS)))}),
vote AS (SELECT grp, i, label, round(sum(weight * n), 7) AS v FROM (SELECT grp, p, sum(weight) AS weight FROM flat GROUP BY ALL) JOIN member USING (p) GROUP BY ALL),
topped AS (SELECT *, max(v) OVER (PARTITION BY grp, i) AS top, row_number() OVER (PARTITION BY grp, i ORDER BY v DESC, label) AS n FROM vote),
ranked AS (SELECT grp, i, max(label) FILTER (WHERE n = 1) || coalesce(' (' || string_agg(label, '/' ORDER BY v DESC, label) FILTER (WHERE n > 1) || ')', '') AS t FROM topped WHERE v >= 0.1 * top GROUP BY ALL),
heavy AS (SELECT grp, arg_min(tax_id, {{'a': -round(b0, 7), 'b': tax_id}}) AS first, round(sum(weight), 4) AS weight, count(*) AS n_refs FROM flat GROUP BY 1),
taxa AS (SELECT h.grp, h.weight, h.n_refs, string_agg(t, '|' ORDER BY i) FILTER (WHERE i < CASE left(h.grp, 1) {_CUT} ELSE {len(LABELS)} END) || CASE WHEN left(h.grp, 1) = 'p' THEN '|' || any_value(s_name) || ': GCF_' || any_value(s_suppkey) ELSE '' END AS taxonomy
FROM heavy h JOIN ranked r USING (grp) JOIN supplier ON s_suppkey = first GROUP BY h.grp, h.weight, h.n_refs)"""


def _labels(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("s_suppkey").alias("tax_id"), *[F.expr(e).alias(c) for c, e in LABELS])


def _names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tax_id"), F.col("s_name").alias("organism_name"), F.concat(F.lit("GCF_"), "s_suppkey").alias("accession"))


@query(f"WITH {TAXONOMY} SELECT grp, weight, n_refs, taxonomy FROM taxa")
def group_taxonomy(spark, sf_dir):
    """Each group's taxonomy from all ranks' votes, cut by its level."""
    found = profile.taxonomy(profile.bands(_plainly_assigned(spark, sf_dir)), mapping.addresses(spark, sf_dir), _labels(spark, sf_dir), _names(spark, sf_dir))
    return found.select("grp", _r("weight", 4), F.size("refs").cast("long").alias("n_refs"), "taxonomy")


RULES = [("s[12]", "pair"), (r"\*s", "informal"), ("Dark", "zz")]
REPORT = f"""{TAXONOMY}, li AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS sample, l_returnflag, s_nationkey, n_regionkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE year(l_shipdate) BETWEEN {YEARS[0]} AND {YEARS[-1]}),
tot AS (SELECT sample, count(*) AS n_total, count(*) FILTER (WHERE l_returnflag <> 'N') AS n_found FROM li GROUP BY 1),
grps AS (SELECT sample, 's' || s_nationkey AS grp, count(*) * CASE WHEN s_nationkey % 3 = 0 THEN 0.001 ELSE 1 END AS n FROM li WHERE l_returnflag <> 'N' GROUP BY sample, s_nationkey UNION ALL SELECT sample, 'u' || n_regionkey, CAST(count(*) AS DOUBLE) FROM li WHERE l_returnflag <> 'N' GROUP BY sample, n_regionkey),
val AS (SELECT sample, grp, taxonomy AS taxon, round(n) AS v FROM grps JOIN tot USING (sample) LEFT JOIN taxa USING (grp) WHERE 100.0 * n / n_total >= 0.00001 AND round(n) > 0),
every AS (SELECT * FROM val UNION ALL SELECT sample, 'Unknown', 'Dark Matter', n_total - coalesce(k, 0) FROM tot LEFT JOIN (SELECT sample, sum(v) AS k FROM val WHERE starts_with(grp, 's') GROUP BY 1) USING (sample)),
rep AS (SELECT grp, any_value(taxon) AS taxon, {', '.join(f"coalesce(sum(v) FILTER (WHERE sample = '{y}'), 0) AS y{y}" for y in YEARS)}, sum(CASE WHEN grp = 'Unknown' THEN 0 ELSE v END) AS total FROM every GROUP BY 1),
bare AS (SELECT *, regexp_replace(taxon, '\\([^(]*$', '') AS b FROM rep)"""


@query(f"""WITH {REPORT} SELECT grp, CASE WHEN regexp_matches(b, '\\*s') THEN 'informal' WHEN regexp_matches(b, 's[12]') THEN 'pair' WHEN regexp_matches(b, 'Dark') THEN 'zz' ELSE 'non' END AS label, {', '.join(f'y{y}' for y in YEARS)},
CASE WHEN taxon = 'Dark Matter' THEN '-' ELSE coalesce(string_split(taxon, '|')[8], '-') END AS species, taxon, total FROM bare""")
def taxon_report(spark, sf_dir):
    """Reads by group and year at two levels at once, with labels, species and taxa."""
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "n_regionkey")
    li = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("sample"), "l_returnflag", "l_suppkey").where(F.col("sample").isin(YEARS)).join(places, "l_suppkey")
    total = li.groupBy("sample").agg(F.count("*").alias("n_total"), F.count_if(F.col("l_returnflag") != "N").alias("n_found"))
    groups = F.explode(F.array(F.struct(F.concat(F.lit("s"), "s_nationkey").alias("grp"), F.when(F.col("s_nationkey") % 3 == 0, 0.001).otherwise(1.0).alias("w")), F.struct(F.concat(F.lit("u"), "n_regionkey").alias("grp"), F.lit(1.0).alias("w"))))
    counts = li.where("l_returnflag <> 'N'").select("sample", groups.alias("g")).groupBy("sample", "g.grp", "g.w").agg((F.count("*") * F.col("w")).alias("n")).join(total, "sample")
    taxa = profile.taxonomy(profile.bands(_plainly_assigned(spark, sf_dir)), mapping.addresses(spark, sf_dir), _labels(spark, sf_dir), _names(spark, sf_dir)).select("grp", F.col("taxonomy").alias("taxon"))
    samples = counts.join(taxa, "grp", "left").withColumn("pct_matched", 100.0 * F.col("n") / F.col("n_found"))
    found = profile.full_report(samples, YEARS, ["s", "u"], low=0.00001, absolute=True, label=profile.label_of(F.col("taxon"), RULES))
    return found.select("grp", "label", *[F.col(f"`{y}`").alias(f"y{y}") for y in YEARS], "species", "taxon", "total")


CERTAIN = 0.9  # weight of each read in the profile file's query
LINES = f"""{TAXONOMY}, whole AS (SELECT (SELECT count(*) FROM orders) AS n, count(DISTINCT read_id) AS matched, {CERTAIN} * sum(prop) AS certain FROM assigned),
refs AS (SELECT grp, {CERTAIN} * sum(weight) AS w, string_agg(CAST(tax_id AS VARCHAR), ',' ORDER BY round({CERTAIN} * b0, 7) DESC, tax_id) AS refs FROM flat GROUP BY 1)"""


@query(f"""WITH {LINES} SELECT concat_ws(chr(9), 'Total', n, printf('%.3f', CAST(matched AS DOUBLE))) AS value FROM whole UNION ALL SELECT concat_ws(chr(9), 'Unmatched', printf('%.3f', 100.0 * (n - matched) / n), '0.000') FROM whole
UNION ALL SELECT concat_ws(chr(9), 'Uncertain_match', printf('%.3f', 100 * (matched - certain) / n), printf('%.3f', 100 * (matched - certain) / matched)) FROM whole
UNION ALL SELECT concat_ws(chr(9), grp, printf('%.4f', 100 * w / n), printf('%.4f', 100 * w / matched), taxonomy || ' (' || refs || ')') FROM refs JOIN taxa USING (grp), whole WHERE w / n >= 0.0001""")
def profile_file(spark, sf_dir):
    """The lines of a profile file with taxonomies of all ranks."""
    assigned = _plainly_assigned(spark, sf_dir).withColumn("depth_w", F.lit(CERTAIN))
    n_reads = table(spark, sf_dir, "orders").count()
    found = profile.full_profile(assigned, mapping.addresses(spark, sf_dir), _labels(spark, sf_dir), _names(spark, sf_dir), n_reads)
    return profile.file_lines(found, profile.summary(assigned, n_reads))


# Suppliers are species of nations (phyla) of regions (superkingdoms); an order's truth is the supplier of its first line.
TOLD = ("superkingdom", "phylum", "species")
TRUTH = f"""{PLAIN}, tree AS (SELECT s_suppkey AS sup, 1000000000 + n_regionkey AS superkingdom, 2000000000 + s_nationkey AS phylum, 10 + s_suppkey AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey),
truth AS (SELECT o_orderkey AS read_id, t.* FROM orders JOIN tree t ON t.sup = (SELECT arg_min(l_suppkey, {{'a': l_linenumber, 'b': l_suppkey}}) FROM lineitem WHERE l_orderkey = o_orderkey)),
vote AS (SELECT s_suppkey % 40 AS grp, 10 + s_suppkey AS species, s_suppkey % 7 > 0 AS formal FROM supplier), kept AS (SELECT grp, species, formal FROM vote QUALIFY formal OR NOT bool_or(formal) OVER (PARTITION BY grp)),
rows AS (SELECT read_id, round(prop, 9) AS prop, round(dist, 9) AS dist, k.species, k.formal, x.superkingdom, x.phylum FROM assigned a JOIN kept k ON k.grp = a.tax_id % 40 JOIN tree x ON 10 + x.sup = k.species),
told AS ({' UNION ALL '.join(f"SELECT read_id, '{r}' AS rank, {'CASE WHEN dist >= 5 OR NOT formal THEN 0 ELSE species END' if r == 'species' else r} AS id, prop FROM rows" for r in TOLD)}),
sure AS (SELECT read_id, rank, list(DISTINCT id) AS ids FROM (SELECT read_id, rank, id FROM told GROUP BY ALL HAVING sum(prop) >= 0.8) GROUP BY ALL),
pairs AS ({' UNION ALL '.join(f"SELECT '{r}' AS rank, t.{r} AS t, coalesce(s.ids, [0]) AS p FROM truth t JOIN (SELECT DISTINCT read_id FROM rows) q USING (read_id) LEFT JOIN sure s ON s.read_id = t.read_id AND s.rank = '{r}'" for r in TOLD)}),
kind AS (SELECT rank, CASE WHEN list_contains(p, t) THEN 'true' WHEN len(list_filter(p, lambda x: x <> 0)) > 0 THEN 'wrong' ELSE 'missed' END AS k FROM pairs)"""


@query(f"""WITH {TRUTH}, c AS (SELECT rank, count(*) FILTER (WHERE k = 'true') AS tp, count(*) FILTER (WHERE k = 'wrong') AS w, count(*) FILTER (WHERE k = 'missed') AS m FROM kind GROUP BY 1)
SELECT rank, tp AS n_true, w AS n_false_positive, w + m AS n_false_negative, round(tp / (tp + w), 6) AS precision, round(tp / (tp + w + m), 6) AS recall FROM c""")
def truth_scores(spark, sf_dir):
    """From a taxonomy, a truth of reads and their assignments to scores by rank."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    key = lambda c, base: F.col(c).cast("long") + base
    nodes = s.select(key("s_suppkey", 10).alias("id"), key("s_nationkey", 2_000_000_000).alias("parent"), F.lit("species").alias("rank"))
    nodes = nodes.unionByName(n.select(key("n_nationkey", 2_000_000_000).alias("id"), key("n_regionkey", 1_000_000_000).alias("parent"), F.lit("phylum").alias("rank")))
    nodes = nodes.unionByName(r.select(key("r_regionkey", 1_000_000_000).alias("id"), F.lit(None).cast("long").alias("parent"), F.lit("superkingdom").alias("rank")))
    ranked = stored(truth.rank_ids(nodes, ranks=TOLD))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("sup"))
    truths = truth.truth(li.select(F.col("l_orderkey").alias("read"), (F.col("sup") + 10).alias("taxid")), ranked, TOLD)
    members = s.select(F.col("s_suppkey").alias("tax_id"), (F.col("s_suppkey") % 40).alias("grp"), F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") + 10).alias("taxid"), (F.col("s_suppkey") % 7 > 0).alias("formal"))
    assigned = _plainly_assigned(spark, sf_dir).withColumns({"prop": F.round("prop", 9), "dist": F.round("dist", 9)})
    found = truth.graded(truths, assigned, members, ranked, TOLD)
    return found.select("rank", "n_true", "n_false_positive", "n_false_negative", _r("precision"), _r("recall"))


@query("""WITH rules AS (SELECT DISTINCT substring(c_name, 7, 11) || CASE c_custkey % 3 WHEN 0 THEN '[0-4]$' WHEN 1 THEN '.$' ELSE '(1|7)' END AS pattern, c_mktsegment AS label FROM customer WHERE c_custkey % 2 = 0),
met AS (SELECT c_custkey, min({'label': label, 'pattern': pattern}) AS m FROM customer JOIN rules ON regexp_matches(c_name, pattern) GROUP BY 1) SELECT c.c_custkey, coalesce(m.m.label, 'non') AS label FROM customer c LEFT JOIN met m USING (c_custkey)""")
def rule_table_labels(spark, sf_dir):
    """Customers' names labelled by hundreds of patterns that every second customer makes."""
    c = table(spark, sf_dir, "customer")
    tail = F.when(F.col("c_custkey") % 3 == 0, "[0-4]$").when(F.col("c_custkey") % 3 == 1, ".$").otherwise("(1|7)")
    made = c.where("c_custkey % 2 = 0").select(F.concat(F.substring("c_name", 7, 11), tail).alias("pattern"), F.col("c_mktsegment").alias("label"))
    return rules.labelled(c.select("c_custkey", "c_name"), "c_name", made).select("c_custkey", "label")
