"""Queries that are SQL text for Spark, by the registered functions."""

from __future__ import annotations

from lineagelake.functions import sql
from lineagelake.plans import mapping
from lineagelake.plans.registry import CATALOG, SEARCH, SKETCHES, K, S, _sketches, query
from lineagelake.session import stored, table


@query(f"WITH {CATALOG} SELECT u, s, count(*) AS n, min(barcode) AS least, count(DISTINCT 'u' || u || '.s' || s || '.r' || r) AS n_prefixes FROM catalog GROUP BY ALL")
def sql_barcodes(spark, sf_dir):
    sql.register(spark)
    text = """SELECT b.u, b.s, count(*) AS n, min(barcode) AS least, count(DISTINCT barcode_prefix(barcode, 'r')) AS n_prefixes
    FROM (SELECT barcode, barcode_parse(barcode) AS b FROM {catalog}) GROUP BY b.u, b.s"""
    return spark.sql(text, catalog=mapping.catalog(spark, sf_dir))


@query(f"WITH {SKETCHES} SELECT doc_id, count(*) AS n_different, min(h) AS least, max(h) AS largest FROM mers GROUP BY 1")
def sql_kmers(spark, sf_dir):
    sql.register(spark)
    # Rows that share an id are one document, whose k-mers are put together; others are counted in the row.
    text = f"""WITH again AS (SELECT doc_id AS id FROM {{docs}} GROUP BY doc_id HAVING count(*) > 1)
    SELECT doc_id, n_different, least, largest FROM (SELECT d.doc_id, d.text FROM {{docs}} d LEFT ANTI JOIN again ON d.doc_id <=> again.id) d, LATERAL kmer_extent(d.text, {K})
    UNION ALL SELECT doc_id, count(DISTINCT h) AS n_different, min(h) AS least, max(h) AS largest FROM (SELECT d.doc_id, d.text FROM {{docs}} d LEFT SEMI JOIN again ON d.doc_id <=> again.id) d, LATERAL kmers(d.text, {K}) GROUP BY doc_id"""
    return spark.sql(text, docs=table(spark, sf_dir, "documents"))


@query(f"WITH {SEARCH} SELECT query, doc_id, round(dist, 6) AS dist FROM dd_s WHERE dist <= 0.12")
def sql_mash(spark, sf_dir):
    sql.register(spark)
    text = f"""WITH k AS (SELECT DISTINCT item_id, h FROM {{items}} i, LATERAL kmers(i.text, {K})), a AS (SELECT item_id, slice(array_sort(collect_list(h)), 1, {S}) AS hashes FROM k GROUP BY item_id),
    met AS (SELECT DISTINCT x.item_id, y.doc_id FROM (SELECT item_id, explode(hashes) AS h FROM a) x JOIN (SELECT doc_id, explode(hashes) AS h FROM {{held}}) y ON x.h = y.h)
    SELECT item_id AS query, doc_id, round(mash_distance(a.hashes, b.hashes, {K}, {S}), 6) AS dist FROM met JOIN a USING (item_id) JOIN {{held}} b USING (doc_id) WHERE mash_distance(a.hashes, b.hashes, {K}, {S}) <= 0.12"""
    return spark.sql(text, items=table(spark, sf_dir, "benchmark"), held=stored(_sketches(spark, sf_dir)))
