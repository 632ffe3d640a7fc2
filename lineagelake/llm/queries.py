"""The registered queries opN_<name>: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.session import table


def op1_quality_gam(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import quality_gam

    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import mixing

    return mixing.assign(table(spark, sf_dir, "documents"))


def op3_media_avi(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import media_avi

    return media_avi.read_media(media_avi.to_media(table(spark, sf_dir, "documents")))


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lineagelake.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), tokens=False)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import secret_scan

    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_chat_quotes(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import chat_quotes

    return chat_quotes.conversations(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lineagelake.llm import fertility

    return fertility.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """A page's URL ends in the number of the document it shows, whose quality labels it."""
    from lineagelake.llm import url_rules

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_rules.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    numbered = pages.select("url", number.alias("n")).selectExpr("url", "try_cast(n as long) as doc_id")
    judged = numbered.join(labels.select("doc_id", (F.col("quality") == 0).alias("blocked")), "doc_id").select("url", "blocked")
    return url_rules.judge(pages, judged)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_vector_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lineagelake.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    from lineagelake.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_SMALL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM t), i AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) AS z(k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL), z AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
s AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM s), v AS (SELECT u.lang, u.phrase, cut, a, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
FROM u JOIN z USING (lang) JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[cut + 1:u.k], ' ')),
b AS (SELECT lang, phrase, a, l, r, n, score FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b) WHERE rank <= 2000"""

OP13 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), z AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark), p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY t, nn),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN w USING (t), z GROUP BY ALL)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": OP11, "op13_lexical_search": OP13}
