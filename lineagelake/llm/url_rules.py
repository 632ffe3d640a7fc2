"""URL filters: host and path rules, and association rules mined from labelled URLs.

FP-growth mines combinations of URL tokens that go with a label. Rules that say `block` are
pruned by confidence, support and redundancy, and put into an inverted index by one of their
tokens; URLs meet the index by their own tokens, and the other tokens of a rule are then
looked for in the URL.

Scale: URLs are judged once each, however often a page repeats one. Frequent tokens are at
most (tokens a URL) / min_support; those that stand in the same URLs are mined as one, and
sets with an implied token are not made, so deep paths that many URLs share cost no more
than short ones. The index join is an ordinary join of Spark's choice; a token that most
URLs have is split by AQE.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.session import checkpoint, own_exchange

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "=block", "=allow"


@dataclass(frozen=True)
class Mining:
    """Least share and least number of labelled URLs that a rule blocks rightly; least
    confidence; most tokens a rule."""

    min_support: float = 0.005
    min_count: int = 20
    min_confidence: float = 0.8
    max_tokens: int = 3


def host_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.locate("://", url) + 3, F.length(url))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the host's suffixes and words, path segments by place with numbers
    as one token, the file ending, and names in the query."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda x: x != "")
    places = F.transform(parts, lambda x, i: F.concat_ws("", F.lit("p"), i.cast("string"), F.lit(":"), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))
    words = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("w:"), x))
    ending = F.transform(F.regexp_extract_all(path, F.lit(r"\.([A-Za-z0-9]{1,5})$"), F.lit(1)), lambda x: F.concat(F.lit("e:"), x))
    names = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(suffixes, words, places, ending, names))).otherwise(F.array().cast("array<string>"))


def _classes(labelled: DataFrame, least: int) -> DataFrame:
    """(token, class): tokens of at least `least` blocked URLs; those that stand in the same
    labelled URLs are one class, named by the least of them. No rule needs two of a class."""
    each = labelled.select(F.xxhash64(F.col("tokens"), F.col("_row")).alias("u"), "blocked", F.explode("tokens").alias("token"))
    where = F.struct(F.count("*").alias("n"), F.bit_xor("u").alias("x"), F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("s"))
    held = each.groupBy("token").agg(where.alias("where"), F.sum(F.col("blocked").cast("long")).alias("bad")).where(F.col("bad") >= least)
    named = held.groupBy("where").agg(F.min("token").alias("class"))
    return checkpoint(held.join(named, "where").select("token", "class"))


def _combinations(labelled: DataFrame, least: int, most: int) -> DataFrame:
    """labelled (_row, blocked, tokens: distinct classes, sorted): (items) with one row for
    each set of at most `most` classes of a URL, to which its size and the label are added.

    Sets grow by one class a level. A set goes on only if it is in `least` blocked URLs and
    in fewer URLs than each of its parts: one that is in as many as a part is as sure as
    that part, and so is all that holds it. Both hold for all parts of a set that is made.
    Rows are pairs of a URL and a set; no row holds all sets of its URL."""
    label = F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    single = checkpoint(labelled.select("_row", label.alias("label"), F.explode("tokens").alias("t")))
    items = lambda sets, k: sets.select(F.concat("set", F.array(F.lit(f"={k}"), F.col("label"))).alias("items"))
    now = single.select("_row", "label", F.array("t").alias("set"))
    counts = checkpoint(now.groupBy("set").agg(F.count("*").alias("n")))
    out = items(now, 1)
    for k in range(2, most + 1):
        more = single.select("_row", "t").alias("s")
        grown = now.alias("n").join(more, (F.col("n._row") == F.col("s._row")) & (F.col("t") > F.element_at("set", -1)))
        grown = grown.select("n._row", "label", F.array_append("set", F.col("t")).alias("set"))
        counted = grown.groupBy("set").agg(F.count("*").alias("n"), F.sum((F.col("label") == BLOCK).cast("long")).alias("bad")).where(F.col("bad") >= least)
        parts = counted.select("set", "n", F.explode("set").alias("t")).select("set", "n", F.array_remove("set", F.col("t")).alias("part"))
        fewer = parts.join(counts.select(F.col("set").alias("part"), F.col("n").alias("of_part")), "part").where("n < of_part")
        free = fewer.groupBy("set").agg(F.max("n").alias("n"), F.count("*").alias("parts")).where(F.col("parts") == k)
        counts = checkpoint(free.select("set", "n"))
        if not counts.limit(1).count():
            break
        now = checkpoint(grown.join(counts.select("set"), "set", "left_semi").select("_row", "label", "set"))
        out = out.unionByName(items(now, k))
    return out


def mine(labelled: DataFrame, mining: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """labelled (tokens array<string>, blocked boolean): (rules (tokens, confidence, support,
    anchor), classes (token, class)). A rule's tokens are classes, the anchor the one that
    fewest labelled URLs have; a URL has a class if it has one of its tokens.

    A rule is left out if it is no surer than one that lacks one of its tokens. FP-growth
    itself knows no longest set, and k tokens that often stand together are 2^k sets. So its
    transactions are the sets of at most `max_tokens` classes (see _combinations), each with
    an item for its size: a set and its size item are then counted once a URL."""
    spark = labelled.sparkSession
    if mining.max_tokens < 1:
        raise ValueError("max_tokens must be 1 or more")
    # Equal rows need names of their own; the number only tells them apart.
    rows = checkpoint(labelled.select("tokens", "blocked", F.monotonically_increasing_id().alias("_row")))
    n = rows.count()
    least = max(mining.min_count, math.ceil(mining.min_support * n), 1)
    classes = _classes(rows, least)
    each = rows.select("_row", "blocked", F.explode("tokens").alias("token")).join(classes, "token")
    kept = checkpoint(each.groupBy("_row").agg(F.first("blocked").alias("blocked"), F.array_sort(F.collect_set("class")).alias("tokens")))
    items = checkpoint(_combinations(kept, least, mining.max_tokens))
    total = items.count()
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double, anchor string")
    if not total:
        return none, classes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=mining.min_confidence, numPartitions=parts).fit(items)
    size = F.filter("antecedent", lambda x: x.rlike("^=[0-9]+$"))
    tokens = F.array_sort(F.filter("antecedent", lambda x: ~x.rlike("^=")))
    found = model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCK))) & ~F.array_contains("antecedent", ALLOW))
    found = found.select(tokens.alias("tokens"), size.alias("size"), "confidence", (F.round(F.col("support") * total) / n).alias("support"))
    rules = checkpoint(found.where(F.col("size") == F.array(F.concat(F.lit("="), F.size("tokens").cast("string")))).drop("size"))
    parts_of = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).select("tokens", "confidence", F.explode(F.array(F.array("t"), F.array_remove("tokens", F.col("t")))).alias("part"))
    simple = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    needless = parts_of.where(F.size("part") < F.size("tokens")).join(simple, "part").where("sure >= confidence").select("tokens").distinct()
    sure = rules.join(needless, "tokens", "left_anti")
    single = kept.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    anchors = sure.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return checkpoint(sure.join(anchors, "tokens")), classes


def match(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """urls (url, tokens): (url, mined, confidence), the surest rule of each URL that has one.

    The index has each rule under its anchor. Only classes that some rule names are looked
    up, so a URL brings few rows."""
    named = rules.select(F.explode("tokens").alias("class")).distinct()
    known = classes.join(named, "class", "left_semi")
    held = urls.select("url", F.explode("tokens").alias("token")).join(known, "token").groupBy("url").agg(F.collect_set("class").alias("held"))
    index = rules.select(F.col("anchor").alias("class"), F.col("tokens").alias("rule"), "confidence")
    met = held.select("url", "held", F.explode("held").alias("class")).join(index, "class").where(F.size(F.array_except("rule", "held")) == 0)
    best = F.max(F.struct("confidence", F.array_join("rule", " ").alias("mined")))
    return met.groupBy("url").agg(best.alias("b")).select("url", "b.mined", "b.confidence")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, mining: Mining = Mining()) -> DataFrame:
    """pages (page_id, url, ...) and labels (url, blocked boolean): page_id, host, path,
    rule, verdict, mined and confidence for each row of pages.

    The given rule's verdict stands; else `block` if a mined rule is met; else `allow`.
    Rules are mined from the given labels alone, of all URLs that have one; what a fixed rule
    says is no label, so it is not learnt back. A URL with labels for both is blocked. Null
    URLs and such without `://` have an empty host and path and are allowed. Repeated rows
    stay repeated; other columns are not read. An empty table gives no rows.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    urls = rows.where("url is not null").groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("_r.verdict").alias("ruled"))
    urls = checkpoint(urls.select("url", "ruled", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")))
    given = labels.where("url is not null and blocked is not null").groupBy("url").agg(F.max("blocked").alias("blocked"))
    known = urls.where(F.size("tokens") > 0).join(given, "url").select("tokens", "blocked")
    rules_found, classes = mine(known, mining)
    found = match(urls.where("ruled is null"), rules_found, classes)
    keyed = found.withColumn("key", F.xxhash64("url"))
    out = rows.withColumn("key", F.xxhash64("url")).join(own_exchange(keyed, "key"), ["key", "url"], "left")
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_r").isNull(), F.col("mined")).alias("mined"), F.when(F.col("_r").isNull(), F.col("confidence")).alias("confidence"))
