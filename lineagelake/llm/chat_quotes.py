"""Chat formatting: quotation linking.

A message's lines carry nested quote marks. Runs of lines of one level are passages; quoted
passages are hashed in a normal form and joined to the messages of the same conversation
that first said them. A quoted passage is asked for whole, and where nobody said it so, by
its paragraphs, and then by its lines, so that a quote of a part is linked too. Passages of
any length are linked alike. The links make a reply tree, and conversations are built in reply order from what is left without
quotes.

Scale: what is said is first cut to one row for each conversation and hash (an ordinary
pre-aggregated minimum), so a passage that is repeated or quoted thousands of times is
joined row by row, never pair by pair. Reply threads are found by pointer jumping, a
logarithmic number of joins, and every output is one row a message: no conversation, however
long, is gathered into one task. A message takes time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.session import checkpoint, own_exchange

_MARKS = r"^[ \t]*((?:>[ \t]?)*)"


def normal(text: Column) -> Column:
    """Quote marks, case, and white space runs don't tell passages apart."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?m)^[ \t]*(?:>[ \t]?)+", "")), r"\s+", " "))


def lines_of(text: Column) -> Column:
    """array<struct(level, line)>: quote level and text of each line."""

    def one(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, r"[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, _MARKS, "")).otherwise(x).alias("line"))

    return F.transform(F.split(text, r"\r?\n", -1), one)


def passages_of(lines: Column) -> Column:
    """array<struct(level, text)>: runs of lines of one level, in order.

    Lines hold no line feed, so a line feed and a sign can stand between them: = where a run
    begins, + inside it; the runs are what stands between the = signs."""

    def cut(at: Column) -> Column:
        begins = lambda x, i: (i == 0) | (F.get(at, i - 1)["level"] != x["level"])
        joined = F.array_join(F.transform(at, lambda x, i: F.concat(F.when(begins(x, i), F.lit("\n=")).otherwise("\n+"), x["line"])), "")
        parts = F.slice(F.split(joined, "\n=", -1), F.lit(2), F.size(at))
        levels = F.filter(F.transform(at, lambda x, i: F.when(begins(x, i), x["level"])), lambda x: x.isNotNull())
        return F.zip_with(levels, parts, lambda n, t: F.struct(n.alias("level"), F.replace(t, F.lit("\n+"), F.lit("\n")).alias("text")))

    # Bound here: the optimiser may put the lines' expression in place of their column, and
    # would then work it out again for each line.
    return F.element_at(F.transform(F.array(lines), cut), 1)


def _key(messages: DataFrame) -> DataFrame:
    """One row for each different message: repeated rows are one, and different ones of one
    (conv_id, turn) are told apart by `variant`, a hash of role and text."""
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.where("conv_id is not null and turn is not null").distinct()
    return known.withColumn("variant", F.xxhash64("role", "text"))


def _paragraphs(text: Column) -> Column:
    return F.split(text, r"\n[ \t]*\n")


def _forms(texts: Column) -> Column:
    """Normal forms that are not empty."""
    return F.array_distinct(F.filter(F.transform(texts, normal), lambda x: x != ""))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, variant, role, content, n_quotes, n_linked, parent, parent_variant):
    content is the message without quoted lines, n_quotes its quoted passages, n_linked those
    that an earlier turn said at least in part; parent the latest turn that first said one,
    null if none is found."""
    lines = _key(messages).withColumn("l", lines_of(F.col("text")))
    split = lines.withColumn("p", passages_of(F.col("l"))).drop("l", "text")
    own = F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: x["text"])
    split = split.select("conv_id", "turn", "variant", "role", own.alias("own"), F.filter("p", lambda x: x["level"] > 0).alias("q"))
    whole = F.array_join("own", "\n")
    split = split.withColumn("content", F.when(F.size("q") > 0, F.trim(F.regexp_replace(whole, r"\n{3,}", "\n\n"))).otherwise(whole))
    key = ["conv_id", "turn", "variant"]

    # Ways to ask for a passage, the surest first: whole, by paragraph, by line.
    t = F.col("q.text")
    ways = F.array(*[F.struct(F.lit(i).alias("way"), x.alias("forms")) for i, x in enumerate((F.array(t), _paragraphs(t), F.split(t, "\n")))])
    asked = split.select(*key, F.posexplode("q").alias("at", "q")).select(*key, "at", F.explode(ways).alias("w")).select(*key, "at", "w.way", F.explode(_forms(F.col("w.forms"))).alias("n"))
    asked = asked.select(*key, "at", "way", F.sha2("n", 256).alias("hash"))
    units = _forms(F.concat(F.array("content"), F.col("own"), _paragraphs(F.col("content")), F.split("content", "\n")))
    said = split.select(*key, F.explode(units).alias("n")).select(*key, F.sha2("n", 256).alias("hash"))
    # Only what some message quotes is needed, and of each the first message alone; who says it later takes no link away.
    needed = said.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    first = needed.groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "variant")).alias("origin"))
    found = asked.join(own_exchange(first, "conv_id"), ["conv_id", "hash"]).where("origin.turn < turn")
    best = found.groupBy(*key, "at").agg(F.min(F.struct("way", (-F.col("origin.turn")).alias("back"), F.col("origin.variant").alias("v"))).alias("b"))
    links = best.groupBy(*key).agg(F.max(F.struct((-F.col("b.back")).alias("turn"), F.col("b.v").alias("variant"))).alias("up"), F.count("*").alias("n_linked"))
    out = split.select(*key, "role", "content", F.size("q").cast("long").alias("n_quotes"))
    return out.join(links, key, "left").select(*key, "role", "content", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("up.turn").alias("parent"), F.col("up.variant").alias("parent_variant"))


def conversations(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """messages (conv_id, turn, role, text, ...): one row for each message, to be read in the
    order of conv_id, thread, depth and turn.

    Returns conv_id, turn, variant, role, content, n_quotes, n_linked, parent, thread (turn
    of the message that the replies go back to; a message without a linked quote is its own)
    and depth (replies up to it). variant tells different messages of one turn apart; all
    stay. Rows with a null conv_id or turn have no place in a conversation and are left out;
    repeated rows are one message. Null texts are empty messages. Other columns are not
    read. An empty table gives no rows.
    """
    linked = checkpoint(link(messages))
    # Only messages in the reply tree are walked; the others are threads of their own.
    node, up = F.struct("turn", "variant"), F.struct(F.col("parent").alias("turn"), F.col("parent_variant").alias("variant"))
    jump = checkpoint(linked.where("parent is not null").select("conv_id", node.alias("node"), up.alias("up"), F.lit(1).cast("long").alias("depth")))
    for _ in range(max_rounds):
        above = jump.select("conv_id", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        step = jump.join(above, ["conv_id", "up"], "left").select("conv_id", "node", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved"))
        step = checkpoint(step)
        jump = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    threads = jump.select("conv_id", "node.turn", "node.variant", F.col("up.turn").alias("thread"), "depth")
    out = linked.join(threads, ["conv_id", "turn", "variant"], "left")
    return out.select("conv_id", "turn", "variant", "role", "content", "n_quotes", "n_linked", "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
