"""Labels by many regular expressions: rules stay a table.

Most patterns have a stretch of fixed text that every match holds. Its rarest group of
characters, by how many names hold it, is the rule's entry in an inverted index; names meet
rules there by an ordinary join, and only what meets and holds the fixed text is matched. A
group has the largest width, of three, four, eight and so on, that the fixed text has, so
long fixed texts meet few names however alike these are. A rule whose fixed text has a group
that no name holds meets nothing. Patterns without three characters of fixed text are tried
on every name, so there may be only few.

Names and rules are alike and compress to a small part of what they are in memory, which the
files of stored tables hide, so joins of them are merged and none is broadcast.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.session import own_exchange, stored

SIZE = 3
FREE = 2000  # patterns without fixed text


def fixed_text(pattern: str) -> str:
    """The longest stretch of text that every match holds; empty if none is known, as for
    patterns with flags and with syntax that Python's parser doesn't read."""
    if "(?" in pattern:
        return ""
    try:
        tree = parser.parse(pattern)
    except Exception:  # noqa: BLE001  # a pattern of another dialect
        return ""
    found: list[str] = [""]

    def walk(items) -> None:
        for kind, value in items:
            if kind is kinds.LITERAL:
                found[-1] += chr(value)
                continue
            if kind is kinds.SUBPATTERN and not (value[1] or value[2]):
                walk(value[3])
                continue
            if kind is kinds.AT and value in (kinds.AT_BEGINNING, kinds.AT_END):
                found.append("")
                continue
            found.append("")
            if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] >= 1:
                walk(value[2])
                found.append("")

    walk(tree)
    return max(found, key=len)


def _with_text(rules: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([fixed_text(p) for p in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["pattern", "label", "text"])

    return rules.select("pattern", "label").where("pattern is not null").distinct().mapInArrow(run, "pattern string, label string, text string")


def _width(text: Column) -> Column:
    """Of the group that a fixed text of SIZE characters or more is found by."""
    return F.when(F.length(text) <= SIZE, SIZE).otherwise(F.pow(F.lit(2), F.floor(F.log2(F.length(text) + 0.5)))).cast("int")


def _groups(text: Column, width: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - width + 1)
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, width)))).otherwise(F.array().cast("array<string>"))


def labelled(rows: DataFrame, name: str, rules: DataFrame, default: str = "non", label: str = "label") -> DataFrame:
    """rows with a label: that of the first rule, by label and then pattern, whose pattern is
    found in the column `name`; `default` where none is, and for null names.

    rules (pattern, label): any number with fixed text, and at most FREE without."""
    names = stored(rows.select(F.col(name).cast("string").alias("_name")).where("_name is not null").distinct())
    told = stored(_with_text(rules))
    free = told.where(F.length("text") < SIZE).select("pattern", "label").limit(FREE + 1).collect()
    if len(free) > FREE:
        raise ValueError(f"over {FREE} patterns have no fixed text of {SIZE} characters")
    long = told.where(F.length("text") >= SIZE).withColumn("width", _width(F.col("text")))
    widths = [F.lit(r.width) for r in long.select("width").distinct().orderBy("width").collect()]  # powers of two
    asked = stored(long.select("pattern", "label", "text", F.explode(_groups(F.col("text"), F.col("width"))).alias("g")))
    groups = F.flatten(F.array(*[_groups(F.col("_name"), w) for w in widths])) if widths else F.array().cast("array<string>")
    held = names.select("_name", F.explode(groups).alias("g")).join(asked.select("g").distinct().hint("merge"), "g", "left_semi")
    often = held.groupBy("g").agg(F.count("*").alias("f"))
    rare = asked.join(own_exchange(often, "f").withColumn("g", F.concat("g", F.lit(""))).hint("merge"), "g", "left").groupBy("pattern", "label", "text").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("r"))
    index = rare.where("r.f > 0").select("pattern", "label", "text", F.col("r.g").alias("g"))
    met = held.join(index.hint("merge"), "g").where(F.contains("_name", F.col("text"))).where(F.regexp_like("_name", F.col("pattern"))).select("_name", "label", "pattern")
    if free:
        tried = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label")) for r in free])
        few = names.select("_name", F.explode(F.filter(tried, lambda r: F.regexp_like(F.col("_name"), r["pattern"]))).alias("r"))
        met = met.unionByName(few.select("_name", "r.label", "r.pattern"))
    first = met.groupBy("_name").agg(F.min(F.struct("label", "pattern"))["label"].alias("_label"))
    out = rows.join(first.hint("merge"), rows[name].cast("string") == F.col("_name"), "left")
    return out.select(*[rows[c] for c in rows.columns], F.coalesce("_label", F.lit(default)).alias(label))
