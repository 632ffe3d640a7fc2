"""Secret scans: plain patterns, and sliding-window entropy over candidate strings.

Everything is a column expression on one text, so the scan is one narrow pass inside the
JVM, with no shuffle. Places of matches come from the lengths of what lies between them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The plain kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<start:long,rank:int,end:long>>"


@dataclass(frozen=True)
class Entropy:
    """Candidates are runs of at least `window` characters of `run`. A candidate is a secret
    if some window of it has at least the bits a character of its class."""

    window: int = 20
    run: str = "A-Za-z0-9+/_=-"
    hex_bits: float = 3.0
    alnum_bits: float = 3.6
    base64_bits: float = 3.9
    # What only looks random: words, numbers, identifiers in their common form, example keys.
    allow: tuple[str, ...] = (
        r"^[A-Za-z/+=]+$",
        r"^[0-9]+$",
        r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
        r"EXAMPLE",
    )
    # Words (that end in two small letters) and short numbers joined by marks; short numbers
    # joined by marks. Stated by what must not be found, which needs no backtracking, so a
    # candidate of any length takes one pass.
    allow_without: tuple[str, ...] = (
        r"^[^A-Za-z]|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}|(?<=[A-Za-z])(?<![a-z][a-z])(?![A-Za-z0-9])",
        r"^[^0-9]|[A-Za-z]|[0-9]{5}",
    )


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join) -> Column:
    """Each value joined with all before it, by doubling: as many linear passes as the length
    has binary digits. join(a, b): b is the value from further left, null where there is none."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def one(acc: Column, k: Column) -> Column:
        left = F.concat(F.array_repeat(F.lit(None).cast("long"), F.call_function("shiftleft", F.lit(1), k)), acc)
        return F.slice(F.zip_with(acc, left, join), F.lit(1), F.size(acc))

    return F.aggregate(passes, values, one)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + F.coalesce(b, F.lit(0).cast("long")))


def _spans(text: Column, pattern: str, hits: Column, rank: int) -> Column:
    """Span of each hit, in code points: what lies before it gives its start."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    ends = running_sum(F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.length(h)).cast("long")))
    span = F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), F.lit(rank).alias("rank"), e.alias("end")))
    return F.when(F.size(hits) > 0, span).otherwise(F.array().cast(SPAN))


# Sums of c log2 c are kept as whole numbers of this part of a bit, so that they add exactly.
_UNIT = 1 << 40


def window_entropy(word: Column, window: int) -> Column:
    """Most bits a character in any window of `window` characters of the word; null if the
    word is shorter.

    The window slides by one: a character that enters raises its count c to c + 1, one that
    leaves lowers it, and the sum of c log2 c changes by these two counts alone. So a word
    takes time in proportion to its length."""
    steps = [round(_UNIT * ((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0))) for c in range(window)]
    table = F.array(*[F.lit(x).cast("long") for x in steps])
    others = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))
    at = lambda w, i: F.substring(w, i, F.lit(1))

    def slide(wins: Column) -> Column:
        def move(w: Column, j: Column) -> Column:
            before = F.get(wins, j - 1)
            entered = F.get(table, others(w, at(w, F.lit(window))) - 1)
            left = F.get(table, others(before, at(before, F.lit(1))) - 1)
            whole = F.aggregate(F.sequence(F.lit(1), F.lit(window)), F.lit(0).cast("long"), lambda t, i: t + F.get(table, others(F.substring(w, F.lit(1), i - 1), at(w, i))))
            return F.when(j == 0, whole).otherwise(entered - left)

        return F.lit(math.log2(window)) - F.array_min(running_sum(F.transform(wins, move))) / F.lit(float(_UNIT * window))

    return F.when(F.length(word) >= window, _let(F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{window}}}))"), F.lit(1)), slide))


def is_secret(word: Column, rule: Entropy) -> Column:
    """Whether a candidate is random enough for its class and not on the allow list."""
    allowed = F.lit(False)
    for pattern in rule.allow:
        allowed = allowed | word.rlike(pattern)
    for pattern in rule.allow_without:
        allowed = allowed | ~word.rlike(pattern)
    hexadecimal, alnum = word.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), word.rlike("^[A-Za-z0-9]+$")
    least = F.when(hexadecimal, rule.hex_bits).when(alnum, rule.alnum_bits).otherwise(rule.base64_bits)
    bits = window_entropy(word, rule.window) >= least
    return ~allowed & F.coalesce(bits, F.lit(False))


def _outside(runs: Column, words: Column, base: Column) -> Column:
    """array<struct(s: span, w: its text)>: what of each run lies outside the base spans.

    All ends are sorted; between two of them one is inside a run and outside every base
    span, or not, as the sums of begins and ends before them say."""
    mark = lambda at, run, begun, plain: F.struct(at.alias("at"), F.lit(run).cast("long").alias("run"), begun.alias("i"), F.lit(plain).cast("long").alias("base"))
    none = F.lit(0).cast("long")
    marks = F.flatten(F.array(
        F.transform(runs, lambda s: mark(s["start"], 1, F.lit(1).cast("long"), 0)), F.transform(runs, lambda s: mark(s["end"], -1, none, 0)),
        F.transform(base, lambda s: mark(s["start"], 0, none, 1)), F.transform(base, lambda s: mark(s["end"], 0, none, -1)),
    ))

    def between(m: Column) -> Column:
        sums = F.struct(*[running_sum(m[f]).alias(f) for f in ("run", "i", "base")])
        return _let(sums, lambda n: F.filter(F.transform(m, lambda x, i: F.when(
            (F.get(n["run"], i) > 0) & (F.get(n["base"], i) == 0) & (F.get(m, i + 1)["at"] > x["at"]),
            _let(F.struct(F.element_at(runs, F.get(n["i"], i).cast("int"))["start"].alias("from"), F.element_at(words, F.get(n["i"], i).cast("int")).alias("w")), lambda r: F.struct(
                F.struct(x["at"].alias("start"), F.lit(3).alias("rank"), F.get(m, i + 1)["at"].alias("end")).alias("s"),
                F.substring(r["w"], (x["at"] - r["from"]).cast("int") + 1, (F.get(m, i + 1)["at"] - x["at"]).cast("int")).alias("w"),
            )),
        )), lambda x: x.isNotNull()))

    return _let(F.array_sort(marks), between)


def _with_spans(texts: DataFrame, rule: Entropy) -> DataFrame:
    """texts (row, text, never null): adds base and found, the base spans and all spans."""
    run = f"(?<![{rule.run}])[{rule.run}]{{{rule.window},}}"
    # Each pattern meets the whole text once; what follows is for texts with hits.
    first = texts.withColumn("hits", F.struct(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for p, k in ((ASSIGN, "assign"), (ACCESS, "access"), (HEX, "hex"), (run, "entropy"))]))
    t, h = F.col("text"), F.col("hits")
    second = F.when(F.size(h["assign"]) > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    assign = F.zip_with(_spans(t, ASSIGN, h["assign"], 0), second, lambda s, g: F.when(F.length(g) >= 6, s))
    assign = F.filter(assign, lambda s: s.isNotNull())
    base = F.array_sort(F.concat(assign, _spans(t, ACCESS, h["access"], 1), _spans(t, HEX, h["hex"], 2)))
    placed = first.withColumn("base", base).withColumn("runs", _spans(t, run, h["entropy"], 3))
    whole = F.zip_with("runs", h["entropy"], lambda s, w: F.struct(s.alias("s"), w.alias("w")))
    pieces = F.when(F.size("base") > 0, _outside(F.col("runs"), h["entropy"], F.col("base"))).otherwise(whole)
    more = F.transform(F.filter(pieces, lambda x: is_secret(x["w"], rule)), lambda x: x["s"])
    more = F.when(F.size("runs") > 0, more).otherwise(F.array().cast(SPAN))
    return placed.withColumn("found", F.array_sort(F.concat("base", more))).drop("hits", "runs")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rule: Entropy = Entropy()) -> DataFrame:
    """docs (doc_id, text, ...): spans of each row's secrets, starts from 0 and ends
    exclusive in code points.

    Returns doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans (both listed as
    kind:start:end, by start and kind). Of a run that a plain span overlaps, what lies
    outside is judged by itself. Null and empty texts have no spans. Repeated rows stay
    repeated, each scanned by itself; other columns are not read. An empty table gives no
    rows.
    """
    found = _with_spans(docs.select(F.col("doc_id").cast("long").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rule)
    count = lambda r: F.size(F.filter("found", lambda s: s["rank"] == r)).cast("long")
    return found.select(F.col("row").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], _listed(F.col("base")).alias("base_spans"), _listed(F.col("found")).alias("spans"))


def _islands(spans: Column) -> Column:
    """Overlapping spans (sorted by start) as one."""
    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def cut(e: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(e, i - 1)))
        last = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(spans)) - 1
        return _let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), F.get(e, last(b, k)).alias("end"))))

    return _let(ends, cut)


def _replaced(text: Column, islands: Column, mark: str) -> Column:
    """The text is halved between islands until a part has one at most: each round copies the
    text once, and there are as many rounds as the number of islands has binary digits."""
    whole = F.array(F.struct(text.alias("t"), F.lit(0).cast("long").alias("at"), islands.alias("s")))

    def halve(x: Column) -> Column:
        m = F.floor(F.size(x["s"]) / 2).cast("int")
        cut = (F.get(x["s"], m)["start"] - x["at"]).cast("int")
        left = F.struct(F.substring(x["t"], F.lit(1), cut).alias("t"), x["at"].alias("at"), F.slice(x["s"], F.lit(1), m).alias("s"))
        right = F.struct(F.substring(x["t"], cut + 1, F.length(x["t"])).alias("t"), (x["at"] + cut).alias("at"), F.slice(x["s"], m + 1, F.size(x["s"])).alias("s"))
        return F.when(F.size(x["s"]) > 1, F.array(left, right)).otherwise(F.array(x))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(islands), F.lit(1)).cast("double"))).cast("int"))
    parts = F.aggregate(rounds, whole, lambda acc, _: F.flatten(F.transform(acc, halve)))

    def put(x: Column) -> Column:
        s = F.get(x["s"], F.lit(0))
        before = F.substring(x["t"], F.lit(1), (s["start"] - x["at"]).cast("int"))
        return F.when(F.size(x["s"]) > 0, F.concat(before, F.lit(mark), F.substring(x["t"], (s["end"] - x["at"]).cast("int") + 1, F.length(x["t"])))).otherwise(x["t"])

    return F.array_join(F.transform(parts, put), "")


def redact(docs: DataFrame, mark: str = "[SECRET]", rule: Entropy = Entropy()) -> DataFrame:
    """docs with each secret replaced by the mark (overlapping spans by one mark), and
    n_chars, if docs has it, counted anew. Null texts stay null. No row goes, and columns of
    any name stay."""
    text = F.col("text").cast("string")
    found = _with_spans(docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(text, F.lit("")).alias("text")), rule)
    clean = F.when(F.size("found") > 0, _replaced(F.col("text"), _islands(F.col("found")), mark)).otherwise(F.col("row.text"))
    out = found.select("row", clean.alias("text"), (F.size("found") > 0).alias("hit"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(F.col("row")[c] if new.get(c) is None else new[c]).alias(c) for c in docs.columns])
