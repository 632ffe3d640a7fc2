import random
import re

import pytest

from lineagelake.operators import profile, rules


def test_fixed_text_is_in_every_match():
    assert rules.fixed_text("^Salmonella ent.rica$") == "Salmonella ent" and rules.fixed_text("ab+cdef") == "cdef" and rules.fixed_text("x(yz)w") == "xyzw"
    assert rules.fixed_text("a|bcd") == "" and rules.fixed_text("(?i)abc") == "" and rules.fixed_text("abc?de") == "ab" and rules.fixed_text("(abc){2}d") == "abc"
    assert rules.fixed_text("(abc|xbd)ef") == "ef" and rules.fixed_text(r"a\.b\d+c") == "a.b" and rules.fixed_text("[") == ""


def test_thousands_of_rules_match_one_by_one(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcd ", k=rng.randint(0, 14))) for _ in range(400)] + [None, "", "ab"]
    made = ["".join(rng.choices("abcd", k=3)) + rng.choice(["", ".", "[ab]", "+", "?", "d*", "$", "(a|b)"]) + "".join(rng.choices("abcd", k=rng.randint(0, 4))) for _ in range(3000)]
    table = [(p, f"l{rng.randint(0, 40)}") for p in made] + [("^a.*d$", "l05"), ("x|dd", "l07"), ("abc", "*"), ("abc", "zz")]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, taxon string").selectExpr("*", "1 as pattern", "2 as g")
    got = {r.id: r.label for r in rules.labelled(df, "taxon", spark.createDataFrame(table, "pattern string, label string")).collect()}
    ordered = sorted(set(table), key=lambda r: (r[1], r[0]))
    want = {i: next((lab for p, lab in ordered if n is not None and re.search(p, n)), "non") for i, n in enumerate(names)}
    assert got == want and len(set(want.values())) > 5
    few = ordered[:20]
    same = {r.id: r.label for r in df.select("id", profile.label_of(df.taxon, few).alias("label")).collect()}
    assert {i: x for i, x in same.items() if names[i] is not None} == {r.id: r.label for r in rules.labelled(df, "taxon", spark.createDataFrame(few, "pattern string, label string")).collect() if names[r.id] is not None}


def test_too_many_free_patterns(spark, monkeypatch):
    monkeypatch.setattr(rules, "FREE", 3)
    df = spark.createDataFrame([("abc",)], "taxon string")
    with pytest.raises(ValueError):
        rules.labelled(df, "taxon", spark.createDataFrame([(f"{c}.", "x") for c in "abcd"], "pattern string, label string"))
    assert rules.labelled(df.limit(0), "taxon", spark.createDataFrame([], "pattern string, label string")).count() == 0


def test_rules_meet_few_names_that_are_alike(spark):
    """Names that differ in their last digits alone: groups of three characters would bring
    some 300,000 names and rules together."""
    names = spark.range(2000).selectExpr("id", "format_string('Customer#%09d', id) as taxon")
    made = names.selectExpr("concat(substring(taxon, 7, 11), if(id % 3 = 0, '[0-4]$', '(1|7)')) as pattern", "concat('l', id % 5) as label")
    found = rules.labelled(names, "taxon", made)
    table = sorted({(r.pattern, r.label) for r in made.collect()}, key=lambda r: (r[1], r[0]))
    by_text = {}
    for p, lab in table:
        by_text.setdefault(p[:11], []).append((p, lab))
    got = {r.taxon: r.label for r in found.collect()}
    assert got == {n: next((lab for p, lab in by_text.get(n[6:17], []) if re.search(p, n)), "non") for n in got} and len(got) == 2000
    long = names.limit(1).select(rules._width(rules.F.lit("er#00000000")).alias("w")).first().w
    assert long == 8 and "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
