from pyspark.sql import functions as F

from lineagelake.config import LEVELS
from lineagelake.operators import profile


def test_taxonomy_by_rank(spark):
    # Two p groups in one s group; the second has two members.
    at = [(1, 1, 1, 1, 1), (2, 1, 1, 2, 2), (3, 1, 1, 2, 2), (4, 1, 9, 9, 9)]
    addresses = spark.createDataFrame([(t, u, s, r, p, t, t, t, t, t) for t, u, s, r, p in at], "tax_id long, " + ", ".join(f"{x} long" for x in LEVELS))
    labels = spark.createDataFrame([(1, "B", "g1", "a", None), (2, "B", "g1", "b", "x"), (3, "B", "g1", "*c", "x"), (4, "V", "g2", "d", "-")], "tax_id long, superkingdom string, genus string, species string, subspecies string")
    names = spark.createDataFrame([(1, "one", "A1"), (2, "two", None), (4, None, "A4")], "tax_id long, organism_name string, accession string")
    hits = [(1, 1, 0.5, 0.5), (2, 1, 0.5, 0.5), (3, 2, 4.0, 4.0), (4, 4, 9.0, 9.0), (5, -1, 0.0, 0.0)]
    assigned = spark.createDataFrame(hits, "read_id long, tax_id long, dist double, mean_dist double").selectExpr("*", "1D prop", "1D depth_w", "1D core_w")
    found = {r.grp: r for r in profile.full_profile(assigned, addresses, labels, names, 10, ranks=("superkingdom", "genus", "species", "subspecies")).collect()}
    # Weights: 1 has 2, 2 has 1 (its p group votes twice), 4 has 1 at the coarse levels.
    assert found["~1"].taxon == "B (V)" and found["u1"].taxon == "B (V)|g1 (g2)"
    assert found["s1"].taxon == "B|g1|a (*c/b)" and found["p1"].taxon == "B|g1|a|-|one: A1" and "p2" not in found
    assert found["r1"].taxon == "B|g1|a|-" and found["s1"].refs == "1,2" and found["s1"].pct_total == 30 and found["s1"].pct_matched == 60


def test_full_report_levels_and_rounding(spark):
    rows = [("x", "s1", 50.0, "a|b|c|d|e|f|g|sp (q)|z (y)", 80.0, 100), ("y", "s1", 10.0, "other", 50.0, 200), ("x", "u1", 60.0, "a", 80.0, 100), ("x", "s2", 0.3, "tiny", 80.0, 100), ("y", "r5", 9.0, "fine", 50.0, 200)]
    df = spark.createDataFrame(rows, "sample string, grp string, pct_matched double, taxon string, n_found double, n_total long")
    label = F.when(F.contains("taxon", F.lit("sp")), "known").otherwise("non")
    got = {r.grp: tuple(r)[1:] for r in profile.full_report(df, ["x", "y"], ["s", "u"], absolute=True, label=label).collect()}
    assert got["s1"] == ("known", 40.0, 5.0, "sp (q)", "a|b|c|d|e|f|g|sp (q)|z (y)", 45.0) and "s2" not in got and "r5" not in got
    assert got["u1"] == ("non", 48.0, 0.0, "-", "a", 48.0) and got["Unknown"] == ("non", 60.0, 195.0, "-", "Dark Matter", 0.0)
    pct = {r.grp: r.x for r in profile.full_report(df, ["x", "y"], ["s"], low=1.0).collect()}
    assert pct == {"s1": 40.0, "Unknown": 60.0}
    assert [r.grp for r in profile.full_report(df, ["x", "y"], ["s"], label=label, labelled_only=True).collect()] == ["s1"]
    assert profile.report(df, ["x", "y"], "s", absolute=True).where("grp = 's2'").count() == 0
