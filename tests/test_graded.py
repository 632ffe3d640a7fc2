import random

import pytest

from lineagelake.operators import truth

RANKS = ("superkingdom", "genus", "species")


@pytest.mark.parametrize("seed", [1, 2])
def test_graded_is_scores_of_what_is_predicted(spark, seed):
    rng = random.Random(seed)
    # Species in several groups, informal ones, ids without a genus, hits of no reference.
    ranked = spark.createDataFrame([(t, t % 2 + 1, t % 5, t) for t in range(10, 40)], "taxid long, superkingdom long, genus long, species long")
    members = [(x, x % 7, x, rng.randrange(10, 42), rng.random() < 0.7) for x in range(60)]
    rows = [(r, rng.choice([-1, *range(60)]), rng.choice([0.2, 0.5, 0.8, 1.0]), rng.choice([0.0, 4.0, 5.0, 9.0, 10.0, 30.0]), 0.0) for r in range(300) for _ in range(rng.randint(1, 4))]
    truths = spark.createDataFrame([(r, str(rng.randint(0, 2)), str(rng.randrange(5)), str(rng.choice([0, *range(10, 45)]))) for r in range(20, 320)], "read long, superkingdom string, genus string, species string")
    members = spark.createDataFrame(members, "tax_id long, grp long, unit long, taxid long, formal boolean")
    assigned = spark.createDataFrame(rows, "read_id long, tax_id long, prop double, dist double, mean_dist double")
    want = truth.rank_scores(truths, truth.predicted(assigned, members, ranked, RANKS), RANKS)
    got = truth.graded(truths, assigned, members, ranked, RANKS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kinds = got.selectExpr("sum(n_true) as a", "sum(n_false_positive) as b", "sum(n_both_unknown) as c").first()
    assert min(kinds) > 0
