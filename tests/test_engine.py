import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake.config import Settings
from lineagelake.functions import barcode, poisson
from lineagelake.operators import alignment, catalog, mixture, neighbours, profile, sketch


def test_settings(tmp_path):
    s = Settings.load(workspace="w", mismatch="0.1")
    assert s.catalog == "w/catalog" and s.mismatch == 0.1
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json"), kmer=21).kmer == 21
    with pytest.raises(KeyError):
        Settings.load(nothing=1)


def test_barcodes(spark):
    df = spark.createDataFrame([("u1.s2.r3.p4.n5.m6.e7.c8.a9",), ("u1.s2",), (None,)], "b string")
    rows = df.select(barcode.parse(df.b).alias("x"), barcode.prefix(df.b, "r").alias("p")).collect()
    assert rows[0].x.r == 3 and rows[0].x.a == 9 and rows[0].p == "u1.s2.r3" and rows[1].x is None and rows[2].x is None


def test_depth_band():
    def pmf(n, m):
        return n * math.log(m) - m - math.lgamma(n + 1)

    assert poisson.band_ratio(10, 10) == 0 and poisson.band_ratio(15, 10) == 0  # ceil(14.14) = 15
    assert poisson.band_ratio(16, 10) == pytest.approx(pmf(16, 10 * 2**0.5) - pmf(15, 10 * 2**0.5))
    assert poisson.band_ratio(3, 10) == pytest.approx(pmf(3, 10 / 2**0.5) - pmf(7, 10 / 2**0.5))
    assert poisson.band_ratio(7, 10) == 0
    assert poisson.band_ratio(15 + 20 * 4, 10) == -230.2585
    assert -40 < poisson.band_ratio(180, 100) < 0  # the normal branch
    assert poisson.band_ratio(100, 300) < 0 and poisson.band_ratio(213, 300) == 0


def test_depth_band_in_columns(spark):
    rows = [(float(n), m) for m in (0.02, 0.5, 1.0, 7.3, 10.0, 14.0, 15.0, 20.0, 90.0, 200.0, 241.0, 300.0, 5000.0) for n in sorted({0, 1, 2, 3, *(max(0, int(m * f)) for f in (0.2, 0.5, 0.7, 0.72, 1, 1.41, 1.42, 1.5, 1.7, 2, 3, 9, 40))})]
    df = spark.createDataFrame(rows, "n double, mean double")
    for r in df.withColumn("got", poisson.band_ratio_of(df.n, df.mean)).collect():
        want = poisson.band_ratio(r.n, r.mean)
        # The plain difference of error functions loses its digits towards 1e-16.
        assert r.got == pytest.approx(want, rel=1e-8 if want > -10 else 1e-3, abs=1e-9) if want > -28 else r.got < -20, (r, want)
    plan = df.select(poisson.band_ratio_of(df.n, df.mean))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    got = spark.createDataFrame([(float(x),) for x in (1, 1.5, 2, 3.7, 9, 20, 171, 1e5)], "x double").withColumn("g", poisson.log_gamma(F.col("x"))).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in got)


def one_pick_a_round(rows, limit):
    """rows (read, tax, rel_sim, weight): the cover as it is told."""
    out, left = [], list(rows)
    while left:
        sums = {}
        for _, t, rel, w in left:
            sums[t] = sums.get(t, 0.0) + rel * w
        t, s = min(sums.items(), key=lambda x: (-round(x[1], 9), x[0]))
        if 2.5 * s < limit:
            break
        out.append((t, s))
        gone = {r for r, u, rel, _ in left if u == t and rel >= 0.5}
        left = [x for x in left if x[1] != t and x[0] not in gone]
    return out


@pytest.mark.parametrize("most", [64, 3])
def test_cover_is_that_of_one_pick_a_round(spark, monkeypatch, most):
    rng = np.random.default_rng(most)
    rows = []
    for r in range(900):
        home = int(rng.integers(60))
        for t in {home, *(int(x) for x in rng.integers(0, 90, int(rng.integers(0, 3))))}:
            rows.append((r, t, float(rng.choice([1.0, 0.7, 0.3])), float(rng.choice([1.0, 0.5]))))
    df = spark.createDataFrame(rows, "read_id long, tax_id long, rel_sim double, weight double").selectExpr("*", "1D depth_w", "1D core_w", "1D lik")
    rounds = []
    kept = mixture.stored
    monkeypatch.setattr(mixture, "stored", lambda d: rounds.append(1) or kept(d))
    picked, limit = mixture.cover(df, 900, 0.0, 4.0, most=most)
    want = one_pick_a_round(rows, 4.0)
    assert [t for t, _ in picked] == [t for t, _ in want] and all(a == pytest.approx(b) for (_, a), (_, b) in zip(picked, want))
    assert len(want) > 40 and len(rounds) < len(want)


def test_cover_and_mixture(spark):
    rows = [(r, 1, 1.0, 1.0) for r in range(30)] + [(r, 2, 0.6, 0.5) for r in range(20)] + [(r, 3, 1.0, 2.0) for r in range(30, 40)] + [(r, 2, 1.0, 1.0) for r in range(40, 44)]
    df = spark.createDataFrame(rows, "read_id long, tax_id long, rel_sim double, lik double").selectExpr("*", "1D weight", "1D depth_w", "1D core_w")
    picked, limit = mixture.cover(mixture.candidates(df), 100, 0.01, 5.0)
    assert [p[0] for p in picked] == [1, 3, 2] and limit == 5.0 and picked[2][1] == pytest.approx(4.0)
    disjoint = df.where("tax_id <> 2")
    x = mixture.mixture(mixture.qmatrix(disjoint, disjoint.select("tax_id")))
    assert x[1] == pytest.approx(0.75) and x[3] == pytest.approx(0.25)
    x = mixture.mixture(mixture.qmatrix(df, df.select("tax_id")))
    q = {}
    for r, t, _, lik in rows:
        q.setdefault(r, {})[t] = lik
    grad = {t: sum(v.get(t, 0) / sum(v[k] * x[k] for k in v) for v in q.values()) / len(q) for t in x}
    assert sum(x.values()) == pytest.approx(1) and all(g <= 1 + 1e-4 for g in grad.values())
    assert mixture.mixture(mixture.qmatrix(df.limit(0), df.select("tax_id"))) == {}


def test_sam_rules(spark):
    a = "A" * 100
    rows = [
        (0, 1, 0, 1, "s1", 5, "100M", a, 190.0), (1, 1, 0, 1, "s1", 9, "100M", a, 180.0), (2, 1, 0, 2, "s1", 5, "60S40M", a, 100.0), (3, 1, 0, 3, "s1", 5, "5S90M5S", a, 100.0),
        (4, 1, 0, 4, "s1", 5, "4S92M4S", a, 100.0), (5, 1, 0, 5, "s9", 5, "100M", a, 190.0), (6, 1, 0, 6, "*", 0, "*", a, None), (7, 1, 256, 7, "s1", 5, "10S50M", "*", 80.0),
    ]
    df = spark.createDataFrame(rows, "ord long, mate int, flag int, read_id long, ref string, pos long, cigar string, seq string, score double")
    seqs = spark.createDataFrame([("s1", 11, 1)], "ref string, seq_id long, tax_id long")
    got = {r.read_id: r for r in alignment.from_sam(df, seqs).collect()}
    assert set(got) == {1, 4} and got[1].site == 5 and got[1].mut == pytest.approx(10 / 6) and got[4].mut == pytest.approx((200 - 106) / 6)


def test_selection(spark):
    rows = [(1, 5, "u1.s1.r1", "x", 1, 2), (2, 50, "u12.s1.r1", "y", 2, 2)]
    df = spark.createDataFrame(rows, "index long, size long, barcode string, kind string, r long, a long")
    ids = lambda d: sorted(r["index"] for r in d.collect())
    assert ids(catalog.select(df, {"kind": "x,y"}, 5, 49)) == [1] and ids(catalog.select(df, group="u1")) == [1, 2]
    assert ids(catalog.select(df, group="u1", strict_group=True)) == [1] and ids(catalog.select(df, tag="r==a")) == [2] and ids(catalog.select(df, tag="r!=a")) == [1]
    with pytest.raises(KeyError):
        catalog.select(df, {"name": "x"})


def test_sketch_distance_and_addresses(spark):
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("ACGT"), 3000))
    near = base[:1500] + "T" + base[1501:]
    far = "".join(rng.choice(list("ACGT"), 3000))
    df = spark.createDataFrame([(1, base), (2, near), (3, far), (4, base), (5, "AC"), (6, None)], "id long, seq string")
    held = sketch.sketches(df, "id", "seq", 23, 400, bases=True)
    d = {r.id: (r.parent, r.dist) for r in neighbours.nearest_earlier(held, "id", 23, 400).collect()}
    assert d[2][0] == 1 and d[2][1] < 0.002 and d[4] == (1, 0.0) and 3 not in d
    at = {r.id: r for r in sketch.addresses(held, "id", 23, 400).collect()}
    assert at[2].m == 1 and at[4].c == 1 and at[3].u == 3 and at[5].u == 5 and at[4].a == 4 and at[6].u == 6


def test_scores(spark):
    rows = [("1", "1"), ("1,2", "2"), ("0", "0"), ("1", "2"), ("1", "0"), ("0", "3")]
    r = profile.scores(spark.createDataFrame(rows, "truth string, predicted string")).first()
    assert (r.n_true, r.n_false_positive, r.n_false_negative, r.n_both_unknown) == (2, 2, 2, 1) and r.f1 == pytest.approx(0.5)


def test_packing_fills_shards(spark):
    df = spark.range(500).selectExpr("id as index", "(id * 37) % 91 + 1 as size")
    rows = catalog.pack(df, 1000).collect()
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert len(rows) == 500 and max(load.values()) <= 1000 + 91 and len(load) == max(load) + 1
