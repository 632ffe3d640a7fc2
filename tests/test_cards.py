import json

import numpy as np
import pytest

from lineagelake.config import LEVELS
from lineagelake.operators import cards, mixture


def test_search_as_json(spark):
    at = [(1, (1, 1, 1)), (2, (1, 1, 2)), (3, (1, 3, 3)), (4, (4, 4, 4))]
    addressed = spark.createDataFrame([(k, *top, *[k] * 6) for k, top in at], "key long, " + ", ".join(f"{x} long" for x in LEVELS))
    names = spark.createDataFrame([(1, "one", "A1"), (3, "three", None), (4, "four", "A4")], "key long, organism_name string, assembly_accession string")
    labels = spark.createDataFrame([(1, "g", "a"), (2, "g", "b"), (3, "h", None), (4, "h", "d")], "key long, genus string, species string")
    found = spark.createDataFrame([(7, 2, 0.03), (7, 3, 0.08), (8, 4, 0.0)], "query long, key long, dist double")
    groups = cards.groups(found, addressed, names, labels, ("genus", "species"))
    queries = spark.createDataFrame([(7,), (8,), (9,)], "query long")
    got = {r.query: json.loads(r.json) for r in cards.as_json(queries, groups, cards.matches(found, addressed, names)).collect()}
    assert got[9] == {"groups": [], "matches": []}
    assert [m["record"].split(".")[-1] for m in got[7]["matches"]] == ["a2", "a3"] and got[7]["matches"][0]["similarity"] == pytest.approx(0.97)
    assert [g["group"] for g in got[7]["groups"]] == ["u1.s1", "u1"]
    u = got[7]["groups"][1]
    assert u["n_member"] == 3 and u["representative"] == {"assembly_accession": "A1", "organism_name": "one"} and list(u) == sorted(u)
    assert u["taxonomy"] == [{"freq": [{"count": 2, "taxon": "g"}, {"count": 1, "taxon": "h"}], "rank": "genus"}, {"freq": [{"count": 1, "taxon": x} for x in ("-", "a", "b")], "rank": "species"}]
    assert len(got[8]["groups"]) == 8 and got[8]["groups"][0]["group"].count(".") == 7


def test_replicates_match_single_ones(spark):
    """Each replicate's shares are those of the mixture over its drawn reads."""
    rng = np.random.default_rng(2)
    rows = [(r, t, float(q), 1.0 + r % 3) for r in range(120) for t, q in {(int(rng.integers(4)), 1.0), (int(rng.integers(4)), 0.3)}]
    q = spark.createDataFrame(rows, "read_id long, tax_id long, q double, w double").groupBy("read_id", "tax_id").agg({"q": "max", "w": "max"}).toDF("read_id", "tax_id", "q", "w")
    times = {r.read_id: r.times for r in mixture.resampled(q, 8, 5).collect()}
    assert len(times) == 120 and all(sum(t[b] for t in times.values()) == 120 for b in range(8))
    held = {}
    for r in q.collect():
        held.setdefault(r.read_id, []).append((r.tax_id, r.q, r.w))
    shares = []
    for b in range(-1, 8):
        x = np.full(4, 0.25)
        for _ in range(60):
            new = np.zeros(4)
            for r, hits in held.items():
                w = hits[0][2] * (1.0 if b < 0 else times[r][b])
                d = sum(v * x[t] for t, v, _ in hits)
                for t, v, _ in hits:
                    new[t] += w * v * x[t] / d
            x = new / new.sum()
        shares.append(x)
    got = mixture.replicated(q, 8, 5, iterations=60, tolerance=0.0)
    low, high = np.quantile(np.array(shares[1:]), [0.025, 0.975], axis=0)
    for t, (x, a, b) in got.items():
        assert x == pytest.approx(shares[0][t]) and a == pytest.approx(low[t]) and b == pytest.approx(high[t])
    assert mixture.replicated(q.limit(0), 3) == {}
