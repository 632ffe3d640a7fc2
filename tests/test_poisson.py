import math

from pyspark.sql import functions as F

from lineagelake.functions.poisson import band_ratio_of, log_factorial


def test_log_factorials_are_exact(spark):
    rows = spark.range(400).select("id", log_factorial(F.col("id")).alias("v")).collect()
    for n, v in rows:
        exact = math.log(math.factorial(n))
        assert v == exact if n < 256 else abs(v - exact) < 1e-12 * exact


def test_weights_on_half_a_unit(spark):
    # Mean 1/2 and two hits in a bin: the mass over the edge's is sqrt(1/2) / 2 exactly.
    w = spark.range(1).select(F.exp(2 * band_ratio_of(F.lit(2), F.lit(0.5))).alias("w")).first().w
    assert abs(w - 0.125) < 1e-15
