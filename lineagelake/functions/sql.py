"""SQL functions: register(spark) makes them known to spark.sql.

barcode_parse(code), barcode_prefix(code, level), mash_distance(a, b, k, s) and
mash_overlap(a, b, s) are SQL expressions, which the optimiser puts in place of the call;
kmers(text, k) and kmers(text, k, bases) are table functions for a lateral join: h, the hash
of each k-mer with its place i from 0. kmer_extent(text, k) is one too: the number of a
text's different k-mers and their least and largest hash, no row where it has none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lineagelake.config import LEVELS
from lineagelake.operators import sketch

_STRUCT = ", ".join(f"{x}: BIGINT" for x in LEVELS)
_PATTERN = "^" + "[.]".join(f"{x}-?[0-9]+" for x in LEVELS) + "$"
_FIELDS = ", ".join(f"'{x}', CAST(substring(split(code, '[.]')[{i}], 2) AS BIGINT)" for i, x in enumerate(LEVELS))
FUNCTIONS = {
    "barcode_parse(code STRING)": (f"STRUCT<{_STRUCT}>", f"CASE WHEN code RLIKE '{_PATTERN}' THEN named_struct({_FIELDS}) END"),
    "barcode_prefix(code STRING, level STRING)": ("STRING", f"substring_index(code, '.', nullif(array_position(array({', '.join(map(repr, LEVELS))}), level), 0))"),
    "mash_overlap(a ARRAY<BIGINT>, b ARRAY<BIGINT>, s INT)": ("DOUBLE", "size(array_intersect(array_intersect(slice(sort_array(array_union(a, b)), 1, s), a), b)) / greatest(size(slice(sort_array(array_union(a, b)), 1, s)), 1)"),
    "mash_distance(a ARRAY<BIGINT>, b ARRAY<BIGINT>, k INT, s INT)": ("DOUBLE", "CASE WHEN mash_overlap(a, b, s) > 0 THEN greatest(0D, -ln(2 * mash_overlap(a, b, s) / (1 + mash_overlap(a, b, s))) / k) ELSE 1D END"),
}


@udtf(returnType="i: int, h: bigint")
class Kmers:
    def eval(self, text: str, k: int, bases: bool = False):
        yield from enumerate(sketch.kmer_hashes(text or "", k, bases).tolist())


@udtf(returnType="n_different: bigint, least: bigint, largest: bigint")
class KmerExtent:
    def eval(self, text: str, k: int):
        found = np.sort(sketch.kmer_hashes(text or "", k))
        if len(found):
            yield 1 + int(np.count_nonzero(np.diff(found))), int(found[0]), int(found[-1])


def register(spark: SparkSession) -> None:
    """For this session; again is no error."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("kmers", Kmers)
    spark.udtf.register("kmer_extent", KmerExtent)
