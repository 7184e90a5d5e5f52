"""The scalar functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body of each function.
FUNCTIONS = [
    ("ec_level", "ec STRING, level INT", "STRING", "CASE WHEN level BETWEEN 1 AND 4 AND size(slice(split(ec, '[.]'), 1, greatest(level, 1))) = level AND NOT array_contains(slice(split(ec, '[.]'), 1, greatest(level, 1)), '-') THEN array_join(slice(split(ec, '[.]'), 1, greatest(level, 1)), '.') ELSE '' END"),
    ("strip_split", "id STRING", "STRING", r"regexp_replace(id, '__split\\d+$', '')"),
    ("jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE cast(size(array_intersect(a, b)) AS DOUBLE) / size(array_union(a, b)) END"),
    ("binary_tanimoto", "a ARRAY<INT>, b ARRAY<INT>", "DOUBLE", "CASE WHEN coalesce(size(array_union(a, b)), 0) > 0 THEN cast(size(array_intersect(a, b)) AS DOUBLE) / size(array_union(a, b)) ELSE 0.0D END"),
    ("first_block", "id STRING", "STRING", "CASE WHEN length(split(id, '-')[0]) = 14 THEN split(id, '-')[0] END"),
    ("looks_unnamed", "name STRING", "BOOLEAN", r"coalesce(name RLIKE '^MNXM\\d+$', false)"),
    ("drop_ec_column", "text STRING", "STRING", r"regexp_replace(text, ' [|] EC=[0-9,]+', '')"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions callable in ``spark.sql``; returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
