"""Writers of the engine's outputs: reproducible bytes where they are compared, appends where they stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_routes(routes: DataFrame, path: str, *keys: str) -> None:
    """JSON by environment (target, policy, seed, radius, ranker): runs do not overwrite each other."""
    routes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """The final table, tab-separated, in order of policy, seed and target; null is empty, NaN is ``nan``."""
    text = [F.when(F.isnan(f.name), "nan").otherwise(F.col(f.name).cast("string")).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in runs.schema.fields]
    ordered = runs.orderBy("policy", "seed", "target").select(*text)
    ordered.write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Partial results: each call adds files, which readers take together."""
    runs.write.mode("append").option("header", True).option("sep", "\t").csv(path)


def write_corpus(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a total order, so that equal tables give equal bytes; one sorted range per file."""
    rows.orderBy(*order).write.mode("overwrite").option("lineSep", "\n").json(path)


def write_names(names: DataFrame, path: str) -> None:
    """The cache of looked-up names, misses included, in order; one sorted range per file."""
    names.orderBy("smiles").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def merge_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(smiles, label, source): a found name replaces a miss, else the older entry stays."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    rank = F.struct((F.col("source") == "unresolved").alias("miss"), "age")
    return both.groupBy("smiles").agg(F.min_by(F.struct("label", "source"), rank).alias("x")).select("smiles", "x.label", "x.source")
