"""Statistics of evaluation tables, as columns or aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_sd(value: Column) -> Column:
    """Aggregate: sample deviation, 0 for one value, null for none."""
    return F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))


def known_mean(value: Column) -> Column:
    """Aggregate: the mean of what is neither null nor NaN."""
    return F.avg(F.when(~F.isnan(value), value))


def upper_median(value: Column) -> Column:
    """Aggregate: the upper of two middle values; for groups that fit a task."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def geometric_mean(value: Column, floor: float = 1e-4) -> Column:
    """Aggregate: of values that are neither null nor NaN, raised to a floor."""
    return F.exp(F.avg(F.when(~F.isnan(value), F.ln(F.greatest(value, F.lit(floor))))))


def sign_test(k: Column, n: Column) -> Column:
    """Exact two-sided sign test: twice the smaller tail, at most 1; NaN for no pairs.

    The terms are kept as logarithms, each made from the one before, as factorials overflow past 20.
    """
    half = n * F.ln(F.lit(2.0))

    def tail(upto: Column) -> Column:
        def step(s, i):
            term = s["term"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double"))
            return F.struct(term.alias("term"), (s["total"] + F.exp(term - half)).alias("total"))

        steps = F.when(upto > 0, F.sequence(F.lit(1), upto.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.struct(F.lit(0.0).alias("term"), F.exp(-half).alias("total")), step, lambda s: s["total"])

    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.least(tail(k), tail(n - k)))).otherwise(F.lit(float("nan")))


def auc(positives: Column, negatives: Column, rank_sum: Column) -> Column:
    """From the rank sum of the positives (mean ranks on ties)."""
    return F.when((positives > 0) & (negatives > 0), (rank_sum - positives * (positives + 1) / 2) / F.nullif((positives * negatives).cast("double"), F.lit(0.0)))


def auc_interval(area: Column, positives: Column, negatives: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Hanley and McNeil's standard error and interval."""
    q1 = area / (2 - area)
    q2 = 2 * area * area / (1 + area)
    variance = (area * (1 - area) + (positives - 1) * (q1 - area * area) + (negatives - 1) * (q2 - area * area)) / (positives * negatives)
    error = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return error, area - z * error, area + z * error
