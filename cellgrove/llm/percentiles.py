"""Percentiles of very large columns from counts of values, which can be added up over partitions and days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.plans import running_total


def value_counts(rows: DataFrame, groups: list[str], value: str, digits: int | None = None, relative: float | None = None) -> DataFrame:
    """The summary: groups, value, n. Summaries of parts of the data add up to that of the whole (merge_counts).

    Values that are null or not a number are left out; a null group is a group. Copies and ties just raise n.
    By default values are kept as they are, and percentiles are exact. digits rounds them; relative puts them on a
    geometric grid, by which a percentile is off by at most that share of its value, and the summary's size is bounded
    by the range of the values however many rows there are (values within 1e-12 of 0 become 0).
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v))
    if digits is not None:
        v = F.round(v, digits)
    if relative is not None:
        step = F.lit(2 * relative)
        v = F.when(F.abs(v) <= 1e-12, F.lit(0.0)).otherwise(F.signum(v) * F.exp(F.round(F.log(F.abs(v)) / F.log1p(step)) * F.log1p(step)))
    return rows.groupBy(*groups, (v + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(summaries: list[DataFrame], groups: list[str]) -> DataFrame:
    """Adds up summaries of separate partitions or days."""
    return reduce(DataFrame.unionByName, summaries).groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """One row per group: n_values, and for each name in shares the first value whose cumulative count reaches
    the target rank ceil(share * n). An empty summary gives no rows.

    Counts are range-sorted by group and value; running sums inside each range plus the offset of the ranges before
    it give cumulative counts, so a group that holds most of the rows is still spread over many tasks. The summary is
    computed once.
    """
    cum = running_total(counts, groups, ["value"], "n", "upto")  # written once: totals and picks read it, not counts
    totals = cum.groupBy(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)]).agg(F.max("upto").alias("n_values"))
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]) if groups else F.lit(True)
    both = cum.join(totals, on).select(*groups, "value", "upto", "n_values")
    reach = lambda share: F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * F.col("n_values")))
    picks = [F.min(F.when(F.col("upto") >= reach(s), F.col("value"))).alias(name) for name, s in shares.items()]
    return both.groupBy(*groups).agg(F.max("n_values").alias("n_values"), *picks)


