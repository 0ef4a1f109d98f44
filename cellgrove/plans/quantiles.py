"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.plans.running import running_total


def quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """by and one column per name in shares: the quantile with linear interpolation between neighbouring values.

    Spark's own median and percentile keep all different values of a group in one task; here values are counted,
    range-sorted and summed up (running_total), so a hot group spreads over many. Null and NaN are left out; groups
    without any other value have no row.
    """
    v = F.col(column).cast("double")
    n = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(n, by, ["_x"], "_n", "_upto")
    total = upto.groupBy(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]).agg(F.max("_upto").alias("_t"))
    if by:
        on = None
        for i, b in enumerate(by):
            c = F.col(b).eqNullSafe(F.col(f"_k{i}"))
            on = c if on is None else on & c
        both = upto.join(total, on)
    else:
        both = upto.join(F.broadcast(total))  # one row
    picks, out = [], []
    for name, p in shares.items():
        h = F.lit(float(p)) * (F.col("_t") - 1)
        picks += [F.min(F.when(F.col("_upto") >= F.floor(h) + 1, F.col("_x"))).alias(f"_a_{name}"), F.min(F.when(F.col("_upto") >= F.ceil(h) + 1, F.col("_x"))).alias(f"_b_{name}"), F.max(h - F.floor(h)).alias(f"_f_{name}")]
        out.append((F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * F.col(f"_f_{name}")).alias(name))
    found = both.groupBy(*by).agg(*picks).select(*by, *out)
    return found if by else found.where(F.col(next(iter(shares))).isNotNull())
