"""Running totals over groups of any size: no group is ever brought into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrove.plans.lineage import cut


def _sums_in_range(keys: list[str]):
    """Running sums of _v within each key over the sorted rows of one partition, batch by batch."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        last, carry = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in keys:
                c = b.column(k)
                here, before = c.slice(1), c.slice(0, n - 1)
                other = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
                new[1:] |= other.to_numpy(zero_copy_only=False)
            v = b.column("_v").to_numpy(zero_copy_only=False)
            total = np.cumsum(v)
            starts = np.flatnonzero(new)
            base = np.r_[np.zeros(1, dtype=v.dtype), total[starts] - v[starts]][np.cumsum(new)]
            inner = total - base
            first = [b.column(k)[0].as_py() for k in keys]
            if last is not None and first == last:
                inner[: starts[0] if len(starts) else n] += carry
            last, carry = [b.column(k)[n - 1].as_py() for k in keys], inner[-1]
            names = [c for c in b.schema.names if c != "_v"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(inner)], names=[*names, "_inner"])

    return add


def running_total(df: DataFrame, keys: list[str], order: list[Column | str], value: str, into: str = "running", parts: int | None = None) -> DataFrame:
    """Adds, within each combination of keys, the sum of value over this row and all before it in the order.

    Rows are range-partitioned by keys and order, so a hot key spreads over many partitions. Each partition sums its
    own sorted rows where they lie; a key that goes on from one range into the next then gets the sum of the ranges
    before as an offset. Between two neighbouring ranges at most one key goes on, so there are fewer offsets than
    partitions, and they are broadcast: the rows are shuffled once.
    The order has to be total within the keys, otherwise tied rows get their totals in any order.
    A null value counts as 0; a null key is a key of its own. An empty table gives an empty table.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    by = [*[F.col(k) for k in keys], *order]
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    v = F.coalesce(F.col(value), F.lit(0)).cast("bigint" if whole else "double")
    placed = df.withColumn("_v", v).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([f for f in placed.schema if f.name != "_v"] + [T.StructField("_inner", T.LongType() if whole else T.DoubleType())])
    summed = cut(placed.mapInArrow(_sums_in_range(keys), schema))  # the place of each row has to be the same for the offsets and for the sums
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summed.groupBy(*keys, "_part").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_sum"))
    offsets = offsets.withColumn("_before", F.sum("_sum").over(before)).where("_before is not null")
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before")
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = summed.join(F.broadcast(offsets), on, "left").select(*df.columns, "_inner", "_before")
    return joined.withColumn(into, F.col("_inner") + F.coalesce("_before", F.lit(0))).drop("_inner", "_before")


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], into: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the position of each row within its keys, from 1, by running_total over ones."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", into, parts).drop("_one")
