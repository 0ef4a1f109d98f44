"""Connected components of a bipartite graph of records and the entities they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrove.plans import cut, kept


def min_label_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """The smallest record of each record's component, by minimum-label propagation.

    links: record, entity (any comparable types); two records that share an entity are in one component. Rows with a
    null record or entity tie nothing; a record with no entity shared with another keeps its own label. Each round
    takes the smallest label over the records of every entity, then over the entities of every record, then the
    label of that label (which halves long chains); it ends when no label changes. Labels are written to the
    checkpoint folder each round. Entities of any degree are aggregated on the map side; no pairs are formed.
    Returns record, label: one row per record of links.
    """
    links = kept(links.select("record", "entity").where(F.col("record").isNotNull() & F.col("entity").isNotNull()).distinct())
    shared = links.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity")
    tied = cut(links.join(shared, "entity").select("record", "entity"))
    labels = tied.select("record").distinct().withColumn("label", F.col("record"))
    labels = cut(labels)
    for _ in range(max_rounds):
        low = tied.join(labels, "record").groupBy("entity").agg(F.min("label").alias("low"))
        best = tied.join(low, "entity").groupBy("record").agg(F.min("low").alias("low"))
        jump = labels.select(F.col("record").alias("low"), F.col("label").alias("lower"))
        step = best.join(jump, "low", "left").select("record", F.least("low", "lower").alias("new"))
        after = cut(labels.join(step, "record").select("record", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        moved = after.where("moved").limit(1).count()
        labels = after.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    alone = links.select("record").distinct().join(labels.select("record"), "record", "left_anti")
    return labels.unionByName(alone.withColumn("label", F.col("record")))


#: Pairs that one task holds at a time to contract them.
CHUNK = 500_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of the nodes 0 .. n - 1, for the edges a[i], b[i]."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contracted(size: int):
    """record, label of the records of each chunk of at least size pairs: the smallest record of its component in it."""

    def contract(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def solved(held: list) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            both = pa.concat_arrays([*t.column("src").chunks, *t.column("dst").chunks]).dictionary_encode()
            names = both.dictionary
            order = pc.sort_indices(names).to_numpy()  # strings by their bytes, as Spark does
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            codes = place[both.indices.to_numpy()]
            names = names.take(pa.array(order))
            root = _roots(codes[: t.num_rows], codes[t.num_rows :], len(order))
            return pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["record", "label"])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= size:
                yield solved(held)
                held, n = [], 0
        if held:
            yield solved(held)

    return contract


def pair_components(pairs: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """record, label: the smallest record of the component of each record of the pairs src, dst.

    by: columns that mostly agree within a component, such as a tile; pairs are gathered by them and contracted in
    chunks where they lie. What is left are records with several labels, which tie these labels: where such ties fit one
    chunk they are contracted in it, else by min_label_components. src and dst are not null; a pair may be repeated.
    """
    kind = pairs.schema["src"].dataType
    schema = T.StructType([T.StructField("record", kind), T.StructField("label", kind)])
    local = cut(pairs.repartition(*by).select("src", "dst").mapInArrow(_contracted(chunk), schema))
    least = local.groupBy("record").agg(F.min("label").alias("src"), F.max("label").alias("most")).where("src < most")
    ties = cut(local.join(least.select("record", "src"), "record").where(F.col("label") > F.col("src")).select("src", F.col("label").alias("dst")).distinct())
    n = ties.limit(chunk + 1).count()
    if not n:
        return local.distinct()
    if n <= chunk:
        top = ties.repartition(1).mapInArrow(_contracted(chunk + 1), schema)
    else:
        top = min_label_components(ties.select(F.explode(F.array("src", "dst")).alias("record"), F.struct("src", "dst").alias("entity")))
    top = top.select(F.col("record").alias("label"), F.col("label").alias("last"))
    return local.join(top, "label", "left").groupBy("record").agg(F.min(F.coalesce("last", "label")).alias("label"))
