"""Permutation tests on large graphs: which value a rank gets in a permutation is computed from the rank, so that no
permutation is ever written out or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions import ratio
from cellgrove.plans import kept, ranked

ROUNDS = 6
#: Values that a task handles at once: ranks times permutations.
BLOCK = 1 << 16
#: Spaces whose sums a task holds before it hands them on.
HELD = 32
#: Ranks of one space whose edges go to the same task: edges that share points are counted together.
STRETCH = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dealt(rank: np.ndarray, n: int, perms: np.ndarray, key: int) -> np.ndarray:
    """perms x ranks: where rank (from 0, below n) lies in each permutation of 0..n-1; key selects the family.

    A Feistel network over the square of side ceil(sqrt(n)), for n below 2^62; a place beyond n goes through it again
    until it lies below.
    """
    side, low = np.uint64(max(1, int(np.ceil(np.sqrt(n))))), np.uint64(32)
    keys = _mixed(_mixed(perms.astype(np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))[:, None] + np.arange(ROUNDS, dtype=np.uint64)[None, :])

    def once(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        a = at // side
        b = at - a * side
        for r in range(ROUNDS):
            c = a + (((_mixed(b + of[..., r]) >> low) * side) >> low)
            a, b = b, np.where(c >= side, c - side, c)
        return a * side + b

    at = once(np.broadcast_to(rank.astype(np.uint64), (len(perms), len(rank))), keys[:, None, :])
    row, col = np.nonzero(at >= n)
    while len(row):
        at[row, col] = once(at[row, col], keys[row])
        still = at[row, col] >= n
        row, col = row[still], col[still]
    return at.astype(np.int64)


def _counts(n_perms: int, key: int):
    """For mapInPandas over edges: space, perm, a, b (numbers of labels), n, several rows for the same to be added up.
    perm -1 is the given labeling."""

    def rows(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        while sums:
            space, s = sums.popitem()
            kinds = int(round(s.shape[1] ** 0.5))
            perm, code = np.nonzero(s)
            yield pd.DataFrame({"space": space, "perm": perm - 1, "a": code // kinds, "b": code % kinds, "n": s[perm, code]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for space, g in batch.groupby("space", sort=False):
                upto = np.asarray(g["upto"].iloc[0], dtype=np.int64)  # the same in all rows of the space
                kinds, n = len(upto), int(upto[-1])
                own = int(g["key"].iloc[0])
                ranks, where = np.unique(np.concatenate([g["ks"].to_numpy(), g["kd"].to_numpy()]), return_inverse=True)
                src, dst = where[: len(g)], where[len(g) :]
                if space not in sums:
                    sums[space] = np.zeros((n_perms + 1, kinds * kinds), dtype=np.int64)
                step = max(1, BLOCK // max(len(ranks), len(g)))
                for p in range(-1, n_perms, step):
                    block = np.arange(max(p, 0), min(p + step, n_perms))
                    place = dealt(ranks, n, block, key ^ own)
                    if p < 0:
                        place = np.vstack([ranks[None, :], place])
                    label = np.searchsorted(upto, place, side="right").astype(np.int32)
                    code = label[:, src] * kinds + label[:, dst] + (np.arange(len(label)) * kinds * kinds)[:, None]
                    n_of = np.bincount(code.ravel(), minlength=len(label) * kinds * kinds).reshape(len(label), -1)
                    sums[space][p + 1 : p + 1 + len(label)] += n_of
            if len(sums) > HELD:
                yield from rows(sums)
        yield from rows(sums)

    return run


def space_enrichment(edges: DataFrame, labels: DataFrame, n_perms: int, seed: int = 0) -> DataFrame:
    """space, a, b, n, expected, sd, z, p: edges per ordered pair of labels against permutations of the labels
    among the points of each space (population sd). p is (1 + permutations with at least as many) / (n_perms + 1).

    edges: space, src < dst, each counted in both directions; labels: id, space, value. Points are ranked by label, then id, within
    their space, so that a rank's label is read off the labels' running counts, and a permutation is a function of the
    rank. Edges are shuffled to learn the ranks of their ends and once more to lie with edges of the same
    points; all permutations are counted there.
    Points without an id, space or label take part in nothing, nor do their edges. Pairs of labels that a space
    lacks have no row; z is null where sd is 0.
    """
    labels = kept(labels.where("id is not null and space is not null and value is not null").select("id", "space", "value"))
    n = labels.groupBy("space", "value").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("upto", F.sum("n").over(Window.partitionBy("space").orderBy("value"))).withColumn("no", F.row_number().over(Window.partitionBy("space").orderBy("value")) - 1)  # a few labels a space
    n = kept(n)
    bounds = n.groupBy("space").agg(F.sort_array(F.collect_list("upto")).alias("upto")).withColumn("key", F.xxhash64("space"))
    rank = kept(ranked(labels, ["space"], ["value", "id"], "k").select("space", "id", (F.col("k") - 1).alias("k")))
    ends = edges.select("space", "src", "dst").join(rank.select("space", F.col("id").alias("src"), F.col("k").alias("ks")), ["space", "src"])
    ends = ends.join(rank.select("space", F.col("id").alias("dst"), F.col("k").alias("kd")), ["space", "dst"]).select("space", "ks", "kd")
    rows = ends.join(bounds, "space").select(F.col("space").cast("string").alias("space"), "ks", "kd", "upto", "key")
    # few bytes, but much work: the number of tasks must not follow the bytes
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, "space", F.floor(F.col("kd") / STRETCH)).sortWithinPartitions("space", "kd")
    c = rows.mapInPandas(_counts(n_perms, seed), "space string, perm int, a int, b int, n bigint")
    c = c.select("space", "perm", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "n").select("space", "perm", "e.a", "e.b", "n")
    c = kept(c.groupBy("space", "perm", "a", "b").agg(F.sum("n").alias("n")))
    name = lambda side: n.select(F.col("space").cast("string").alias("space"), F.col("no").alias(side), F.col("value").alias(f"{side}_name"))
    seen = name("a").join(name("b"), "space").join(c.where("perm = -1").select("space", "a", "b", "n"), ["space", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    null = c.where("perm >= 0").withColumnRenamed("n", "m")
    both = seen.join(null, ["space", "a", "b"], "left").groupBy("space", "a_name", "b_name", "n")
    out = both.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("m").cast("double") * F.col("m")), F.lit(0.0)).alias("ss"), F.coalesce(F.sum((F.col("m") >= F.col("n")).cast("bigint")), F.lit(0)).alias("ge"))
    ge = F.when(F.col("n") == 0, F.lit(n_perms)).otherwise(F.col("ge"))  # permutations without such an edge have no row
    mean = F.col("s") / F.lit(float(n_perms))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.lit(float(n_perms)) - mean * mean))
    return out.select("space", F.col("a_name").alias("a"), F.col("b_name").alias("b"), "n", mean.alias("expected"), sd.alias("sd"), ratio(F.col("n") - mean, sd).alias("z"), ((1 + ge) / F.lit(float(n_perms + 1))).alias("p"))
