"""Items that appear together: exact pair counts and lift over any number of baskets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.plans import kept

#: An item in more than this share of its group's baskets is frequent: its bitmap is then smaller than its list.
DENSE_SHARE = 1 / 32
#: Rows in one block of baskets (a bit-matrix and the lists that probe it), and rare items of one basket in one block of
#: its pairs. A basket with more rare items than a block has rows is probed by a join instead.
BLOCK_ROWS = 262_144
BLOCK_ITEMS = 256


def _block_counts(basket: list[str]):
    """Counts, in one block of baskets, frequent-frequent pairs by bitmaps and frequent-rare pairs by probing lists."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf.groupby(basket, sort=False).ngroup().to_numpy()
        codes, names = pd.factorize(pdf["item"], sort=True)
        frequent = pdf["frequent"].to_numpy()
        heavy = np.unique(codes[frequent])
        row = np.full(len(names), -1)
        row[heavy] = np.arange(len(heavy))
        bits = np.zeros((len(heavy), -(-(at.max() + 1) // 64) * 64), dtype=bool)
        bits[row[codes[frequent]], at[frequent]] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        a, b, n = [], [], []

        def add(i, others, counts):
            some = counts > 0
            a.append(np.full(some.sum(), i))
            b.append(others[some])
            n.append(counts[some])

        for i in range(len(heavy) - 1):
            add(heavy[i], heavy[i + 1 :], np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64))
        if len(heavy) and not frequent.all():
            order = np.argsort(codes[~frequent], kind="stable")
            rare, where = codes[~frequent][order], at[~frequent][order]
            starts = np.flatnonzero(np.r_[True, rare[1:] != rare[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(rare)], strict=True):
                add(rare[s], heavy, bits[:, where[s:e]].sum(axis=1, dtype=np.int64))
        a, b, n = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b, n))
        names = np.asarray(names, dtype=object)
        return pd.DataFrame({"grp": key[0], "item_a": names[np.minimum(a, b).astype(int)], "item_b": names[np.maximum(a, b).astype(int)], "n": n.astype(np.int64)})

    return count


def item_pairs(rows: DataFrame, basket: list[str], min_count: int = 1, min_lift: float | None = None, dense_share: float = DENSE_SHARE, block_rows: int = BLOCK_ROWS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Counts, within each group, the baskets that hold both items of each pair, with the lift over chance.

    rows: grp, the basket columns, item STRING; other columns are ignored. Returns grp, item_a < item_b, n_ab, n_a,
    n_b, n_baskets, lift = n_ab * n_baskets / (n_a * n_b), for pairs with n_ab >= min_count and, if given,
    lift >= min_lift. Repeated rows count once. Rows with a null group, item or basket column belong to no basket.
    No rows give no pairs; ties need no order, as every pair that qualifies is returned.

    Frequent items (by dense_share of the group's baskets; at most 1 / dense_share times the mean basket's size of
    them) are counted from a bit-matrix per block of baskets, rare items probe it with their lists, and pairs of rare
    items are hashed and counted; the three are added up. Items that cannot reach min_count or min_lift with any
    other are left out beforehand: n_ab is at most the smaller of n_a and n_b. Blocks hold about block_rows rows,
    however many baskets that is; the rare items of a basket that alone has more are joined to its frequent ones.
    Pairs of rare items of one basket are formed block_items by block_items. So no basket is ever held whole.
    """
    inc = rows.select("grp", *basket, "item").where(F.col("grp").isNotNull() & F.col("item").isNotNull())
    for c in basket:
        inc = inc.where(F.col(c).isNotNull())
    inc = kept(inc.distinct())
    total = inc.select("grp", *basket).distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n_baskets"))
    items = inc.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n_item")).join(total, "grp")
    able = items.where(F.col("n_item") >= min_count)
    if min_lift is not None:
        able = able.where(F.col("n_item") * F.lit(float(min_lift)) <= F.col("n_baskets"))
    able = able.withColumn("frequent", F.col("n_item") > F.col("n_baskets") * F.lit(dense_share))
    able = kept(able)
    marked = kept(inc.join(able.select("grp", "item", "frequent"), ["grp", "item"]))

    rare = marked.where(~F.col("frequent")).select("grp", *basket, "item")
    count = rare.groupBy("grp", *basket).agg(F.count(F.lit(1)).alias("n_rare")).where(F.col("n_rare") > min(block_items, block_rows))
    count = kept(count)  # baskets with very many rare items only
    wide = count.where(F.col("n_rare") > block_rows).select("grp", *basket, F.lit(True).alias("wide"))
    placed = marked.join(wide, ["grp", *basket], "left").where(F.col("wide").isNull() | F.col("frequent"))
    size_of = able.groupBy("grp").agg(F.ceil(F.sum("n_item") / block_rows).alias("blocks"))
    placed = placed.join(size_of, "grp").withColumn("block", F.pmod(F.xxhash64(*basket), F.col("blocks"))).select("grp", "block", *basket, "item", "frequent")
    dense = placed.groupBy("grp", "block").applyInPandas(_block_counts(basket), "grp string, item_a string, item_b string, n bigint")
    often = marked.where("frequent").join(wide, ["grp", *basket], "left_semi").select("grp", *basket, F.col("item").alias("other"))
    mixed = rare.join(wide, ["grp", *basket], "left_semi").join(often, ["grp", *basket])
    mixed = mixed.groupBy("grp", F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).agg(F.count(F.lit(1)).alias("n"))

    size = count.where(F.col("n_rare") > block_items).select("grp", *basket, F.ceil(F.col("n_rare") / block_items).cast("int").alias("chunks"))
    rare = rare.join(size, ["grp", *basket], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
    left = rare.select("grp", *basket, F.col("item").alias("item_a"), F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    right = rare.select("grp", *basket, F.col("item").alias("item_b"), F.col("chunk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"))
    hashed = left.join(right, ["grp", *basket, "i", "j"]).where("item_a < item_b").groupBy("grp", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))

    pairs = dense.unionByName(mixed).unionByName(hashed).groupBy("grp", "item_a", "item_b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    one = able.select("grp", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n_baskets")
    two = able.select("grp", F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    out = pairs.join(one, ["grp", "item_a"]).join(two, ["grp", "item_b"])
    if min_lift is not None:
        out = out.where(F.col("n_ab") * F.col("n_baskets") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("grp", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", lift.alias("lift"))
