"""Sparse cell by gene counts: normalisation, scores, pseudobulk, comparisons of two counts of the same cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions import ratio, t_two_sided, uniform
from cellgrove.operators.stats import benjamini_hochberg
from cellgrove.plans import kept, quantiles


def log_normalised(expr: DataFrame, scale: float | None = 10_000.0) -> DataFrame:
    """Adds lognorm = ln(1 + scale * cnt / total of the cell); scale None: the median total. Totals below 1 count as 1."""
    total = expr.groupBy("cell_id").agg(F.sum("cnt").alias("_t"))
    if scale is None:
        total = kept(total)
        total = total.join(F.broadcast(quantiles(total, [], "_t", {"_s": 0.5})))  # one row
    else:
        total = total.withColumn("_s", F.lit(float(scale)))
    return expr.join(total, "cell_id").withColumn("lognorm", F.log1p(F.col("_s") * F.col("cnt") / F.greatest("_t", F.lit(1.0)))).drop("_t", "_s")


def panel_subset(expr: DataFrame, panel: DataFrame) -> DataFrame:
    """Only the genes of the panel, renamed to the panel's symbols: panel has gene_id, symbol."""
    return expr.join(panel.select(F.col("gene_id").alias("gene"), "symbol"), "gene").select("cell_id", F.col("symbol").alias("gene"), "cnt")


def group_means(expr: DataFrame, groups: DataFrame, value: Column) -> DataFrame:
    """grp, gene, mean over all cells of the group; cells without the gene count as 0. groups: cell_id, grp."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    s = expr.join(groups, "cell_id").groupBy("grp", "gene").agg(F.sum(value).alias("s"))
    return s.join(n, "grp").select("grp", "gene", (F.col("s") / F.col("n")).alias("mean"))


def foreign_genes(lognorm: DataFrame, groups: DataFrame, own: str, fold: float = 4.0, floor: float = 1e-3) -> DataFrame:
    """gene, foreign, fold: genes whose highest mean (of expm1) among other groups is at least fold times the own mean,
    which counts at least floor. Ties go to the smaller group."""
    m = group_means(lognorm, groups, F.expm1("lognorm"))
    other = m.where(F.col("grp") != own).groupBy("gene").agg(F.max(F.struct("mean", "grp")).alias("o"), F.max("mean").alias("top"))
    other = m.where(F.col("grp") != own).join(other.select("gene", "top"), "gene").where("mean = top").groupBy("gene", "top").agg(F.min("grp").alias("foreign"))
    mine = m.where(F.col("grp") == own).select("gene", F.col("mean").alias("own"))
    out = other.join(mine, "gene", "left").withColumn("fold", F.col("top") / F.greatest(F.coalesce("own", F.lit(0.0)), F.lit(floor)))
    return out.where(F.col("fold") >= fold).select("gene", "foreign", "fold")


def gene_set_scores(lognorm: DataFrame, cells: DataFrame, sets: DataFrame, bins: int = 25, controls: int = 5, least: int = 2, seed: int = 0) -> DataFrame:
    """cell_id, name, score: mean of a gene set minus the mean of control genes of similar expression.

    sets: name, gene. Genes not in the data are dropped, and sets of fewer than `least` genes with them. Genes are put
    into bins by their mean; for each set gene, `controls` genes of its bin, outside the set, are drawn by hash.
    cells: all cells, as absent counts are zeros.
    """
    n = cells.count()
    mean = lognorm.groupBy("gene").agg((F.sum("lognorm") / F.lit(float(max(1, n)))).alias("mean"))
    binned = kept(mean.withColumn("bin", F.ntile(bins).over(Window.partitionBy(F.lit(0)).orderBy("mean", "gene"))))  # one row per gene
    own = sets.join(binned, "gene").select("name", "gene", "bin").distinct()
    ok = own.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    own = kept(own.join(ok.select("name"), "name"))
    pool = own.select("name", "bin").distinct().join(binned.select("bin", F.col("gene").alias("g")), "bin")
    pool = pool.join(own.select("name", F.col("gene").alias("g")), ["name", "g"], "left_anti")
    pick = Window.partitionBy("name", "bin").orderBy(uniform(F.lit(seed), "name", "g"), "g")
    wanted = own.groupBy("name", "bin").agg((F.count(F.lit(1)) * controls).alias("want"))
    ctrl = pool.withColumn("rn", F.row_number().over(pick)).join(wanted, ["name", "bin"]).where(F.col("rn") <= F.col("want")).select("name", F.col("g").alias("gene"))

    def mean_of(genes: DataFrame, into: str) -> DataFrame:
        k = genes.groupBy("name").agg(F.count(F.lit(1)).alias("k"))
        return lognorm.join(genes, "gene").groupBy("cell_id", "name").agg(F.sum("lognorm").alias("s")).join(k, "name").select("cell_id", "name", (F.col("s") / F.col("k")).alias(into))

    names = own.select("name").distinct()
    grid = cells.select("cell_id").join(names)  # cells by sets: the result's own size
    out = grid.join(mean_of(own.select("name", "gene"), "a"), ["cell_id", "name"], "left").join(mean_of(ctrl, "b"), ["cell_id", "name"], "left")
    return out.select("cell_id", "name", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("score"))


def group_z(means: DataFrame, group: str, by: str, value: str) -> DataFrame:
    """Adds z: (value - mean over groups) / sample standard deviation over groups, for each `by`; null without spread."""
    w = Window.partitionBy(by)
    return means.withColumn("z", ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))


def pseudobulk(expr: DataFrame, cells: DataFrame, domains: tuple[str, str], least_cells: int = 10, least_blocks: int = 5, least_total: float = 10) -> DataFrame:
    """block, domain, gene, cnt: sums over the cells of each block and domain with at least least_cells cells, for
    blocks that have both domains; genes whose total is below least_total are dropped. Zeros are absent.

    cells: cell_id, block, domain. Fewer than least_blocks such blocks is a ValueError.
    """
    some = cells.where(F.col("domain").isin(*domains))
    big = some.groupBy("block", "domain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_cells)
    both = kept(big.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("block"))
    blocks = both.count()
    if blocks < least_blocks:
        raise ValueError(f"{blocks} blocks with both domains; at least {least_blocks} are needed")
    sums = kept(expr.join(some.join(both, "block", "left_semi"), "cell_id").groupBy("block", "domain", "gene").agg(F.sum("cnt").alias("cnt")))
    total = sums.groupBy("gene").agg(F.sum("cnt").alias("t")).where(F.col("t") >= least_total).select("gene")
    return sums.join(total, "gene", "left_semi")


def paired_change(bulk: DataFrame, domains: tuple[str, str]) -> DataFrame:
    """gene, base_mean, log2fc, t, n, p, q: per block the difference of log2(1 + counts per million) of the two domains,
    the paired t statistic over blocks with its two-sided p, and the false discovery rate over genes. A plain paired
    test, named as such: no count model is fitted."""
    cpm = bulk.withColumn("cpm", 1e6 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy("block", "domain")))
    wide = cpm.groupBy("block", "gene").agg(*[F.coalesce(F.max(F.when(F.col("domain") == d, F.log2(1 + F.col("cpm")))), F.lit(0.0)).alias(c) for d, c in zip(domains, "ab", strict=True)], F.sum("cnt").alias("c"))
    n = bulk.select("block").distinct().count()
    d = F.col("a") - F.col("b")
    g = wide.groupBy("gene").agg(F.sum(d).alias("s"), F.sum(d * d).alias("ss"), (F.sum("c") / (2.0 * n)).alias("base_mean"))
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - n * mean * mean) / (n - 1)))
    return g.select("gene", "base_mean", mean.alias("log2fc"), ratio(mean, sd / F.sqrt(F.lit(float(n)))).alias("t"), F.lit(n).alias("n")).transform(lambda x: benjamini_hochberg(x.withColumn("p", t_two_sided("t", n - 1)), "p"))


def called_genes(first: DataFrame, second: DataFrame, foreign: DataFrame, alpha: float = 0.05) -> DataFrame:
    """gene, call: n.s. (first q null or not below alpha), spillover (a foreign gene), not confirmed (other sign in the
    second count, or its q not below alpha), else intrinsic. first, second: gene, log2fc, q."""
    s = second.select("gene", F.col("log2fc").alias("l2"), F.col("q").alias("q2"))
    out = first.join(s, "gene", "left").join(foreign.select("gene", F.lit(True).alias("foreign_gene")), "gene", "left")
    ok = F.coalesce(F.col("q") < alpha, F.lit(False))
    same = F.coalesce((F.signum("log2fc") == F.signum("l2")) & (F.col("q2") < alpha), F.lit(False))
    return out.select("gene", F.when(~ok, "n.s.").when(F.coalesce("foreign_gene", F.lit(False)), "spillover").when(~same, "not confirmed").otherwise("intrinsic").alias("call"))


def positivity(expr: DataFrame, groups: DataFrame, genes: list[str]) -> DataFrame:
    """grp, gene, pct: percentage of the group's cells with a count above 0; cells without the gene are in it."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    grid = n.withColumn("gene", F.explode(F.array(*[F.lit(g) for g in genes])))
    hit = expr.where(F.col("gene").isin(genes) & (F.col("cnt") > 0)).join(groups, "cell_id").groupBy("grp", "gene").agg(F.countDistinct("cell_id").alias("k"))
    return grid.join(hit, ["grp", "gene"], "left").select("grp", "gene", (100.0 * F.coalesce("k", F.lit(0)) / F.col("n")).alias("pct"))


def above_noise(rates: DataFrame, floor_group: str, fold: float = 3.0, least: float = 5.0) -> DataFrame:
    """gene, groups: groups above fold times the floor group's rate (at least 0.5) and at least `least` percent."""
    floor = rates.where(F.col("grp") == floor_group).select("gene", F.greatest("pct", F.lit(0.5)).alias("floor"))
    rest = rates.where(F.col("grp") != floor_group).join(floor, "gene")
    hit = rest.groupBy("gene").agg(F.array_join(F.array_sort(F.collect_list(F.when((F.col("pct") > fold * F.col("floor")) & (F.col("pct") >= least), F.col("grp")))), ", ").alias("g"))
    return hit.select("gene", F.when(F.col("g") == "", F.lit(f"none above {fold:g}x noise floor")).otherwise(F.col("g")).alias("groups"))


def spillover(first: DataFrame, second: DataFrame, groups: DataFrame, tests: DataFrame) -> DataFrame:
    """grp, foreign, before, after, reduction: percentage of the same cells positive for any gene of a foreign set in
    the first and the second count. groups: cell_id, grp (cells in both); tests: grp, foreign, gene."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))

    def share(expr: DataFrame, into: str) -> DataFrame:
        hit = expr.where("cnt > 0").join(groups, "cell_id").join(tests, ["grp", "gene"]).groupBy("grp", "foreign").agg(F.countDistinct("cell_id").alias("k"))
        return tests.select("grp", "foreign").distinct().join(n, "grp").join(hit, ["grp", "foreign"], "left").select("grp", "foreign", (100.0 * F.coalesce("k", F.lit(0)) / F.col("n")).alias(into))

    out = share(first, "before").join(share(second, "after"), ["grp", "foreign"])
    return out.withColumn("reduction", F.col("before") / F.greatest("after", F.lit(1e-9)))


def allowed_agreement(cells: DataFrame, allowed: DataFrame) -> DataFrame:
    """manual, n, pct, top, top_pct: of each manual label the share whose other label is among those allowed for it,
    and the other label given most often (ties to the smaller). cells: manual, other; allowed: manual, other."""
    ok = allowed.select("manual", "other", F.lit(1).alias("ok")).distinct()
    c = cells.groupBy("manual", "other").agg(F.count(F.lit(1)).alias("n")).join(ok, ["manual", "other"], "left")
    w = Window.partitionBy("manual").orderBy(F.col("n").desc(), F.col("other").asc_nulls_last())
    top = c.withColumn("rn", F.row_number().over(w)).groupBy("manual").agg(F.sum("n").alias("t"), (100.0 * F.sum(F.when(F.col("ok") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("pct"), F.max(F.when(F.col("rn") == 1, F.col("other"))).alias("top"), F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("k"))
    return top.select("manual", F.col("t").alias("n"), "pct", "top", (100.0 * F.col("k") / F.col("t")).alias("top_pct"))


def shares(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """rows, cols, n, pct: a crosstab in long form, percentages within the row."""
    n = df.groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(rows)))


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows per label, by hash of seed and key (key decides ties): the same rows on any partitioning."""
    w = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def held_out_groups(df: DataFrame, group: str, percent: int, seed: int = 0) -> DataFrame:
    """Adds held_out: whether the row's group is among the percent of groups held out by hash."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("held_out", h % 100 < percent)


def palette_groups(df: DataFrame, key: str, label: str, colours: int = 20) -> DataFrame:
    """key, grp, colour: the label and the number of its colour, its rank among sorted labels modulo `colours`."""
    ranks = df.select(label).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)))  # the labels, few
    return df.join(ranks, label).select(key, F.col(label).alias("grp"), ((F.col("_r") - 1) % colours).cast("int").alias("colour"))


def equal_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows per label, as balanced_sample draws them; a label with fewer rows is a ValueError that names it."""
    short = df.groupBy(label).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") < n).orderBy(label).limit(5).collect()
    if short:
        raise ValueError(f"fewer than {n} rows: " + ", ".join(str(r[0]) for r in short))
    return balanced_sample(df, label, key, n, seed)


def grouped_caps(df: DataFrame, group: str, label: str, key: str, percent: int, most_train: int = 5000, most_test: int = 1000, seed: int = 0) -> DataFrame:
    """The rows of a training and a test set: groups held out by hash, and of each label at most so many drawn rows on
    each side. Adds held_out."""
    d = held_out_groups(df, group, percent, seed)
    return balanced_sample(d.where("not held_out"), label, key, most_train, seed).unionByName(balanced_sample(d.where("held_out"), label, key, most_test, seed))


def mixed_spillover(first: DataFrame, second: DataFrame, groups: DataFrame, partners: DataFrame, top: int = 6) -> DataFrame:
    """As spillover, for the `top` largest groups (ties to the smaller name) that have partners (grp, foreign, gene)."""
    large = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "grp").limit(top).select("grp")
    return spillover(first, second, groups.join(large, "grp", "left_semi"), partners.join(large, "grp", "left_semi"))


def renamed_counts(expr: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, cells) of a second segmentation under the ids of the cells it started from: counts (cell_id, gene, cnt)
    and cells (original_id, x, y, area, volume, transcript_counts, 0 without any). cells: cell_id, original_id, x, y,
    area, volume. Cells without an original id are left out."""
    ids = cells.where("original_id is not null")
    counts = expr.join(ids.select("cell_id", "original_id"), "cell_id").select(F.col("original_id").cast("string").alias("cell_id"), "gene", "cnt")
    total = counts.groupBy("cell_id").agg(F.sum("cnt").cast("bigint").alias("transcript_counts"))
    own = ids.select(F.col("original_id").cast("string").alias("cell_id"), "x", "y", "area", "volume")
    return counts, own.join(total, "cell_id", "left").withColumn("transcript_counts", F.coalesce("transcript_counts", F.lit(0)))
