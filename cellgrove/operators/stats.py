"""Permutation tests, multiple testing, agreement of labelings and other statistics as Spark jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions import chi2_tail, normal_tail, ratio
from cellgrove.plans import kept, ranked, running_total


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] | None = None, into: str = "q") -> DataFrame:
    """Adds the step-up false discovery rate within by: min over larger p of p * m / rank, at most 1. Null p gives null.

    The family of tests (a table of results, not of data) is one window; equal p get equal q.
    """
    by = by or []
    base = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    known = df.where(F.col(p).isNotNull())
    m = F.count(F.lit(1)).over(base)
    rank = F.count(F.lit(1)).over(base.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    up = base.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)
    out = known.withColumn("_s", F.col(p) * m / rank).withColumn(into, F.least(F.lit(1.0), F.min("_s").over(up))).drop("_s")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double")))


def shuffled(labels: DataFrame, n_perms: int, seed: str, within: list[str] | None = None) -> DataFrame:
    """perm, id, <within>, value: for every permutation the values dealt anew to the ids, within groups.

    labels: id, value and the columns in within. In permutation p the value that is k-th by md5(seed|p|id) goes to the
    k-th id, so the result depends on neither partitioning nor engine.
    """
    within = within or []
    slots = ranked(labels.select("id", *within), within, ["id"], "k")
    each = labels.select("id", *within, "value").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))))
    each = each.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col("id").cast("string"))))
    dealt = ranked(each, ["perm", *within], ["h", "id"], "k").select("perm", *within, "k", "value")
    return slots.join(dealt, [*within, "k"]).select("perm", "id", *within, "value")


def label_pairs(edges: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts directed edges per pair of labels (a, b), for each value of by (columns of labels such as perm)."""
    by = by or []
    one = labels.select(*by, F.col("id").alias("src"), F.col("value").alias("a"))
    two = labels.select(*by, F.col("id").alias("dst"), F.col("value").alias("b"))
    return edges.select("src", "dst").join(one, "src").join(two, [*by, "dst"]).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def enrichment(edges: DataFrame, labels: DataFrame, n_perms: int, seed: str) -> DataFrame:
    """a, b, n, expected, sd, z: edges per pair of labels against label permutations over all ids (population sd).

    Pairs that no permutation produced count as 0 in it; z is null where sd is 0. edges: src, dst, both directions.
    """
    kinds = labels.select("value").distinct()
    pairs = kinds.select(F.col("value").alias("a")).join(kinds.select(F.col("value").alias("b")))  # label by label: a table of kinds
    null = label_pairs(edges, shuffled(labels, n_perms, seed), ["perm"]).groupBy("a", "b").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    seen = label_pairs(edges, labels)
    out = pairs.join(seen, ["a", "b"], "left").join(null, ["a", "b"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("double") for c in ("n", "s", "ss")})
    mean = F.col("s") / n_perms
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / n_perms - mean * mean))
    return out.select("a", "b", F.col("n").cast("bigint").alias("n"), mean.alias("expected"), sd.alias("sd"), ratio(F.col("n") - mean, sd).alias("z"))


def contact_test(edges: DataFrame, cells: DataFrame, positive: DataFrame, pairs: DataFrame, n_perms: int, seed: str) -> DataFrame:
    """Contacts of ligand+ senders and receptor+ receivers against shuffles within cell types.

    edges: src, dst, both directions. cells: id, cell_type, lineage. positive: id, gene (cells positive for it).
    pairs: pair, ligand, receptor, send, receive (lineages). A cell is a sender if it is positive and of the sending
    lineage; both masks are shuffled within cell type, independently. Returns pair, senders, receivers, observed,
    expected, obs_exp, z, p = (1 + shuffles with at least as many) / (n_perms + 1), q.
    """
    side = lambda gene, lin: pairs.select("pair", F.col(gene).alias("gene"), F.col(lin).alias("lineage"))
    pos = positive.select("id", "gene", F.lit(1).alias("hit"))

    def mask(gene: str, lin: str, col: str) -> DataFrame:
        m = cells.join(side(gene, lin).withColumnRenamed("lineage", "want")).join(pos, ["id", "gene"], "left")  # pairs: a short list
        return m.select("pair", "id", "cell_type", ((F.col("lineage") == F.col("want")) & F.col("hit").isNotNull()).cast("int").alias(col))

    left, right = kept(mask("ligand", "send", "value")), kept(mask("receptor", "receive", "value"))

    def count(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        a = a.where("value = 1").select(*by, F.col("id").alias("src"))
        b = b.where("value = 1").select(*by, F.col("id").alias("dst"))
        return edges.select("src", "dst").join(a, "src").join(b, [*by, "dst"]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))

    null = count(shuffled(left, n_perms, seed + "L", ["pair", "cell_type"]), shuffled(right, n_perms, seed + "R", ["pair", "cell_type"]), ["pair", "perm"])
    seen = pairs.select("pair").join(count(left, right, ["pair"]), "pair", "left").select("pair", F.coalesce("n", F.lit(0)).alias("observed"))
    n = F.coalesce("n", F.lit(0)).cast("double")
    grid = seen.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1)))).join(null, ["pair", "perm"], "left")
    stat = grid.groupBy("pair", "observed").agg(F.avg(n).alias("expected"), F.sqrt(F.greatest(F.lit(0.0), F.avg(n * n) - F.avg(n) * F.avg(n))).alias("sd"), F.sum((n >= F.col("observed")).cast("int")).alias("ge"))
    sizes = left.groupBy("pair").agg(F.sum("value").alias("senders")).join(right.groupBy("pair").agg(F.sum("value").alias("receivers")), "pair")
    floor = F.lit(1e-9)
    out = stat.join(sizes, "pair").select("pair", "senders", "receivers", "observed", "expected", (F.col("observed") / F.greatest("expected", floor)).alias("obs_exp"), ((F.col("observed") - F.col("expected")) / F.greatest("sd", floor)).alias("z"), ((1 + F.col("ge")) / (n_perms + 1)).alias("p"))
    return benjamini_hochberg(out, "p")


def interaction_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, n, share: edges from label a to label b and their share of a's edges."""
    n = label_pairs(edges, labels)
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


def morans_i(values: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """gene, moran, z, p, q: N / W * sum w z_i z_j / sum z^2 with weights that add up to 1 over each cell's neighbours.

    values: id, gene, value with zeros absent; edges: src, dst both ways; cells: id. Cells without neighbours have no
    weights. The zeros are never written out: z is split into value and mean, and sums over present values, edges and
    weights give the rest. Null where a gene does not vary. z and p compare with the expectation -1 / (N - 1) under
    normality, p one-sided on the side of z, q is its false discovery rate over the genes.
    """
    n = cells.agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = kept(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")), "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")))
    total = w.agg(F.sum("w").alias("sw"))
    weight_in = w.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("win"))
    weight_out = w.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("wout"))
    v = values.where("value <> 0").select("id", "gene", F.col("value").cast("double").alias("value"))
    stat = v.join(weight_in, "id", "left").join(weight_out, "id", "left").groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.sum(F.col("value") * (F.coalesce("win", F.lit(0.0)) + F.coalesce("wout", F.lit(0.0)))).alias("ws"))
    cross = v.select(F.col("id").alias("src"), "gene", F.col("value").alias("vi")).join(w, "src").join(v.select(F.col("id").alias("dst"), "gene", F.col("value").alias("vj")), ["dst", "gene"]).groupBy("gene").agg(F.sum(F.col("w") * F.col("vi") * F.col("vj")).alias("c"))
    out = stat.join(cross, "gene", "left").join(n).join(total)  # one row each
    m = F.col("s") / F.col("n")
    top = F.coalesce("c", F.lit(0.0)) - m * F.col("ws") + m * m * F.col("sw")
    both = w.join(w.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("back")), ["src", "dst"], "full")
    s1 = both.agg((F.sum(F.pow(F.coalesce("w", F.lit(0.0)) + F.coalesce("back", F.lit(0.0)), 2)) / 2).alias("s1"))
    ends = weight_in.join(weight_out, "id", "full")
    s2 = ends.agg(F.sum(F.pow(F.coalesce("win", F.lit(0.0)) + F.coalesce("wout", F.lit(0.0)), 2)).alias("s2"))
    out = out.withColumn("moran", ratio(F.col("n") * top, F.col("sw") * (F.col("ss") - F.col("n") * m * m))).select("gene", "moran", "n", "sw").join(s1).join(s2)  # one row each
    n_, mean = F.col("n"), -1 / (F.col("n") - 1)
    var = (n_ * n_ * F.col("s1") - n_ * F.col("s2") + 3 * F.col("sw") * F.col("sw")) / ((n_ * n_ - 1) * F.col("sw") * F.col("sw")) - mean * mean
    out = out.withColumn("z", ratio(F.col("moran") - mean, F.sqrt(F.greatest(var, F.lit(0.0)))))
    return benjamini_hochberg(out.select("gene", "moran", "z", normal_tail(F.abs("z")).alias("p")), "p")


def at_distance(bands: DataFrame, edges_um: list[float], wanted: list[float], by: list[str] | None = None) -> DataFrame:
    """by, a, b, wanted, upto, ratio: of each pair of labels the band whose far edge is nearest to each wanted distance; ties
    go to the nearer band."""
    by = by or []
    far = F.element_at(F.array(*[F.lit(float(x)) for x in edges_um[1:]]), F.col("band") + 1)
    d = bands.withColumn("upto", far).withColumn("wanted", F.explode(F.array(*[F.lit(float(x)) for x in wanted])))
    near = F.min_by(F.struct("upto", "ratio"), F.struct(F.abs(F.col("upto") - F.col("wanted")), F.col("upto")))
    return d.groupBy(*by, "a", "b", "wanted").agg(near.alias("m")).select(*by, "a", "b", "wanted", "m.upto", "m.ratio")


def co_occurrence(pairs: DataFrame, edges_um: list[float]) -> DataFrame:
    """band, a, b, ratio: p(b | a, distance band) / p(b | band) over ordered pairs of different points.

    pairs: a, b (labels), dist. Bands are (edge k, edge k+1]; a pair at distance 0 is in none.
    """
    band = reduce(lambda acc, k: acc.when((F.col("dist") > edges_um[k]) & (F.col("dist") <= edges_um[k + 1]), k), range(1, len(edges_um) - 1), F.when((F.col("dist") > edges_um[0]) & (F.col("dist") <= edges_um[1]), 0))
    return band_ratios(pairs.select("a", "b", band.alias("band")).where("band is not null").groupBy("band", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def band_ratios(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, band, a, b, n, ratio: the ratio of co_occurrence from the counts of ordered pairs (by, band, a, b, n)."""
    by = by or []
    n = counts.withColumn("n", F.col("n").cast("double"))
    of_a, of_b, all_ = (Window.partitionBy(*by, "band", *k) for k in (["a"], ["b"], []))
    return n.withColumn("ratio", (F.col("n") / F.sum("n").over(of_a)) / (F.sum("n").over(of_b) / F.sum("n").over(all_))).select(*by, "band", "a", "b", F.col("n").cast("bigint").alias("n"), "ratio")


def ripley_l(pairs: DataFrame, sizes: DataFrame, radii: list[float]) -> DataFrame:
    """label, radius, l: sqrt(A * pairs within radius / (pi * n * (n - 1))) for each label; null below two points.

    pairs: label, dist over ordered pairs of different points of one label; sizes: label, n, area.
    """
    r = pairs.withColumn("radius", F.explode(F.array(*[F.lit(float(x)) for x in radii]))).where("dist <= radius").groupBy("label", "radius").agg(F.count(F.lit(1)).alias("k"))
    grid = sizes.withColumn("radius", F.explode(F.array(*[F.lit(float(x)) for x in radii])))
    return grid.join(r, ["label", "radius"], "left").select("label", "radius", F.sqrt(ratio(F.col("area") * F.coalesce("k", F.lit(0)), F.lit(3.141592653589793) * F.col("n") * (F.col("n") - 1))).alias("l"))


def agreement_scores(pairs: DataFrame) -> DataFrame:
    """One row: ari, nmi, fmi, n of two labelings (columns a, b; rows where either is null are left out).

    Only the contingency table, its margins and pair counts are needed. A labeling of one class gives the limits:
    ari and nmi 1 if both have one class, else 0.
    """
    c = kept(pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")))
    two = lambda x: x * (x - 1) / 2
    def margin(k: str) -> DataFrame:
        m = c.groupBy(k).agg(F.sum("n").alias("n"))
        t = F.sum("n").over(Window.partitionBy(F.lit(0)))
        return m.withColumn("t", t).agg(F.sum(two(F.col("n"))).alias(f"p{k}"), F.sum(-(F.col("n") / F.col("t")) * F.log(F.col("n") / F.col("t"))).alias(f"h{k}"))
    joint = c.withColumn("ra", F.sum("n").over(Window.partitionBy("a"))).withColumn("rb", F.sum("n").over(Window.partitionBy("b"))).withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(0))))
    j = joint.agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("pj"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("rb")))).alias("mi"))
    row = j.join(margin("a")).join(margin("b"))  # one row each
    expected = F.col("pa") * F.col("pb") / two(F.col("n"))
    most = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("pj") - expected) / (most - expected))
    mean_h = (F.col("ha") + F.col("hb")) / 2
    return row.select(F.col("n").cast("bigint").alias("n"), ari.alias("ari"), F.when(mean_h == 0, F.lit(1.0)).otherwise(F.col("mi") / mean_h).alias("nmi"), ratio("pj", F.sqrt(F.col("pa") * F.col("pb"))).alias("fmi"))


def class_scores(pairs: DataFrame) -> DataFrame:
    """label, support, recall, precision, f1 of truth against pred; precision and f1 are 0 where nothing was predicted."""
    t = pairs.groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.sum((F.col("truth") == F.col("pred")).cast("bigint")).alias("hit"))
    p = pairs.groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("called"))
    out = t.join(p, "label", "left").withColumns({"hit": F.coalesce("hit", F.lit(0)), "called": F.coalesce("called", F.lit(0))})
    return out.select("label", "support", (F.col("hit") / F.col("support")).alias("recall"), F.coalesce(ratio("hit", "called"), F.lit(0.0)).alias("precision"), (2.0 * F.col("hit") / (F.col("support") + F.col("called"))).alias("f1"))


def overall_scores(pairs: DataFrame) -> DataFrame:
    """One row: balanced_accuracy, macro_f1, chance = 1 / number of true classes."""
    return class_scores(pairs).agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (1.0 / F.count(F.lit(1))).alias("chance"))


def mid_ranks(df: DataFrame, value: str, by: list[str], into: str) -> DataFrame:
    """Adds the rank within by, tied values sharing the mean of their ranks.

    Ranks come from running totals over the counts of values, so no group has to fit into a task. Null values and rows
    with a null in by are left out.
    """
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    place = running_total(n, by, [value], "_n", "_upto").select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(into))
    return df.join(place, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho: the correlation of mid-ranks; rows where either is null are left out."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = mid_ranks(mid_ranks(d, x, by, "_rx"), y, by, "_ry")
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def rank_sum_markers(values: DataFrame, groups: DataFrame) -> DataFrame:
    """gene, grp, n, mean_in, mean_out, u, z, log2fc, p, q: rank sums of each group against all other cells.

    values: id, gene, value > 0 (zeros absent); groups: id, grp. All zeros tie at the bottom, and are counted, not
    written out: a present value ranks after the gene's zeros, each zero has the mean rank of the zeros. z is the
    normal approximation with the correction for ties; log2fc compares means of expm1 with 1e-9 added; p is two-sided, q its
    false discovery rate over the genes of the group. A gene without spread has null z, p and q.
    """
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.count(F.lit(1)).alias("t"))
    v = kept(values.where("value > 0").join(groups, "id"))
    ties = v.groupBy("gene", "value").agg(F.count(F.lit(1)).alias("k"))
    per_gene = ties.groupBy("gene").agg(F.sum("k").alias("present"), F.sum(F.col("k").cast("double") * F.col("k") * F.col("k") - F.col("k")).alias("tie"))
    ranks = mid_ranks(v, "value", ["gene"], "above")
    own = ranks.groupBy("gene", "grp").agg(F.sum("above").alias("rs"), F.count(F.lit(1)).alias("k"), F.sum(F.expm1("value")).alias("e"))
    whole = v.groupBy("gene").agg(F.sum(F.expm1("value")).alias("all_e"))
    grid = per_gene.join(whole, "gene").join(size).join(total)  # genes by groups: the result's own size
    g = grid.join(own, ["gene", "grp"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("k",)}).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("rs", "e")})
    zeros = F.col("t") - F.col("present")
    rank_sum = F.col("rs") + F.col("k") * zeros + (F.col("n") - F.col("k")) * (zeros + 1) / 2.0
    u = rank_sum - F.col("n") * (F.col("n") + 1) / 2.0
    rest = (F.col("t") - F.col("n")).cast("double")
    tie = F.col("tie") + zeros.cast("double") * zeros * zeros - zeros
    var = F.col("n") * rest / 12.0 * (F.col("t") + 1 - tie / (F.col("t").cast("double") * (F.col("t") - 1)))
    mean_in, mean_out = ratio("e", "n"), ratio(F.col("all_e") - F.col("e"), rest)
    return g.select("gene", "grp", "n", mean_in.alias("mean_in"), mean_out.alias("mean_out"), u.alias("u"), F.when(var > 0, (u - F.col("n") * rest / 2.0) / F.sqrt(var)).alias("z"), F.log2((mean_in + 1e-9) / (mean_out + 1e-9)).alias("log2fc")).transform(lambda d: benjamini_hochberg(d.withColumn("p", 2 * normal_tail(F.abs("z"))), "p", ["grp"]))


def best_markers(markers: DataFrame, n: int, most_q: float = 0.01, least_log2fc: float = 1.0) -> DataFrame:
    """grp, markers: the first n genes of each group by falling z (ties by name) among those with q below most_q and
    log2fc above least_log2fc, joined by commas. A group without any has no row."""
    w = Window.partitionBy("grp").orderBy(F.col("z").desc(), "gene")
    m = markers.where((F.col("q") < most_q) & (F.col("log2fc") > least_log2fc)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return m.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "gene"))), lambda x: x["gene"]), ", ").alias("markers"))


def chi_square(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, chi2, dof, p of the table a by b of n; chi2 is null and p is 1 where a margin is 0 or there is one row or
    column only. Cells of the table that are missing have to be there as 0."""
    n = counts.withColumn("ra", F.sum("n").over(Window.partitionBy(*by, "a"))).withColumn("rb", F.sum("n").over(Window.partitionBy(*by, "b"))).withColumn("t", F.sum("n").over(Window.partitionBy(*by)))
    e = F.col("ra").cast("double") * F.col("rb") / F.col("t")
    out = n.groupBy(*by).agg(F.sum(ratio((F.col("n") - e) * (F.col("n") - e), e)).alias("chi2"), F.min(e).alias("least"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("dof"))
    out = out.select(*by, F.when((F.col("least") > 0) & (F.col("dof") > 0), F.col("chi2")).alias("chi2"), "dof")
    return out.withColumn("p", F.coalesce(chi2_tail("chi2", "dof"), F.lit(1.0)))
