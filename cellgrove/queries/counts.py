"""Queries on sparse counts: normalisation, scores, pseudobulk, two counts of the same cells, atlas labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrove.functions import fold
from cellgrove.operators import matrix as mx
from cellgrove.plans import kept, quantiles
from cellgrove.queries.base import ORDERS, SEGMENTED, TISSUE, VECTORS, order_cells, order_genes, segmented, tissue, vector_genes, vectors
from cellgrove.queries.sql import ATLAS
from cellgrove.queries.sql import fdr, t_two_sided
from cellgrove.queries.sql import fold as sql_fold
from cellgrove.sources.tables import current_atlas, read


def lognorm_10k(spark, d):
    """Mean and spread of the log-normalised counts per gene, over cells that have the gene."""
    x = mx.log_normalised(order_genes(spark, d))
    return x.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lognorm"), 9).alias("mean"), F.round(F.stddev_samp("lognorm"), 7).alias("sd"))


def panel_subset(spark, d):
    """Quantity per brand of a panel of brands, under the panel's names."""
    panel = read(spark, d, "part").select(F.col("p_brand").alias("gene_id")).distinct().where(F.col("gene_id").rlike("[135]$")).withColumn("symbol", F.lower("gene_id"))
    return mx.panel_subset(order_genes(spark, d), panel).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt"))


def left_anti_panel(spark, d):
    """Parts that no order has more than 49 of."""
    return read(spark, d, "part").join(read(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_brand")


def cluster_score_z(spark, d):
    """z over groups of the mean log-normalised count, per gene."""
    x = mx.log_normalised(order_genes(spark, d))
    g = order_cells(spark, d).select("cell_id", F.col("lineage").alias("grp"))
    return mx.group_z(mx.group_means(x, kept(g), F.col("lognorm")), "grp", "gene", "mean").select("grp", "gene", F.round("mean", 9).alias("mean"), F.round("z", 5).alias("z"))


def foreign_genes(spark, d):
    """Genes much higher in another lineage than in lineage l0."""
    g = vectors(spark, d).select(F.col("id").alias("cell_id"), F.col("lineage").alias("grp"))
    x = mx.log_normalised(vector_genes(spark, d).withColumnRenamed("id", "cell_id"))
    return mx.foreign_genes(x, kept(g), "l0", 1.5).select("gene", "foreign", F.round("fold", 6).alias("fold"))


DOMAINS = ("F", "O")


def pseudobulk(spark, d):
    """Sums per block, domain and gene of blocks that have both domains."""
    return mx.pseudobulk(order_genes(spark, d), order_cells(spark, d).select("cell_id", "block", "domain"), DOMAINS)


def _change(spark, d, least=0):
    x = order_genes(spark, d, least)
    return mx.paired_change(kept(mx.pseudobulk(x, order_cells(spark, d).select("cell_id", "block", "domain"), DOMAINS)), DOMAINS)


def paired_change(spark, d):
    """Change between the domains over blocks: mean log2 ratio, paired t, its p and the false discovery rate."""
    return _change(spark, d).select("gene", F.round("base_mean", 6).alias("base_mean"), F.round("log2fc", 7).alias("log2fc"), F.round("t", 5).alias("t"), F.col("n").cast("bigint").alias("n"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


STRICT = 25  # items of a line that the second count of the same cells asks for


def call_genes(spark, d):
    """Calls per gene from the tests on two counts of the same cells and a list of foreign genes."""
    first, second = kept(_change(spark, d)), _change(spark, d, STRICT)
    return mx.called_genes(first.select("gene", "log2fc", "q"), second.select("gene", "log2fc", "q"), first.where(F.col("gene").rlike("#1")).select("gene"), 0.9)


GENES = ["g1", "g2", "g3", "g4", "g5"]


def positivity_rates(spark, d):
    """Percentage of cells positive per lineage and gene."""
    g = vectors(spark, d).select(F.col("id").alias("cell_id"), F.col("lineage").alias("grp"))
    return mx.positivity(vector_genes(spark, d).withColumnRenamed("id", "cell_id"), kept(g), GENES).select("grp", "gene", F.round("pct", 9).alias("pct"))


def above_noise_floor(spark, d):
    """Cell types clearly above the tumour cells' rate, per gene."""
    g = vectors(spark, d).select(F.col("id").alias("cell_id"), F.col("cell_type").alias("grp"))
    rates = mx.positivity(vector_genes(spark, d).withColumnRenamed("id", "cell_id"), kept(g), GENES)
    return mx.above_noise(rates, "t0", 1.1, 5.0)


def paired_spillover(spark, d):
    """Cells positive for foreign genes in the first and the second count."""
    s = kept(segmented(spark, d))
    both = s.groupBy("cell_id").agg(F.countDistinct("seg").alias("k")).where("k = 2").select("cell_id", F.concat(F.lit("l"), (F.col("cell_id") % 3).cast("string")).alias("grp"))
    tests = spark.createDataFrame([("l0", "a", "Brand#11"), ("l0", "a", "Brand#12"), ("l1", "b", "Brand#23"), ("l2", "c", "Brand#14"), ("l2", "c", "Brand#15")], "grp string, foreign string, gene string")
    f = mx.spillover(s.where("seg = 'O'"), s.where("seg = 'F'"), kept(both), tests)
    return f.select("grp", "foreign", *[F.round(c, 9).alias(c) for c in ("before", "after", "reduction")])


def by_segmentation(spark, d):
    """Percentage of cells positive per count, group and gene, to one decimal."""
    s = kept(segmented(spark, d))
    cells = s.select("cell_id", F.concat_ws("|", "seg", F.concat(F.lit("l"), (F.col("cell_id") % 3).cast("string"))).alias("grp")).distinct()
    x = s.select("cell_id", F.concat_ws("|", "seg", F.concat(F.lit("l"), (F.col("cell_id") % 3).cast("string"))).alias("g2"), "gene", "cnt").where("cnt > 5")
    hit = x.where(F.col("gene").isin("Brand#11", "Brand#23")).groupBy(F.col("g2").alias("grp"), "gene").agg(F.countDistinct("cell_id").alias("k"))
    n = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("gene", F.explode(F.array(F.lit("Brand#11"), F.lit("Brand#23"))))
    return n.join(hit, ["grp", "gene"], "left").select("grp", "gene", F.round(100.0 * F.coalesce("k", F.lit(0)) / F.col("n"), 1).alias("pct"))


def segmentation_summary(spark, d):
    """Cells, totals and medians of each count."""
    per = segmented(spark, d).groupBy("seg", "cell_id").agg(F.sum("cnt").alias("t"), F.count(F.lit(1)).alias("g"))
    per = kept(per)
    s = per.groupBy("seg").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("t") >= 10).cast("bigint")).alias("cells_10"), F.sum("t").alias("counts"))
    return s.join(quantiles(per, ["seg"], "t", {"median_counts": 0.5}), "seg", "left").join(quantiles(per, ["seg"], "g", {"median_genes": 0.5}), "seg", "left")


def probe_rates(spark, d):
    """Whole percentages (halves to even) of each lineage's cells with any gene of a probe, and what the rates mean."""
    g = kept(vectors(spark, d).select("id", "cell_type"))
    probe = spark.createDataFrame([("p1", "g1"), ("p1", "g2"), ("p2", "g3"), ("p3", "g9")], "probe string, gene string")
    n = g.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    hit = vector_genes(spark, d).join(probe, "gene").join(g, "id").groupBy("cell_type", "probe").agg(F.countDistinct("id").alias("k"))
    r = n.join(hit, "cell_type", "left").groupBy("cell_type").pivot("probe", ["p1", "p2", "p3"]).agg(F.first(F.bround(100.0 * F.col("k") / F.col("n"), 0)))
    r = r.withColumns({p: F.coalesce(p, F.lit(0.0)) for p in ("p1", "p2", "p3")})
    return r.withColumn("call", F.when((F.col("p1") >= 60) & (F.greatest("p2", "p3") < 75), "clean").otherwise("mixed"))


def detection_ratio(spark, d):
    """Detection rate of each gene in the one count against the other, whose rate counts at least 1 percent."""
    s = segmented(spark, d)
    n = kept(s.select("seg", "cell_id").distinct().groupBy("seg").agg(F.count(F.lit(1)).alias("n")))
    r = s.where("cnt > 20").groupBy("seg", "gene").agg(F.countDistinct("cell_id").alias("k")).join(n, "seg").withColumn("r", 100.0 * F.col("k") / F.col("n"))
    w = r.groupBy("gene").agg(F.max(F.when(F.col("seg") == "O", F.col("r"))).alias("o"), F.max(F.when(F.col("seg") == "F", F.col("r"))).alias("f"))
    return w.select("gene", F.round(F.coalesce("o", F.lit(0.0)), 9).alias("pct_o"), F.round(F.coalesce("f", F.lit(0.0)), 9).alias("pct_f"), F.round(F.coalesce("o", F.lit(0.0)) / F.greatest(F.coalesce("f", F.lit(0.0)), F.lit(1.0)), 9).alias("ratio"))


def _labels(spark, d):
    return current_atlas(spark, d, ["cell_type_major", "cell_type_tumor", "ann_coarse", "donor_id"])


def agreement(spark, d):
    """Per coarse label the share of fine labels among those that the type table's lineages would allow."""
    cells = _labels(spark, d).where("ann_coarse is not null").select(F.col("ann_coarse").alias("manual"), fold("cell_type_major").alias("other"))
    allowed = spark.createDataFrame([("T cell", "t cell cd4"), ("T cell", "t cell cd8"), ("T cell", "t cell regulatory"), ("Myeloid", "macrophage"), ("Myeloid", "monocyte"), ("B cell", "b cell"), ("Tumor", "tumor cells")], "manual string, other string")
    return mx.allowed_agreement(cells, allowed).select("manual", "n", F.round("pct", 9).alias("pct"), "top", F.round("top_pct", 9).alias("top_pct"))


def crosstab_norm(spark, d):
    """Niche by lineage, percentages within the niche."""
    return mx.shares(tissue(spark, d).where("niche is not null"), "niche", "lineage").select("niche", "lineage", "n", F.round("pct", 9).alias("pct"))


def majority_label(spark, d):
    """The most frequent lineage of each niche and its share: the compartment a niche counts for."""
    best = F.max_by(F.struct("lineage", "pct"), F.struct("n", "smaller"))
    w = Window.partitionBy("niche").orderBy(F.col("lineage").desc())
    c = crosstab_norm(spark, d).withColumn("smaller", F.row_number().over(w))
    return c.groupBy("niche").agg(best.alias("m")).select("niche", "m.pct", F.col("m.lineage").alias("compartment"))


def label_counts_both(spark, d):
    """Cells per label in two labelings, 0 where one has none (full outer)."""
    a = kept(_labels(spark, d))
    x = a.where("cell_type_major is not null").groupBy(fold("cell_type_major").alias("label")).agg(F.count(F.lit(1)).alias("n_major"))
    y = a.where("cell_type_tumor is not null").groupBy(fold("cell_type_tumor").alias("label")).agg(F.count(F.lit(1)).alias("n_tumor"))
    return x.join(y, "label", "full").select("label", F.coalesce("n_major", F.lit(0)).alias("n_major"), F.coalesce("n_tumor", F.lit(0)).alias("n_tumor"))


def balanced_sample(spark, d):
    """At most 20 atlas cells per coarse label, by hash."""
    return mx.balanced_sample(_labels(spark, d).where("ann_coarse is not null"), "ann_coarse", "obs_id", 20, 7).select("ann_coarse", "obs_id")


def group_split(spark, d):
    """Drawn rows and their donors per label, of donors held out (at most 1,000 each) and of the others (5,000)."""
    a = _labels(spark, d).where("donor_id is not null and ann_coarse is not null").withColumn("donor", F.upper(F.trim("donor_id")))
    return mx.grouped_caps(a, "donor", "ann_coarse", "obs_id", 25, seed=3).groupBy("held_out", "ann_coarse").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("donor").alias("donors"))


def explorer_groups(spark, d):
    """Colour number of each cell by its type."""
    return mx.palette_groups(tissue(spark, d), "id", "cell_type").groupBy("grp", "colour").agg(F.count(F.lit(1)).alias("n"))


def log_fold_correlation(spark, d):
    """Correlation over genes of the log2 fold changes between the domains in two counts of the same cells."""
    a, b = _change(spark, d).select("gene", F.col("log2fc").alias("o")), _change(spark, d, STRICT).select("gene", F.col("log2fc").alias("f"))
    return a.join(b, "gene").agg(F.round(F.corr("o", "f"), 7).alias("r"), F.count(F.lit(1)).alias("genes"))


def equal_sample(spark, d):
    """Exactly five atlas cells of every coarse label."""
    return mx.equal_sample(_labels(spark, d).where("ann_coarse is not null"), "ann_coarse", "obs_id", 5, 7).select("ann_coarse", "obs_id")


def mixed_spillover(spark, d):
    """Spillover in the two largest groups that have partner genes."""
    s = kept(segmented(spark, d))
    both = s.groupBy("cell_id").agg(F.countDistinct("seg").alias("k")).where("k = 2").select("cell_id", F.concat(F.lit("l"), (F.col("cell_id") % 3).cast("string")).alias("grp"))
    partners = spark.createDataFrame([("l0", "a", "Brand#11"), ("l1", "b", "Brand#23"), ("l2", "c", "Brand#14")], "grp string, foreign string, gene string")
    f = mx.mixed_spillover(s.where("seg = 'O'"), s.where("seg = 'F'"), kept(both), partners, 2)
    return f.select("grp", "foreign", *[F.round(c, 9).alias(c) for c in ("before", "after", "reduction")])


QUERIES = {f.__name__: f for f in (lognorm_10k, panel_subset, left_anti_panel, cluster_score_z, foreign_genes, pseudobulk, paired_change, call_genes, positivity_rates, above_noise_floor, paired_spillover, by_segmentation, segmentation_summary, probe_rates, detection_ratio, agreement, crosstab_norm, majority_label, label_counts_both, balanced_sample, group_split, explorer_groups, log_fold_correlation, equal_sample, mixed_spillover)}

_LOG = f"{ORDERS}, ol AS (SELECT *, ln(1 + 10000.0::DOUBLE * cnt / greatest(sum(cnt) OVER (PARTITION BY cell_id), 1)) AS lognorm FROM ogene)"
_BULK = f"""{ORDERS}, so AS (SELECT * FROM ocell WHERE domain IN ('F', 'O')), bg AS (SELECT block, domain FROM so GROUP BY 1, 2 HAVING count(*) >= 10), bo AS (SELECT block FROM bg GROUP BY 1 HAVING count(*) = 2),
bs AS (SELECT block, domain, gene, sum(cnt) AS cnt FROM ogene JOIN so USING (cell_id) WHERE block IN (SELECT block FROM bo) GROUP BY 1, 2, 3), bulk AS (SELECT * FROM bs WHERE gene IN (SELECT gene FROM bs GROUP BY 1 HAVING sum(cnt) >= 10))"""
def _changed(n: str) -> str:
    """From bulk<n> to cq<n>: gene, base_mean, f0 (log2fc), t, n, p, q0."""
    t = "(f0 / nullif(sqrt(greatest(0, (ss - n * f0 ** 2) / (n - 1))) / sqrt(n), 0))"
    return f"""cpm{n} AS (SELECT *, log2(1 + 1e6 * cnt / sum(cnt) OVER (PARTITION BY block, domain)) AS l FROM bulk{n}), wd{n} AS (SELECT block, gene, coalesce(max(l) FILTER (WHERE domain = 'F'), 0) - coalesce(max(l) FILTER (WHERE domain = 'O'), 0) AS dd, sum(cnt) AS c FROM cpm{n} GROUP BY 1, 2), nb{n} AS (SELECT count(DISTINCT block)::DOUBLE AS n FROM bulk{n}),
cs{n} AS (SELECT gene, sum(c) / (2 * n) AS base_mean, sum(dd) / n AS f0, sum(dd * dd) AS ss, n FROM wd{n}, nb{n} GROUP BY gene, n), ct{n} AS (SELECT gene, base_mean, f0, {t} AS t, n FROM cs{n}), cp{n} AS (SELECT *, {t_two_sided('t', '(n - 1)')} AS p FROM ct{n}), cq{n} AS ({fdr(f'cp{n}', into='q0')})"""


_CHANGE = f"{_BULK}, {_changed('')}, ch AS (SELECT gene, round(base_mean, 6) AS base_mean, round(f0, 7) AS log2fc, round(t, 5) AS t, n::BIGINT AS n, round(p, 9) AS p, round(q0, 9) AS q FROM cq)"
_CHANGE2 = f"""og2 AS (SELECT l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= {STRICT} GROUP BY 1, 2), bs2 AS (SELECT block, domain, gene, sum(cnt) AS cnt FROM og2 JOIN so USING (cell_id) WHERE block IN (SELECT block FROM bo) GROUP BY 1, 2, 3), bulk2 AS (SELECT * FROM bs2 WHERE gene IN (SELECT gene FROM bs2 GROUP BY 1 HAVING sum(cnt) >= 10)), {_changed('2')}"""
_GENES = ", ".join(f"'{g}'" for g in GENES)
_RATE = lambda g: f"rate AS (SELECT v.{g} AS grp, e.gene, 100.0::DOUBLE * count(x.id) / count(*) AS pct FROM vec v CROSS JOIN (SELECT unnest([{_GENES}]) AS gene) e LEFT JOIN vgene x ON x.id = v.id AND x.gene = e.gene GROUP BY 1, 2)"

SQL = {
    "lognorm_10k": f"WITH {_LOG} SELECT gene, count(*) AS n, round(avg(lognorm), 9) AS mean, round(stddev_samp(lognorm), 7) AS sd FROM ol GROUP BY 1",
    "panel_subset": f"WITH {ORDERS} SELECT lower(gene) AS gene, count(*) AS n, sum(cnt) AS cnt FROM ogene WHERE regexp_matches(gene, '[135]$') GROUP BY 1",
    "left_anti_panel": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "cluster_score_z": f"WITH {_LOG}, n AS (SELECT lineage AS grp, count(*) AS n FROM ocell GROUP BY 1), m AS (SELECT lineage AS grp, gene, sum(lognorm) AS s FROM ol JOIN ocell USING (cell_id) GROUP BY 1, 2), k AS (SELECT grp, gene, s / n AS mean FROM m JOIN n USING (grp)) SELECT grp, gene, round(mean, 9) AS mean, round((mean - avg(mean) OVER (PARTITION BY gene)) / nullif(stddev_samp(mean) OVER (PARTITION BY gene), 0), 5) AS z FROM k",
    "foreign_genes": f"WITH {VECTORS}, l AS (SELECT id, gene, 10000.0::DOUBLE * cnt / greatest(sum(cnt) OVER (PARTITION BY id), 1) AS e FROM vgene), n AS (SELECT lineage AS grp, count(*) AS n FROM vec GROUP BY 1), m AS (SELECT lineage AS grp, gene, sum(e) / any_value(n.n) AS mean FROM l JOIN vec USING (id) JOIN n ON n.grp = lineage GROUP BY 1, 2), o AS (SELECT gene, grp, mean, row_number() OVER (PARTITION BY gene ORDER BY mean DESC, grp) AS rn FROM m WHERE grp <> 'l0') SELECT o.gene, o.grp AS \"foreign\", round(o.mean / greatest(coalesce(w.mean, 0), 1e-3), 6) AS fold FROM o LEFT JOIN m w ON w.gene = o.gene AND w.grp = 'l0' WHERE rn = 1 AND o.mean / greatest(coalesce(w.mean, 0), 1e-3) >= 1.5",
    "pseudobulk": f"WITH {_BULK} SELECT block, domain, gene, cnt FROM bulk",
    "paired_change": f"WITH {_CHANGE} SELECT * FROM ch",
    "call_genes": f"WITH {_CHANGE}, {_CHANGE2} SELECT a.gene, CASE WHEN NOT coalesce(a.q0 < 0.9, false) THEN 'n.s.' WHEN a.gene LIKE '%#1%' THEN 'spillover' WHEN NOT coalesce(sign(a.f0) = sign(b.f0) AND b.q0 < 0.9, false) THEN 'not confirmed' ELSE 'intrinsic' END AS call FROM cq a LEFT JOIN cq2 b ON a.gene = b.gene",
    "equal_sample": f"WITH {ATLAS} SELECT ann_coarse, obs_id FROM (SELECT ann_coarse, obs_id, row_number() OVER (PARTITION BY ann_coarse ORDER BY md5('7|' || obs_id), obs_id) AS k FROM atlas WHERE ann_coarse IS NOT NULL) WHERE k <= 5",
    "mixed_spillover": f"WITH {SEGMENTED}, b0 AS (SELECT cell_id, 'l' || (cell_id % 3) AS grp FROM segm GROUP BY 1 HAVING count(DISTINCT seg) = 2), b AS (SELECT * FROM b0 WHERE grp IN (SELECT grp FROM b0 GROUP BY 1 ORDER BY count(*) DESC, grp LIMIT 2)), t(grp, fo, gene) AS (VALUES ('l0', 'a', 'Brand#11'), ('l1', 'b', 'Brand#23'), ('l2', 'c', 'Brand#14')), n AS (SELECT grp, count(*) AS n FROM b GROUP BY 1), r AS (SELECT t.grp, fo, 100.0::DOUBLE * count(DISTINCT s.cell_id) FILTER (WHERE seg = 'O') / any_value(n.n) AS before_, 100.0::DOUBLE * count(DISTINCT s.cell_id) FILTER (WHERE seg = 'F') / any_value(n.n) AS after_ FROM t JOIN n ON n.grp = t.grp LEFT JOIN (SELECT segm.*, grp FROM segm JOIN b USING (cell_id) WHERE cnt > 0) s ON s.grp = t.grp AND s.gene = t.gene GROUP BY 1, 2) SELECT grp, fo AS \"foreign\", round(before_, 9) AS before, round(after_, 9) AS after, round(before_ / greatest(after_, 1e-9), 9) AS reduction FROM r",
    "positivity_rates": f"WITH {VECTORS}, {_RATE('lineage')} SELECT grp, gene, round(pct, 9) AS pct FROM rate",
    "above_noise_floor": f"WITH {VECTORS}, {_RATE('cell_type')}, f AS (SELECT gene, greatest(pct, 0.5) AS floor FROM rate WHERE grp = 't0') SELECT r.gene, coalesce(string_agg(grp, ', ' ORDER BY grp) FILTER (WHERE pct > 1.1::DOUBLE * floor AND pct >= 5), 'none above 1.1x noise floor') AS groups FROM rate r JOIN f ON f.gene = r.gene WHERE grp <> 't0' GROUP BY 1",
    "paired_spillover": f"WITH {SEGMENTED}, b AS (SELECT cell_id, 'l' || (cell_id % 3) AS grp FROM segm GROUP BY 1 HAVING count(DISTINCT seg) = 2), t(grp, fo, gene) AS (VALUES ('l0', 'a', 'Brand#11'), ('l0', 'a', 'Brand#12'), ('l1', 'b', 'Brand#23'), ('l2', 'c', 'Brand#14'), ('l2', 'c', 'Brand#15')), n AS (SELECT grp, count(*) AS n FROM b GROUP BY 1), r AS (SELECT t.grp, fo, 100.0::DOUBLE * count(DISTINCT s.cell_id) FILTER (WHERE seg = 'O') / any_value(n.n) AS before_, 100.0::DOUBLE * count(DISTINCT s.cell_id) FILTER (WHERE seg = 'F') / any_value(n.n) AS after_ FROM t JOIN n ON n.grp = t.grp LEFT JOIN (SELECT segm.*, grp FROM segm JOIN b USING (cell_id) WHERE cnt > 0) s ON s.grp = t.grp AND s.gene = t.gene GROUP BY 1, 2) SELECT grp, fo AS \"foreign\", round(before_, 9) AS before, round(after_, 9) AS after, round(before_ / greatest(after_, 1e-9), 9) AS reduction FROM r",
    "by_segmentation": f"WITH {SEGMENTED}, c AS (SELECT DISTINCT cell_id, seg || '|l' || (cell_id % 3) AS grp FROM segm), n AS (SELECT grp, count(*) AS n FROM c GROUP BY 1), g AS (SELECT unnest(['Brand#11', 'Brand#23']) AS gene) SELECT n.grp, g.gene, round(100.0::DOUBLE * (SELECT count(DISTINCT cell_id) FROM segm s WHERE s.gene = g.gene AND cnt > 5 AND seg || '|l' || (cell_id % 3) = n.grp) / n.n, 1) AS pct FROM n, g",
    "segmentation_summary": f"WITH {SEGMENTED}, p AS (SELECT seg, cell_id, sum(cnt) AS t, count(*) AS g FROM segm GROUP BY 1, 2) SELECT seg, count(*) AS cells, sum((t >= 10)::INT)::BIGINT AS cells_10, sum(t) AS counts, median(t) AS median_counts, median(g) AS median_genes FROM p GROUP BY 1",
    "probe_rates": f"WITH {VECTORS}, pb(probe, gene) AS (VALUES ('p1', 'g1'), ('p1', 'g2'), ('p2', 'g3'), ('p3', 'g9')), n AS (SELECT cell_type, count(*) AS n FROM vec GROUP BY 1), k AS (SELECT cell_type, probe, count(DISTINCT id) AS k FROM vgene JOIN pb USING (gene) JOIN vec USING (id) GROUP BY 1, 2), w AS (SELECT n.cell_type, coalesce(max(round_even(100.0::DOUBLE * k / n.n, 0)) FILTER (WHERE probe = 'p1'), 0) AS p1, coalesce(max(round_even(100.0::DOUBLE * k / n.n, 0)) FILTER (WHERE probe = 'p2'), 0) AS p2, coalesce(max(round_even(100.0::DOUBLE * k / n.n, 0)) FILTER (WHERE probe = 'p3'), 0) AS p3 FROM n LEFT JOIN k ON k.cell_type = n.cell_type GROUP BY 1) SELECT *, CASE WHEN p1 >= 60 AND greatest(p2, p3) < 75 THEN 'clean' ELSE 'mixed' END AS call FROM w",
    "detection_ratio": f"WITH {SEGMENTED}, n AS (SELECT seg, count(DISTINCT cell_id) AS n FROM segm GROUP BY 1), r AS (SELECT s.seg, gene, 100.0::DOUBLE * count(DISTINCT cell_id) / any_value(n.n) AS r FROM segm s JOIN n ON n.seg = s.seg WHERE cnt > 20 GROUP BY 1, 2), w AS (SELECT gene, coalesce(max(r) FILTER (WHERE seg = 'O'), 0) AS o, coalesce(max(r) FILTER (WHERE seg = 'F'), 0) AS f FROM r GROUP BY 1) SELECT gene, round(o, 9) AS pct_o, round(f, 9) AS pct_f, round(o / greatest(f, 1), 9) AS ratio FROM w",
    "agreement": f"WITH {ATLAS}, al(manual, other) AS (VALUES ('T cell', 't cell cd4'), ('T cell', 't cell cd8'), ('T cell', 't cell regulatory'), ('Myeloid', 'macrophage'), ('Myeloid', 'monocyte'), ('B cell', 'b cell'), ('Tumor', 'tumor cells')), c AS (SELECT ann_coarse AS manual, {sql_fold('cell_type_major')} AS other, count(*) AS n FROM atlas WHERE ann_coarse IS NOT NULL GROUP BY 1, 2), r AS (SELECT c.*, al.other IS NOT NULL AS ok, row_number() OVER (PARTITION BY c.manual ORDER BY n DESC, c.other NULLS LAST) AS rn FROM c LEFT JOIN al ON al.manual = c.manual AND al.other = c.other) SELECT manual, sum(n)::BIGINT AS n, round(100.0::DOUBLE * coalesce(sum(n) FILTER (WHERE ok), 0) / sum(n), 9) AS pct, max(other) FILTER (WHERE rn = 1) AS top, round(100.0::DOUBLE * max(n) FILTER (WHERE rn = 1) / sum(n), 9) AS top_pct FROM r GROUP BY 1",
    "crosstab_norm": f"WITH {TISSUE} SELECT niche, lineage, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY niche), 9) AS pct FROM tissue WHERE niche IS NOT NULL GROUP BY 1, 2",
    "majority_label": f"WITH {TISSUE}, c AS (SELECT niche, lineage, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY niche), 9) AS pct FROM tissue WHERE niche IS NOT NULL GROUP BY 1, 2) SELECT niche, pct, lineage AS compartment FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY n DESC, lineage) AS rn FROM c) WHERE rn = 1",
    "label_counts_both": f"WITH {ATLAS}, x AS (SELECT {sql_fold('cell_type_major')} AS label, count(*) AS n FROM atlas WHERE cell_type_major IS NOT NULL GROUP BY 1), y AS (SELECT {sql_fold('cell_type_tumor')} AS label, count(*) AS n FROM atlas WHERE cell_type_tumor IS NOT NULL GROUP BY 1) SELECT coalesce(x.label, y.label) AS label, coalesce(x.n, 0) AS n_major, coalesce(y.n, 0) AS n_tumor FROM x FULL JOIN y ON x.label = y.label",
    "balanced_sample": f"WITH {ATLAS} SELECT ann_coarse, obs_id FROM (SELECT ann_coarse, obs_id, row_number() OVER (PARTITION BY ann_coarse ORDER BY md5('7|' || obs_id), obs_id) AS k FROM atlas WHERE ann_coarse IS NOT NULL) WHERE k <= 20",
    "group_split": f"WITH {ATLAS}, a AS (SELECT ann_coarse, obs_id, upper(trim(donor_id)) AS donor, ('0x' || substr(md5('3|' || upper(trim(donor_id))), 1, 8))::BIGINT % 100 < 25 AS held_out FROM atlas WHERE donor_id IS NOT NULL AND ann_coarse IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY held_out, ann_coarse ORDER BY md5('3|' || obs_id), obs_id) AS k FROM a) SELECT held_out, ann_coarse, count(*) AS n, count(DISTINCT donor) AS donors FROM k WHERE k <= CASE WHEN held_out THEN 1000 ELSE 5000 END GROUP BY 1, 2",
    "explorer_groups": f"WITH {TISSUE} SELECT cell_type AS grp, ((dense_rank() OVER (ORDER BY cell_type) - 1) % 20)::INT AS colour, count(*) AS n FROM tissue GROUP BY cell_type",
    "log_fold_correlation": f"WITH {_CHANGE}, {_CHANGE2} SELECT round(corr(a.f0, b.f0), 7) AS r, count(*) AS genes FROM cq a JOIN cq2 b ON a.gene = b.gene",
}
