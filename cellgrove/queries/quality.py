"""Quality control queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrove.operators import qc
from cellgrove.plans import kept, quantiles
from cellgrove.queries.base import ORDERS, TISSUE, order_cells, order_genes, tissue
from cellgrove.queries.sql import ATLAS, CELL
from cellgrove.queries.sql import fold as sql_fold
from cellgrove.sources.tables import current_atlas, read, typed_cells


def _metrics(spark, d):
    return qc.with_metrics(order_cells(spark, d), order_genes(spark, d), control="control_counts")


def qc_metrics(spark, d):
    """Genes, density and control share of each order taken as a cell."""
    return _metrics(spark, d).select("cell_id", F.col("n_genes").cast("bigint").alias("n_genes"), F.round("nucleus_ratio", 12).alias("nucleus_ratio"), F.round("density", 9).alias("density"), F.round("control_frac", 9).alias("control_frac"))


FLOORS = {"min_counts": 40, "min_genes": 2, "area_nmads": 1.5, "max_control": 0.5}


def qc_flags(spark, d):
    """How many cells break each combination of rules."""
    return qc.qc_flags(_metrics(spark, d), **FLOORS).groupBy(*qc.RULES).agg(F.count(F.lit(1)).alias("n"))


def qc_rule_table(spark, d):
    """Cells flagged by each rule, and by it alone."""
    return qc.rule_table(qc.qc_flags(_metrics(spark, d), **FLOORS))


def qc_kept(spark, d):
    """Cells that pass every rule, per group."""
    broken = " or ".join(qc.RULES)
    return qc.qc_flags(_metrics(spark, d), **FLOORS).where(f"not ({broken})").groupBy("lineage").agg(F.count(F.lit(1)).alias("n"), F.sum("n_genes").cast("bigint").alias("genes"))


def mad_bounds(spark, d):
    """Bounds of the cell area per type."""
    return qc.mad_bounds(tissue(spark, d), "cell_area", 3.0, ["cell_type"]).select("cell_type", F.round("med", 9).alias("med"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _in_fields(spark, d):
    c = typed_cells(spark, d, ["transcript_counts", "cell_area"], position=True, kinds=()).where("x_um is not null and section_id is not null")
    c = c.select(F.col("cell_id").alias("id"), F.col("section_id").alias("space"), F.col("x_um").alias("x"), F.col("y_um").alias("y"), "transcript_counts", "cell_area")
    f = read(spark, d, "fov").select(F.col("section_id").alias("space"), F.col("fov").alias("region"), F.col("fov").alias("ord"), "x", "y", "width", "height")
    return qc.assign_rectangle(kept(c), f), f


def fov_assign(spark, d):
    """Cells per section and imaging rectangle, the first one where they overlap; outside all: empty name."""
    return _in_fields(spark, d)[0].groupBy("space", F.coalesce("region", F.lit("")).alias("fov")).agg(F.count(F.lit(1)).alias("n"))


def _fields(spark, d):
    c, f = _in_fields(spark, d)
    c = kept(c.where("region is not null"))
    mid = quantiles(c, ["space", "region"], "transcript_counts", {"median_counts": 0.5})
    per = c.groupBy("space", "region").agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("transcript_counts") >= 20).cast("double")).alias("share_20"))
    return f.select("space", "region").join(per, ["space", "region"], "left").join(mid, ["space", "region"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def fov_quality(spark, d):
    """Cells, median counts and share of cells with at least 20 transcripts for every rectangle, also empty ones."""
    return _fields(spark, d).select("space", F.col("region").alias("fov"), "cells", "median_counts", F.round("share_20", 9).alias("share_20"))


def fov_outliers(spark, d):
    """Rectangles whose median counts or share stand out among those with at least 200 cells."""
    return qc.tile_outliers(_fields(spark, d), ["median_counts", "share_20"], 200, 3.0).select("space", F.col("region").alias("fov"), "cells", F.round("z_median_counts", 6).alias("z_counts"), F.round("z_share_20", 6).alias("z_share"), "outlier")


def _transcripts(spark, d):
    e = read(spark, d, "events")
    return e.where("value >= 10").select(F.col("event_type").alias("feature"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("cell_id"))


def gene_detection(spark, d):
    """Totals per feature against the mean of the control features (error)."""
    return qc.gene_detection(_transcripts(spark, d), "^error$")


def assigned_fraction(spark, d):
    """Share of the transcripts above the quality floor that lie in a cell."""
    return _transcripts(spark, d).where("feature <> 'error'").agg(F.round(F.avg(F.col("cell_id").isNotNull().cast("double")), 9).alias("assigned"), F.count(F.lit(1)).alias("n"))


def props_metrics(spark, d):
    """A number read out of JSON and by regular expression, averaged per feature."""
    e = read(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    r = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")
    return e.groupBy("event_type").agg(F.sum(k.cast("bigint")).alias("k_json"), F.sum(r.cast("bigint")).alias("k_regex"))


def composition(spark, d):
    """Cells and percentage per lineage and type."""
    n = tissue(spark, d).groupBy("lineage", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def log_histogram(spark, d):
    """Transcript counts in 80 bins of equal width on the log scale from 1 to 10,000."""
    v = typed_cells(spark, d, ["transcript_counts"], kinds=()).where("transcript_counts > 0")
    b = F.floor(F.log10(F.col("transcript_counts").cast("double")) * 20 + 1e-9).cast("bigint")
    return v.groupBy(F.least(F.greatest(b, F.lit(0)), F.lit(79)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def eligible(spark, d):
    """Atlas cells fit for training: lung, not Smart-seq2, a label other than other, a known origin."""
    a = current_atlas(spark, d, ["tissue", "platform", "cell_type_major", "origin"])
    from cellgrove.functions import fold

    ok = (fold("tissue") == "lung") & (fold("platform") != "smart-seq2") & (fold("cell_type_major") != "other") & F.col("origin").isNotNull()
    return a.where(ok).groupBy(fold("cell_type_major").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def sub_cell_summary(spark, d):
    """One row per section: cells, sums, medians of counts and areas."""
    t = kept(tissue(spark, d))
    s = t.groupBy("space").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("transcript_counts") >= 10).cast("bigint")).alias("cells_10"), F.sum("transcript_counts").alias("counts"))
    a, b = quantiles(t, ["space"], "transcript_counts", {"median_counts": 0.5}), quantiles(t, ["space"], "cell_area", {"median_area": 0.5})
    return s.join(a, "space", "left").join(b, "space", "left")


QUERIES = {f.__name__: f for f in (qc_metrics, qc_flags, qc_rule_table, qc_kept, mad_bounds, fov_assign, fov_quality, fov_outliers, gene_detection, assigned_fraction, props_metrics, composition, log_histogram, eligible, sub_cell_summary)}

_M = f"""{ORDERS}, m AS (SELECT c.*, n_genes, total_counts, nucleus_area / nullif(cell_area, 0) AS nucleus_ratio, transcript_counts / nullif(cell_area, 0) AS density, control_counts / nullif(total_counts, 0) AS control_frac FROM ocell c JOIN (SELECT cell_id, count(*) AS n_genes, sum(cnt) AS total_counts FROM ogene WHERE cnt > 0 GROUP BY 1) USING (cell_id))"""
_F = f"""{_M}, l AS (SELECT ln(1 + cell_area) AS v FROM m), md AS (SELECT median(v) AS med FROM l), mm AS (SELECT med, 1.4826 * median(abs(v - med)) AS mad FROM l, md GROUP BY med),
f AS (SELECT m.*, transcript_counts < 40 AS low_counts, n_genes < 2 AS low_genes, cell_area < exp(med - 1.5 * mad) - 1 AS small, cell_area > exp(med + 1.5 * mad) - 1 AS large, coalesce(control_frac > 0.5, false) AS control FROM m, mm)"""
_FOV = f"""{CELL}, c AS (SELECT cell_id AS id, section_id AS space, xu AS x, yu AS y, transcript_counts FROM cell WHERE xu IS NOT NULL AND section_id IS NOT NULL),
w AS (SELECT c.*, (SELECT min(f.fov) FROM fov f WHERE f.section_id = c.space AND c.x >= f.x AND c.x < f.x + f.width AND c.y >= f.y AND c.y < f.y + f.height) AS fov FROM c),
q AS (SELECT f.section_id AS space, f.fov, count(w.id) AS cells, median(transcript_counts) AS median_counts, avg((transcript_counts >= 20)::INT::DOUBLE) AS share_20 FROM fov f LEFT JOIN w ON w.space = f.section_id AND w.fov = f.fov GROUP BY 1, 2)"""
_T = "t AS (SELECT event_type AS feature, CASE WHEN user_id % 10 <> 0 THEN user_id END AS cell_id FROM events WHERE value >= 10)"

SQL = {
    "qc_metrics": f"WITH {_M} SELECT cell_id, n_genes, round(nucleus_ratio, 12) AS nucleus_ratio, round(density, 9) AS density, round(control_frac, 9) AS control_frac FROM m",
    "qc_flags": f"WITH {_F} SELECT low_counts, low_genes, small, large, control, count(*) AS n FROM f GROUP BY ALL",
    "qc_rule_table": f"WITH {_F}, u AS (SELECT unnest(['low_counts', 'low_genes', 'small', 'large', 'control']) AS rule, unnest([low_counts, low_genes, small, large, control]) AS hit, low_counts::INT + low_genes::INT + small::INT + large::INT + control::INT AS k FROM f) SELECT rule, sum(hit::INT)::BIGINT AS flagged, round(100 * avg(hit::INT::DOUBLE), 6) AS pct, sum((hit AND k = 1)::INT)::BIGINT AS only_this FROM u GROUP BY 1",
    "qc_kept": f"WITH {_F} SELECT lineage, count(*) AS n, sum(n_genes)::BIGINT AS genes FROM f WHERE NOT (low_counts OR low_genes OR small OR large OR control) GROUP BY 1",
    "mad_bounds": f"WITH {TISSUE}, l AS (SELECT cell_type, ln(1 + cell_area) AS v FROM tissue WHERE cell_area IS NOT NULL), md AS (SELECT cell_type, median(v) AS med FROM l GROUP BY 1), mm AS (SELECT cell_type, med, 1.4826 * median(abs(v - med)) AS mad FROM l JOIN md USING (cell_type) GROUP BY 1, 2) SELECT cell_type, round(med, 9) AS med, round(exp(med - 3 * mad) - 1, 6) AS low, round(exp(med + 3 * mad) - 1, 6) AS high FROM mm",
    "fov_assign": f"WITH {_FOV} SELECT space, coalesce(fov, '') AS fov, count(*) AS n FROM w GROUP BY 1, 2",
    "fov_quality": f"WITH {_FOV} SELECT space, fov, cells, median_counts, round(share_20, 9) AS share_20 FROM q",
    "fov_outliers": f"WITH {_FOV}, big AS (SELECT * FROM q WHERE cells >= 200), md AS (SELECT median(median_counts) AS m1, median(share_20) AS m2 FROM big), mm AS (SELECT m1, m2, 1.4826 * median(abs(median_counts - m1)) AS d1, 1.4826 * median(abs(share_20 - m2)) AS d2 FROM big, md GROUP BY 1, 2), z AS (SELECT q.*, CASE WHEN cells >= 200 THEN (median_counts - m1) / nullif(d1, 0) END AS z1, CASE WHEN cells >= 200 THEN (share_20 - m2) / nullif(d2, 0) END AS z2 FROM q, mm) SELECT space, fov, cells, round(z1, 6) AS z_counts, round(z2, 6) AS z_share, coalesce(abs(z1) > 3, false) OR coalesce(abs(z2) > 3, false) AS outlier FROM z",
    "gene_detection": f"WITH {_T}, p AS (SELECT feature, count(*) AS total, avg((cell_id IS NOT NULL)::INT::DOUBLE) AS a FROM t GROUP BY 1) SELECT feature, total, round(total / (SELECT avg(total) FROM p WHERE feature = 'error'), 6) AS fold, round(100 * a, 6) AS pct_assigned FROM p WHERE feature <> 'error'",
    "assigned_fraction": f"WITH {_T} SELECT round(avg((cell_id IS NOT NULL)::INT::DOUBLE), 9) AS assigned, count(*) AS n FROM t WHERE feature <> 'error'",
    "props_metrics": "SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_json, sum(regexp_extract(props, '\"k\":\\s*(\\d+)', 1)::BIGINT)::BIGINT AS k_regex FROM events GROUP BY 1",
    "composition": f"WITH {TISSUE} SELECT lineage, cell_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM tissue GROUP BY 1, 2",
    "log_histogram": f"WITH {CELL} SELECT least(greatest(floor(log10(transcript_counts::DOUBLE) * 20 + 1e-9)::BIGINT, 0), 79) AS bin, count(*) AS n FROM cell WHERE transcript_counts > 0 GROUP BY 1",
    "eligible": f"WITH {ATLAS} SELECT {sql_fold('cell_type_major')} AS label, count(*) AS n FROM atlas WHERE {sql_fold('tissue')} = 'lung' AND {sql_fold('platform')} <> 'smart-seq2' AND {sql_fold('cell_type_major')} <> 'other' AND origin IS NOT NULL GROUP BY 1",
    "sub_cell_summary": f"WITH {TISSUE} SELECT space, count(*) AS cells, sum((transcript_counts >= 10)::INT)::BIGINT AS cells_10, sum(transcript_counts)::BIGINT AS counts, median(transcript_counts) AS median_counts, median(cell_area) AS median_area FROM tissue GROUP BY 1",
}
