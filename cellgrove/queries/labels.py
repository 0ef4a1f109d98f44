"""Label tables, verdicts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.functions import fold, tile
from cellgrove.operators import labels as lb
from cellgrove.operators import matrix as mx
from cellgrove.plans import kept
from cellgrove.queries.base import TISSUE, order_cells, order_genes, tissue
from cellgrove.queries.sql import CELL
from cellgrove.queries.sql import fold as sql_fold
from cellgrove.sources.tables import read, typed_cells


def apply_coarse(spark, d):
    """Cells whose folded label is in the label table, with its type and lineage, counted."""
    table = read(spark, d, "type_labels").select(F.col("raw_label").alias("cluster"), "cell_type", "lineage")
    c = typed_cells(spark, d, ["cell_type"], kinds=()).select(fold("cell_type").alias("cluster"))
    known = c.join(table.select("cluster"), "cluster", "left_semi")
    return lb.apply_coarse(known, "cluster", table).groupBy("cell_type", "lineage").agg(F.count(F.lit(1)).alias("n"))


def time_types(spark, d):
    """Cells per tumour-immune type, all others as other."""
    types = [r[0] for r in read(spark, d, "type_labels").where("in_time_types").select("cell_type").distinct().collect()]  # a fixed label table
    return tissue(spark, d).groupBy(lb.listed_or_other(F.col("cell_type"), types).alias("time_type")).agg(F.count(F.lit(1)).alias("n"))


def merge_labels(spark, d):
    """Coarse labels (cell_type) overlaid by the fine ones (time_type) and their lineages."""
    c = kept(typed_cells(spark, d, ["time_type", "lineage", "annotation_confidence"], kinds=("type", "type_lineage")))
    coarse = c.select(F.col("cell_id").alias("id"), F.col("type").alias("cell_type"), "lineage", F.col("annotation_confidence").alias("conf"))
    fine = c.where("time_type is not null").select(F.col("cell_id").alias("id"), fold("time_type").alias("fine_type"), F.lit("high").alias("fine_conf"), (F.col("type_lineage") == "Myeloid").alias("from_subset"))
    over = read(spark, d, "type_labels").select(F.col("raw_label").alias("cell_type"), "lineage")
    return lb.merge_labels(coarse, fine, over).groupBy("lineage", "conf").agg(F.count(F.lit(1)).alias("n"))


def role_selection(spark, d):
    """The section richest in each lineage, among those with at least 100 cells of it; ties to the smaller section."""
    n = tissue(spark, d).groupBy("lineage", "space").agg(F.count(F.lit(1)).alias("n"))
    return lb.best_of(n.where("n >= 100"), ["lineage"], F.col("n"), ["space"]).select("lineage", "space", "n")


def histology_windows(spark, d):
    """In each section the 150 µm tile with most of the rarer of epithelial and stromal cells."""
    t = tissue(spark, d).groupBy("space", tile("x", 150).alias("tx"), tile("y", 150).alias("ty")).agg(F.sum((F.col("lineage") == "Epithelial").cast("bigint")).alias("e"), F.sum((F.col("lineage") == "Stromal").cast("bigint")).alias("s"))
    return lb.best_of(t, ["space"], F.least("e", "s"), ["tx", "ty"])


def head_and_tail(spark, d):
    """The eight sections with the fewest and the eight with the most cells."""
    n = tissue(spark, d).groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    return lb.head_and_tail(kept(n), "n", "space", 8)


def verdict_table(spark, d):
    """Fixed threshold rules over one-row figures."""
    t = tissue(spark, d)
    f = t.agg(F.avg(F.col("is_tumour").cast("double")).alias("tumour"), F.avg((F.col("transcript_counts") >= 50).cast("double")).alias("deep"))
    rules = [("mostly tumour", "tumour", 0.5, "yes", "no"), ("deeply sequenced", "deep", 0.3, "confirmed", "weaker")]
    return lb.verdicts(f, rules).select("question", F.round("figure", 9).alias("figure"), "verdict")


def score_gene_set(spark, d):
    """Mean score of two gene sets against control genes of like expression, per group of orders."""
    x = kept(mx.log_normalised(order_genes(spark, d)))
    c = kept(order_cells(spark, d).select("cell_id", "lineage"))
    sets = spark.createDataFrame([("one", "Brand#11"), ("one", "Brand#12"), ("one", "Brand#13"), ("two", "Brand#4"), ("two", "Brand#22"), ("gone", "nothing")], "name string, gene string")
    s = mx.gene_set_scores(x, c, sets, bins=3, controls=2)
    return s.join(c, "cell_id").groupBy("name", "lineage").agg(F.round(F.avg("score"), 9).alias("score"), F.count(F.lit(1)).alias("n"))


def raw_fields(spark, d):
    """Lineage as recorded against lineage by type, for every current cell (chained left joins of label tables)."""
    c = typed_cells(spark, d, ["lineage", "niche"], kinds=("type_lineage",))
    return c.groupBy(F.coalesce("lineage", F.lit("none")).alias("recorded"), F.coalesce("type_lineage", F.lit("none")).alias("by_type")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (apply_coarse, time_types, merge_labels, role_selection, histology_windows, head_and_tail, verdict_table, score_gene_set, raw_fields)}

SQL = {
    "apply_coarse": f"WITH {CELL} SELECT t.cell_type, t.lineage, count(*) AS n FROM cell c JOIN type_labels t ON t.raw_label = {sql_fold('c.cell_type')} GROUP BY 1, 2",
    "time_types": f"WITH {TISSUE} SELECT CASE WHEN in_time_types THEN cell_type ELSE 'other' END AS time_type, count(*) AS n FROM tissue GROUP BY 1",
    "merge_labels": f"WITH {CELL}, m AS (SELECT CASE WHEN time_type IS NOT NULL AND coalesce(lin = 'Myeloid', false) THEN 'Myeloid' ELSE coalesce(t.lineage, c.lineage) END AS lineage, CASE WHEN time_type IS NOT NULL THEN 'high' ELSE annotation_confidence END AS conf FROM cell c LEFT JOIN type_labels t ON t.raw_label = coalesce({sql_fold('c.time_type')}, typ)) SELECT lineage, conf, count(*) AS n FROM m GROUP BY 1, 2",
    "role_selection": f"WITH {TISSUE}, n AS (SELECT lineage, space, count(*) AS n FROM tissue GROUP BY 1, 2 HAVING count(*) >= 100) SELECT lineage, space, n FROM (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY n DESC, space) AS rn FROM n) WHERE rn = 1",
    "histology_windows": f"WITH {TISSUE}, t AS (SELECT space, floor(x / 150)::BIGINT AS tx, floor(y / 150)::BIGINT AS ty, sum((lineage = 'Epithelial')::INT)::BIGINT AS e, sum((lineage = 'Stromal')::INT)::BIGINT AS s FROM tissue GROUP BY 1, 2, 3) SELECT space, tx, ty, e, s FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY least(e, s) DESC, tx, ty) AS rn FROM t) WHERE rn = 1",
    "head_and_tail": f"WITH {TISSUE}, n AS (SELECT space, count(*) AS n, row_number() OVER (ORDER BY count(*), space) AS a, row_number() OVER (ORDER BY count(*) DESC, space) AS b FROM tissue GROUP BY 1) SELECT space, n FROM n WHERE a <= 8 OR b <= 8",
    "verdict_table": f"WITH {TISSUE}, f AS (SELECT avg(is_tumour::INT::DOUBLE) AS t, avg((transcript_counts >= 50)::INT::DOUBLE) AS d FROM tissue) SELECT 'mostly tumour' AS question, round(t, 9) AS figure, CASE WHEN t >= 0.5 THEN 'yes' ELSE 'no' END AS verdict FROM f UNION ALL SELECT 'deeply sequenced', round(d, 9), CASE WHEN d >= 0.3 THEN 'confirmed' ELSE 'weaker' END FROM f",
    "raw_fields": f"WITH {CELL} SELECT coalesce(lineage, 'none') AS recorded, coalesce(lin, 'none') AS by_type, count(*) AS n FROM cell GROUP BY 1, 2",
}
