"""Canonical tables of the reference queries and the SQL that makes the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.functions import fold
from cellgrove.operators.neighbours import both_ways, delaunay_edges, nearest
from cellgrove.plans import cut, kept
from cellgrove.queries.sql import CELL
from cellgrove.queries.sql import fold as sql_fold
from cellgrove.sources.tables import read, typed_cells

EDGE_UM = 30.0


def tissue(spark: SparkSession, folder: str) -> DataFrame:
    """Confidently annotated cells of known type with a position: one row per cell."""
    df = typed_cells(spark, folder, ["cell_area", "nucleus_area", "transcript_counts", "niche", "annotation_confidence"], position=True)
    df = df.where((fold("annotation_confidence") == "high") & F.col("type").isNotNull() & F.col("x_um").isNotNull() & F.col("section_id").isNotNull())
    return df.select(F.col("cell_id").alias("id"), F.col("section_id").alias("space"), F.col("x_um").alias("x"), F.col("y_um").alias("y"), F.col("type").alias("cell_type"), F.col("type_lineage").alias("lineage"), "is_tumour", "in_time_types", "cell_area", "nucleus_area", "transcript_counts", "niche")


TISSUE = f"{CELL}, tissue AS (SELECT cell_id AS id, section_id AS space, xu AS x, yu AS y, typ AS cell_type, lin AS lineage, tum AS is_tumour, tt AS in_time_types, cell_area, nucleus_area, transcript_counts, niche FROM cell WHERE {sql_fold('annotation_confidence')} = 'high' AND typ IS NOT NULL AND xu IS NOT NULL AND section_id IS NOT NULL)"


def with_distance(cells: DataFrame, tumour: DataFrame | None = None) -> DataFrame:
    """Adds d: the distance to the nearest tumour cell of the section, of those in tumour or else in cells."""
    if tumour is None:
        cells = kept(cells)
        tumour = cells.where("is_tumour")
    # a tumour cell is its own nearest: only the others are looked for
    d = nearest(cells.where("not coalesce(is_tumour, false)"), tumour).select("id", F.col("dist").alias("d"))
    itself = F.when(F.col("is_tumour"), F.lit(0.0)).otherwise(F.col("d"))
    return cells.join(d, "id", "left").withColumn("d", itself)


DISTANCE = f"{TISSUE}, far AS (SELECT a.*, (SELECT min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) FROM tissue b WHERE b.space = a.space AND b.is_tumour) AS d FROM tissue a)"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A second set of points, one per vector: x, y from its first two components, a label and a lineage."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("space"), (1000 * e(0)).alias("x"), (1000 * e(1)).alias("y"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("cell_type"), F.concat(F.lit("l"), (F.col("label") % 4).cast("string")).alias("lineage"), (F.col("label") == 0).alias("is_tumour"))


def vector_genes(spark: SparkSession, folder: str) -> DataFrame:
    """id, gene, cnt: sparse counts of those points, from all 64 components."""
    g = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("gene", "v"))
    return g.select("id", F.concat(F.lit("g"), F.col("gene").cast("string")).alias("gene"), F.greatest(F.floor(20 * F.col("v").cast("double")), F.lit(0)).cast("double").alias("cnt")).where("cnt > 0")


VECTORS = """vec AS (SELECT vec_id AS id, 'all' AS space, 1000 * embedding[1]::DOUBLE AS x, 1000 * embedding[2]::DOUBLE AS y, 't' || label AS cell_type, 'l' || (label % 4) AS lineage, label = 0 AS is_tumour FROM embeddings),
vgene AS (SELECT * FROM (SELECT vec_id AS id, 'g' || (i - 1) AS gene, greatest(floor(20 * embedding[i]::DOUBLE), 0)::DOUBLE AS cnt FROM embeddings, range(1, 65) r(i)) WHERE cnt > 0)"""


def vector_edges(spark: SparkSession, folder: str) -> DataFrame:
    return cut(both_ways(delaunay_edges(vectors(spark, folder), EDGE_UM)))


#: edge: Delaunay edges up to 30 µm in both directions, by the same empty-circle bounds over all points.
EDGES = f"""{VECTORS}, cand AS (SELECT a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM vec a JOIN vec b ON a.id < b.id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EDGE_UM}),
side AS (SELECT src, dst, dist, 2 * ((c.x - (ax + bx) / 2) * -(by_ - ay) + (c.y - (ay + by_) / 2) * (bx - ax)) AS beside, (c.x - (ax + bx) / 2) * (c.x - (ax + bx) / 2) + (c.y - (ay + by_) / 2) * (c.y - (ay + by_) / 2) - ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / 4 AS over_ FROM cand JOIN vec c ON c.id <> src AND c.id <> dst),
bound AS (SELECT src, dst, dist, coalesce(max(CASE WHEN beside < 0 THEN over_ / beside END), '-inf'::DOUBLE) AS lo, coalesce(min(CASE WHEN beside > 0 THEN over_ / beside END), 'inf'::DOUBLE) AS hi, bool_or(beside = 0 AND over_ < 0) AS between_ FROM side GROUP BY 1, 2, 3),
half AS (SELECT src, dst, dist FROM bound WHERE NOT between_ AND lo <= hi + 1e-9 * (1 + abs(hi))),
edge AS (SELECT src, dst, dist FROM half UNION ALL SELECT dst, src, dist FROM half)"""


def order_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as cells: total and control counts, area, and the group, block and domain they fall in."""
    line = read(spark, folder, "lineitem").join(read(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = line.groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.sum("l_quantity").alias("transcript_counts"), F.sum(F.when(F.col("p_type").startswith("PROMO"), F.col("l_quantity")).otherwise(0.0)).alias("control_counts"), F.sum("l_extendedprice").alias("cell_area"), F.max("l_tax").alias("nucleus_area"))
    o = read(spark, folder, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("lineage"), F.concat(F.lit("b"), (F.col("o_custkey") % 12).cast("string")).alias("block"), F.col("o_orderstatus").alias("domain"))
    return per.join(o, "cell_id")


def order_genes(spark: SparkSession, folder: str, least: int = 0) -> DataFrame:
    """cell_id, gene, cnt: quantity of each brand in an order, of lines with at least so many items."""
    line = read(spark, folder, "lineitem").where(F.col("l_quantity") >= least).select("l_orderkey", "l_partkey", "l_quantity").join(read(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return line.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("cnt"))


ORDERS = """ocell AS (SELECT l_orderkey AS cell_id, sum(l_quantity) AS transcript_counts, sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_quantity ELSE 0.0 END) AS control_counts, sum(l_extendedprice) AS cell_area, max(l_tax) AS nucleus_area, any_value(o_orderpriority) AS lineage, 'b' || (any_value(o_custkey) % 12) AS block, any_value(o_orderstatus) AS domain FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
ogene AS (SELECT l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def segmented(spark: SparkSession, folder: str) -> DataFrame:
    """cell_id, seg, gene, cnt: one id space (suppliers) counted in two ways (line status O and F)."""
    line = read(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_linestatus").join(read(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return line.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_linestatus").alias("seg"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("cnt"))


SEGMENTED = """segm AS (SELECT l_suppkey AS cell_id, l_linestatus AS seg, p_brand AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
