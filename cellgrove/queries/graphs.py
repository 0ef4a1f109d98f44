"""The neighbour graph of the cells: Delaunay edges up to 30 µm within each section, and what is read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.operators import stats as st
from cellgrove.operators.neighbours import banded_pairs, both_ways, delaunay_edges
from cellgrove.operators.permutations import space_enrichment
from cellgrove.plans import cut, kept
from cellgrove.queries.base import EDGE_UM, TISSUE, tissue
from cellgrove.queries.sql import fdr, normal_tail

PERMS = 1000  # the reference's number
LEAST_UM, MOST_UM, BANDS = 5.0, 300.0, 24  # the reference's bands
TRAITS = ("transcript_counts", "cell_area", "nucleus_area")


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cells = kept(tissue(spark, folder))
    return cells, cut(delaunay_edges(cells, EDGE_UM))


def tissue_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """For each section, edges from each lineage to each lineage and their share of the first one's edges."""
    cells, edges = _graph(spark, folder)
    a, b = cells.select(F.col("id").alias("src"), F.col("lineage").alias("a")), cells.select(F.col("id").alias("dst"), F.col("lineage").alias("b"))
    n = both_ways(edges).join(a, "src").join(b, "dst").groupBy("space", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.select("space", "a", "b", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("space", "a")), 9).alias("share"))


def tissue_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """For each section, edges per pair of lineages against 1,000 permutations of the lineages within the section."""
    cells, edges = _graph(spark, folder)
    return space_enrichment(edges, cells.select("id", "space", F.col("lineage").alias("value")), PERMS)


def tissue_moran(spark: SparkSession, folder: str) -> DataFrame:
    """Moran's I of counts and areas of all cells on the graph of all sections; missing values are 0."""
    cells, edges = _graph(spark, folder)
    v = cells.select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("gene"), F.col(t).cast("double").alias("value")) for t in TRAITS])).alias("v")).select("id", "v.gene", "v.value").where("not isnan(value)")
    out = st.morans_i(v, both_ways(edges).select("src", "dst"), cells.select("id"))
    return out.select(F.col("gene").alias("trait"), F.round("moran", 8).alias("moran"), F.round("z", 5).alias("z"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def _ratios(spark: SparkSession, folder: str) -> DataFrame:
    n = banded_pairs(tissue(spark, folder).withColumn("label", F.col("lineage")), LEAST_UM, MOST_UM, BANDS)
    return st.band_ratios(n, ["space"])


def tissue_co_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    """For each section, how much likelier a lineage is in 24 bands of distance from another than at large."""
    return _ratios(spark, folder).withColumn("ratio", F.round("ratio", 8))


def tissue_co_occurrence_at(spark: SparkSession, folder: str) -> DataFrame:
    """For each section, the ratio of epithelial cells around three immune lineages in the bands nearest to 20, 100 and 300 µm."""
    bands = _ratios(spark, folder).where((F.col("b") == "Epithelial") & F.col("a").isin("T / NK", "B / plasma", "Myeloid"))
    ends = [LEAST_UM + k * (MOST_UM - LEAST_UM) / BANDS for k in range(BANDS + 1)]
    return st.at_distance(bands, ends, [20, 100, 300], ["space"]).select("space", "a", "wanted", F.round("upto", 6).alias("upto"), F.round("ratio", 8).alias("ratio"))


QUERIES = {f.__name__: f for f in (tissue_interactions, tissue_enrichment, tissue_moran, tissue_co_occurrence, tissue_co_occurrence_at)}

#: edge: as queries.base.EDGES, over the cells of each section.
_EDGES = f"""{TISSUE}, cand AS (SELECT a.space, a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM tissue a JOIN tissue b ON a.space = b.space AND a.id < b.id AND b.x BETWEEN a.x - {EDGE_UM} AND a.x + {EDGE_UM} WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EDGE_UM}),
side AS (SELECT cand.space, src, dst, 2 * ((c.x - (ax + bx) / 2) * -(by_ - ay) + (c.y - (ay + by_) / 2) * (bx - ax)) AS beside, (c.x - (ax + bx) / 2) * (c.x - (ax + bx) / 2) + (c.y - (ay + by_) / 2) * (c.y - (ay + by_) / 2) - ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / 4 AS over_ FROM cand JOIN tissue c ON c.space = cand.space AND c.id <> src AND c.id <> dst),
bound AS (SELECT space, src, dst, coalesce(max(CASE WHEN beside < 0 THEN over_ / beside END), '-inf'::DOUBLE) AS lo, coalesce(min(CASE WHEN beside > 0 THEN over_ / beside END), 'inf'::DOUBLE) AS hi, bool_or(beside = 0 AND over_ < 0) AS between_ FROM side GROUP BY 1, 2, 3),
half AS (SELECT space, src, dst FROM bound WHERE NOT between_ AND lo <= hi + 1e-9 * (1 + abs(hi))),
edge AS (SELECT space, src, dst FROM half UNION ALL SELECT space, dst, src FROM half)"""

_WIDTH = f"({MOST_UM} - {LEAST_UM})::DOUBLE / {BANDS}"
_BANDED = f"""{TISSUE}, pd AS (SELECT a.space, a.lineage AS a, b.lineage AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM tissue a JOIN tissue b ON a.space = b.space AND a.id <> b.id),
bn AS (SELECT space, least({BANDS - 1}, greatest(0, ceil((dist - {LEAST_UM}) / ({_WIDTH})) - 1))::INT AS band, a, b, count(*) AS n FROM pd WHERE dist > {LEAST_UM} AND dist <= {MOST_UM} GROUP BY 1, 2, 3, 4),
rt AS (SELECT *, (n / sum(n) OVER (PARTITION BY space, band, a)) / (sum(n) OVER (PARTITION BY space, band, b) / sum(n) OVER (PARTITION BY space, band)) AS ratio FROM bn)"""

SQL = {
    "tissue_co_occurrence": f"WITH {_BANDED} SELECT space, band, a, b, n, round(ratio, 8) AS ratio FROM rt",
    "tissue_co_occurrence_at": f"WITH {_BANDED}, w AS (SELECT unnest([20.0, 100.0, 300.0])::DOUBLE AS wanted), e AS (SELECT space, a, wanted, ratio, {LEAST_UM} + (band + 1) * {_WIDTH} AS upto FROM rt, w WHERE b = 'Epithelial' AND a IN ('T / NK', 'B / plasma', 'Myeloid')) SELECT space, a, wanted, round(upto, 6) AS upto, round(ratio, 8) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY space, a, wanted ORDER BY abs(upto - wanted), upto) AS rn FROM e) WHERE rn = 1",
    "tissue_interactions": f"WITH {_EDGES} SELECT edge.space, a.lineage AS a, b.lineage AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY edge.space, a.lineage), 9) AS share FROM edge JOIN tissue a ON a.id = src JOIN tissue b ON b.id = dst GROUP BY 1, 2, 3",
    "tissue_moran": f"WITH {_EDGES}, w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM edge), every AS (UNPIVOT (SELECT id, {', '.join(f'CASE WHEN isnan({t}) THEN 0 ELSE coalesce({t}, 0) END::DOUBLE AS {t}' for t in TRAITS)} FROM tissue) ON {', '.join(TRAITS)} INTO NAME trait VALUE value), z AS (SELECT id, trait, value - avg(value) OVER (PARTITION BY trait) AS z FROM every), top AS (SELECT a.trait, sum(w * a.z * b.z) AS t FROM w JOIN z a ON a.id = src JOIN z b ON b.id = dst AND b.trait = a.trait GROUP BY 1), zz AS (SELECT trait, sum(z * z) AS zz, count(*)::DOUBLE AS n FROM z GROUP BY 1), s0 AS (SELECT sum(w) AS s0 FROM w), s1 AS (SELECT sum((a.w + b.w) ** 2) / 2 AS s1 FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src), s2 AS (SELECT sum(s * s) AS s2 FROM (SELECT i, sum(w) AS s FROM (SELECT src AS i, w FROM w UNION ALL SELECT dst, w FROM w) GROUP BY 1)), mo AS (SELECT trait, n / s0 * t / nullif(zz, 0) AS moran, -1 / (n - 1) AS ex, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) AS v FROM top JOIN zz USING (trait), s0, s1, s2), mz AS (SELECT trait, moran, (moran - ex) / sqrt(v - ex * ex) AS z FROM mo), mp AS (SELECT *, {normal_tail('abs(z)')} AS p FROM mz), mq AS ({fdr('mp')}) SELECT trait, round(moran, 8) AS moran, round(z, 5) AS z, round(p, 9) AS p, round(q, 9) AS q FROM mq",
}
