"""Queries on cells in tissue: distances, neighbours, tiles, niches, aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrove.functions import tile
from cellgrove.operators import neighbours as nb
from cellgrove.operators import stats as st
from cellgrove.operators import tissue as ts
from cellgrove.plans import cut, kept, quantiles
from cellgrove.queries.sql import chi2_tail, fdr
from cellgrove.queries.base import DISTANCE, EDGES, TISSUE, tissue, vector_edges, vectors, with_distance

EPS, LEAST_B, K = 30.0, 8, 3


def infiltration(spark, d):
    """Which types keep away from tumour cells."""
    return ts.infiltration(with_distance(tissue(spark, d)), F.col("in_time_types") | (F.col("cell_type") == "Fibroblast"))


def distance_to_tumour(spark, d):
    """Distance of every cell to the nearest tumour cell of its section."""
    return with_distance(tissue(spark, d)).select("id", F.round("d", 6).alias("d"))


def exclusion_on_positions(spark, d):
    """Median distance and contact share of three types, with the baseline over all non-tumour cells."""
    c = kept(with_distance(tissue(spark, d)).where("not is_tumour and d is not null"))
    show = c.where(F.col("cell_type").isin("CD8 T (GZMK+)", "CD163+ macrophage", "Fibroblast"))
    each = show.unionByName(c.withColumn("cell_type", F.lit("baseline")))
    each = kept(each.select("cell_type", "d"))
    near = each.groupBy("cell_type").agg(F.round(100 * F.avg((F.col("d") <= 15).cast("double")), 6).alias("pct_contact"))
    return quantiles(each, ["cell_type"], "d", {"m": 0.5}).join(near, "cell_type").select("cell_type", F.round("m", 6).alias("median_um"), "pct_contact")


def radius_neighbours(spark, d):
    """Number of neighbours within 15 µm of each cell, itself included."""
    c = kept(tissue(spark, d).select("id", "space", "x", "y"))  # no other column is shuffled
    return nb.radius_pairs(c, c, 15.0).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def niche_composition(spark, d):
    """Lineage mix within 50 µm of each cell, itself included."""
    c = kept(tissue(spark, d).withColumn("label", F.col("lineage")))
    return nb.neighbour_shares(c, 50.0, itself=True).select("id", F.col("label").alias("lineage"), "n", F.round("share", 9).alias("share"))


def neighbourhood_composition_excl(spark, d):
    """Lineage mix within 30 µm of each cell, itself excluded."""
    c = kept(tissue(spark, d).withColumn("label", F.col("lineage")))
    return nb.neighbour_shares(c, 30.0, itself=False).select("id", F.col("label").alias("lineage"), "n", F.round("share", 9).alias("share"))


def neighbourhood_mean(spark, d):
    """Mean transcript count among the cells within 30 µm, itself included."""
    c = kept(tissue(spark, d))
    v = c.select("id", F.lit("transcripts").alias("gene"), F.col("transcript_counts").cast("double").alias("value")).where("value is not null")
    return nb.neighbour_mean(c, v, 30.0).select("id", F.round("mean", 6).alias("mean"))


def knn_spatial(spark, d):
    """The three nearest other cells of each cell."""
    return nb.nearest_k(tissue(spark, d), K).select("src", "dst", F.col("rank").cast("int").alias("rank"), F.round("dist", 6).alias("dist"))


def delaunay_edges(spark, d):
    """Delaunay edges up to 30 µm, both directions."""
    return vector_edges(spark, d).select("src", "dst", F.round("dist", 6).alias("dist"))


def graph_stats(spark, d):
    """Edge entries, median length, mean degree and isolated points of the graph."""
    e, n = vector_edges(spark, d), vectors(spark, d)
    deg = n.select("id").join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    a = deg.agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("deg"), 6).alias("mean_degree"), F.sum((F.col("deg") == 0).cast("bigint")).alias("isolated"))
    a = a.join(quantiles(deg, [], "deg", {"median_degree": 0.5}))  # one row each, here and below
    return a.join(e.agg(F.count(F.lit(1)).alias("entries"))).join(quantiles(e, [], "dist", {"m": 0.5})).withColumn("median_um", F.round("m", 6)).drop("m")


def khop_rings(spark, d):
    """Points first reached after one, two and three edges, counted per point and ring."""
    return nb.rings(vector_edges(spark, d), 3).groupBy("src", "layer").agg(F.count(F.lit(1)).alias("n"))


def dbscan_aggregates(spark, d):
    """Dense aggregates of B cells: each member's aggregate, named by its smallest core cell."""
    b = tissue(spark, d).where("cell_type = 'B cell'")
    return nb.dense_aggregates(b, EPS, LEAST_B).select("id", "cluster")


def aggregate_table(spark, d):
    """Centre, radius and composition of each aggregate with its rim."""
    c = tissue(spark, d).select("id", "space", "x", "y", "cell_type", "lineage", "is_tumour")  # no other column is shuffled
    _, t = ts.aggregates(kept(c), "B cell", EPS, LEAST_B)
    return t.select("space", F.col("n_core"), F.round("cx", 8).alias("cx"), F.round("cy", 8).alias("cy"), F.round("radius", 8).alias("radius"), "cells", "pct_core", "pct_t_nk", "pct_tumour")


def _with_aggregates(spark, d, *also, far=True, types=None):
    """Cells with the aggregate that holds them and, with far, their distance to the nearest tumour cell: of the given
    types only, if any are named. No other columns than the operators need and those in also are shuffled."""
    c = kept(tissue(spark, d).select("id", "space", "x", "y", "cell_type", "lineage", "is_tumour", *also))
    members, _ = ts.aggregates(c, "B cell", EPS, LEAST_B)
    shown = c if types is None else c.where(F.col("cell_type").isin(types))
    shown = with_distance(shown, c.where("is_tumour")) if far else shown
    return shown.join(members, "id", "left").withColumn("in_aggregate", F.col("aggregate").isNotNull())


def compartments(spark, d):
    """Cells of each type per compartment."""
    c = _with_aggregates(spark, d).withColumn("compartment", ts.compartment(F.col("d"), F.col("in_aggregate")))
    return c.groupBy("compartment", "cell_type").agg(F.count(F.lit(1)).alias("n"))


def ratio_by_band(spark, d):
    """CD8 to CD163+ macrophage ratio per distance band."""
    c = _with_aggregates(spark, d, types=["CD8 T (GZMK+)", "CD163+ macrophage"])  # no other type counts
    return ts.ratio_by_band(c, "CD8 T (GZMK+)", "CD163+ macrophage").withColumn("value", F.round("value", 9))


#: Traits of a cell that stand for genes here: the tables hold no counts of cells.
STATES = {"rich": "transcript_counts >= 60", "large": "cell_area >= 80", "round": "nucleus_area >= 0.4 * cell_area"}


def cd8_states(spark, d):
    """Percentage of CD8 cells with each trait per compartment, with the chi-square test across compartments."""
    c = _with_aggregates(spark, d, "cell_area", "nucleus_area", "transcript_counts", types=["CD8 T (GZMK+)"]).withColumn("a", ts.compartment(F.col("d"), F.col("in_aggregate")))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("state"), F.coalesce(F.expr(v), F.lit(False)).alias("b")) for k, v in STATES.items()]))
    n = kept(c.select("a", rows.alias("r")).groupBy("r.state", "a", "r.b").agg(F.count(F.lit(1)).alias("n")))
    places = n.select("state", "a").distinct().withColumn("b", F.explode(F.array(F.lit(False), F.lit(True))))
    full = places.join(n, ["state", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    test = st.benjamini_hochberg(st.chi_square(full, ["state"]), "p")
    pct = full.groupBy("state", "a").agg((100.0 * F.sum(F.when(F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("pct"))
    return pct.join(test, "state").select("state", F.col("a").alias("compartment"), F.round("pct", 6).alias("pct"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


TILE, LEAST_TUMOUR = 100.0, 10


def _tiles(spark, d):
    return ts.tumour_tiles(with_distance(tissue(spark, d)), "CD8 T (GZMK+)", TILE, LEAST_TUMOUR).withColumn("phenotype", ts.phenotype())


def tile_phenotypes(spark, d):
    """Tumour tiles with the densities of CD8 cells inside and outside, and their phenotype."""
    return _tiles(spark, d).select("space", "tx", "ty", "tumour", "intra", "stroma", "programme", *[F.round(c, 4).alias(c) for c in ("intra_density", "stroma_density", "total_density")], "phenotype")


def phenotype_by_programme(spark, d):
    """Phenotype percentages by tumour programme, with a row for all tiles."""
    return ts.phenotype_by_programme(_tiles(spark, d))


def phenotype_sensitivity(spark, d):
    """Phenotype percentages under nine pairs of cutoffs."""
    return ts.sensitivity(_tiles(spark, d))


def tile_labels(spark, d):
    """Every cell with the phenotype of its tile, or "not scored"."""
    c = tissue(spark, d).select("id", "space", tile("x", TILE).alias("tx"), tile("y", TILE).alias("ty"))
    return c.join(_tiles(spark, d).select("space", "tx", "ty", "phenotype"), ["space", "tx", "ty"], "left").groupBy("space", F.coalesce("phenotype", F.lit("not scored")).alias("phenotype")).agg(F.count(F.lit(1)).alias("n"))


def densest_contact_tile(spark, d):
    """In each section the 120 µm tile with most of the rarer of tumour and CD8 cells; ties to the smaller tile."""
    c = tissue(spark, d).groupBy("space", tile("x", 120).alias("tx"), tile("y", 120).alias("ty")).agg(F.sum(F.col("is_tumour").cast("bigint")).alias("a"), F.sum((F.col("cell_type") == "CD8 T (GZMK+)").cast("bigint")).alias("b"))
    best = c.groupBy("space").agg(F.max(F.struct(F.least("a", "b").alias("n"), (-F.col("tx")).alias("x"), (-F.col("ty")).alias("y"))).alias("m"))
    return best.select("space", (-F.col("m.x")).alias("tx"), (-F.col("m.y")).alias("ty"), F.col("m.n").alias("n"))


def tiles_and_majority(spark, d):
    """Tiles of 50 µm with at least 5 cells: centre and most frequent lineage, ties to the smaller name."""
    c = tissue(spark, d).groupBy("space", tile("x", 50).alias("tx"), tile("y", 50).alias("ty"), "lineage").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("space", "tx", "ty")
    c = c.withColumns({"cells": F.sum("n").over(w), "rn": F.row_number().over(w.orderBy(F.col("n").desc(), "lineage"))}).where("rn = 1 and cells >= 5")
    return c.select("space", "tx", "ty", (50.0 * F.col("tx") + 25).alias("x"), (50.0 * F.col("ty") + 25).alias("y"), "cells", "lineage")


def tile_index(spark, d):
    """Cells per dense number of their 50 µm tile, tiles of at least 5 cells numbered in order, -1 for the others."""
    c = kept(tissue(spark, d).select("id", "space", tile("x", 50).alias("tx"), tile("y", 50).alias("ty")))
    return ts.tile_numbers(c, 5).groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def domain_mix(spark, d):
    """Tumour types of each section with their share and median depth (distance to the nearest other cell)."""
    c = kept(tissue(spark, d))
    n = nb.nearest(c.where("is_tumour"), c.where("not is_tumour")).join(c.select("id", "space", "cell_type"), "id")
    n = kept(n.select("space", "cell_type", "dist"))
    share = n.groupBy("space", "cell_type").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("space")))
    return share.join(quantiles(n, ["space", "cell_type"], "dist", {"m": 0.5}), ["space", "cell_type"], "left").select("space", "cell_type", "n", F.round("pct", 6).alias("pct"), F.round("m", 6).alias("depth_um"))


def viewer_export(spark, d):
    """Every placed cell with its niche and aggregate, none where it has none."""
    c = _with_aggregates(spark, d, "niche", far=False)
    return c.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "cell_type", F.coalesce("niche", F.lit("none")).alias("niche"), F.when(F.col("in_aggregate"), "aggregate").otherwise("none").alias("place"))


def blocks(spark, d):
    """Cells per spatial block of 200 µm."""
    return tissue(spark, d).groupBy("space", F.concat(F.lit("b"), tile("x", 200).cast("string"), F.lit("_"), tile("y", 200).cast("string")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


def bbox_window(spark, d):
    """Cells strictly inside a window, per type."""
    return tissue(spark, d).where("x > 50 and x < 250 and y > 50 and y < 250").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


def depth_in_nest(spark, d):
    """For tumour cells the median distance to the nearest non-tumour cell, per type and section."""
    c = kept(tissue(spark, d))
    n = nb.nearest(c.where("is_tumour"), c.where("not is_tumour")).join(c.select("id", "space", "cell_type"), "id")
    n, by = kept(n.select("space", "cell_type", "dist")), ["space", "cell_type"]
    q = quantiles(n, by, "dist", {"m": 0.5, "p": 0.9})
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(q, by, "left").select(*by, "n", F.round("m", 6).alias("depth_um"), F.round("p", 6).alias("p90_um"))


def name_domains(spark, d):
    """A name for each section by its leading lineages, and its number by falling epithelial share."""
    from cellgrove.plans import ranked

    n = tissue(spark, d).groupBy("space", F.col("lineage").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("space").agg(F.sum("n").alias("t"))
    s = kept(n.join(total, "space").select("space", "label", (F.col("n") / F.col("t")).alias("share")))
    names = ts.two_names(s, "space", 2.0, 0.15)
    epi = s.groupBy("space").agg(F.max(F.when(F.col("label") == "Epithelial", F.col("share")).otherwise(0.0)).alias("epi"))
    order = ranked(epi, [], [F.col("epi").desc(), F.col("space")], "rank")
    return cut(names).join(order, "space").select("space", F.concat(F.lit("D"), F.col("rank").cast("string"), F.lit(": "), F.col("name")).alias("name"))


QUERIES = {f.__name__: f for f in (infiltration, distance_to_tumour, exclusion_on_positions, radius_neighbours, niche_composition, neighbourhood_composition_excl, neighbourhood_mean, knn_spatial, delaunay_edges, graph_stats, khop_rings, dbscan_aggregates, aggregate_table, compartments, cd8_states, tile_index, domain_mix, viewer_export, ratio_by_band, tile_phenotypes, phenotype_by_programme, phenotype_sensitivity, tile_labels, densest_contact_tile, tiles_and_majority, blocks, bbox_window, depth_in_nest, name_domains)}

_D2 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_NEAR = lambda r: f"near AS (SELECT a.id AS src, b.id AS dst, b.lineage, b.transcript_counts FROM tissue a JOIN tissue b ON a.space = b.space AND b.x BETWEEN a.x - {r} - 1 AND a.x + {r} + 1 WHERE {_D2} <= {r})"
_DBSCAN = f"""bcell AS (SELECT * FROM tissue WHERE cell_type = 'B cell'), bnear AS (SELECT a.id AS src, b.id AS dst FROM bcell a JOIN bcell b ON a.space = b.space WHERE {_D2} <= {EPS}),
core AS (SELECT src AS id FROM bnear GROUP BY 1 HAVING count(*) >= {LEAST_B}), link AS (SELECT src, dst FROM bnear WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.dst FROM reach r JOIN link l ON l.src = r.b),
corelab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1),
dbscan AS (SELECT id, cluster FROM corelab UNION ALL SELECT n.src, min(c.cluster) FROM bnear n JOIN corelab c ON c.id = n.dst WHERE n.src NOT IN (SELECT id FROM core) GROUP BY 1)"""
_CIRCLE = f"""{_DBSCAN}, centre AS (SELECT space, cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS n_core FROM bcell JOIN dbscan USING (id) GROUP BY 1, 2),
circle AS (SELECT c.space, cluster, cx, cy, n_core, quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 0.9) + 20 AS radius FROM bcell JOIN dbscan USING (id) JOIN centre c USING (space, cluster) GROUP BY 1, 2, 3, 4, 5),
held AS (SELECT t.*, n_core, cx, cy, radius, cluster FROM tissue t JOIN circle c ON t.space = c.space WHERE sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= radius)"""
_BANDED = f"{DISTANCE}, {_CIRCLE}, banded AS (SELECT f.*, id IN (SELECT id FROM held) AS agg FROM far f)"
_TILED = f"""{DISTANCE}, tiled AS (SELECT *, floor(x / {TILE})::BIGINT AS tx, floor(y / {TILE})::BIGINT AS ty FROM far),
t0 AS (SELECT space, tx, ty, sum(is_tumour::INT)::BIGINT AS tumour, sum((cell_type = 'CD8 T (GZMK+)' AND coalesce(d <= 15, false))::INT)::BIGINT AS intra, sum((cell_type = 'CD8 T (GZMK+)' AND coalesce(d > 15, false))::INT)::BIGINT AS stroma, sum(CASE WHEN is_tumour THEN coalesce(cell_area, 0) ELSE 0 END) / 1e6 AS am, sum(CASE WHEN NOT is_tumour THEN coalesce(cell_area, 0) ELSE 0 END) / 1e6 AS bm FROM tiled GROUP BY 1, 2, 3 HAVING sum(is_tumour::INT) >= {LEAST_TUMOUR}),
pr AS (SELECT space, tx, ty, cell_type AS programme FROM (SELECT space, tx, ty, cell_type, row_number() OVER (PARTITION BY space, tx, ty ORDER BY count(*) DESC, cell_type) AS rn FROM tiled WHERE is_tumour GROUP BY 1, 2, 3, 4) WHERE rn = 1),
t1 AS (SELECT t0.*, programme, intra / nullif(am, 0) AS intra_density, stroma / greatest(bm, 1e-9) AS stroma_density, (intra + stroma) / nullif(am + bm, 0) AS total_density FROM t0 JOIN pr USING (space, tx, ty)),
t2 AS (SELECT *, CASE WHEN total_density < 50 THEN 'desert' WHEN intra_density >= 0.5 * stroma_density THEN 'inflamed' ELSE 'excluded' END AS phenotype FROM t1)"""
_PCT3 = ", ".join(f"round(100 * avg((phenotype = '{p}')::INT::DOUBLE), 6) AS {p}" for p in ts.PHENOTYPES)
_BAND = "CASE WHEN agg THEN 'aggregate' WHEN d <= 15 THEN '<= 15 um' WHEN d <= 50 THEN '15-50 um' WHEN d <= 100 THEN '50-100 um' ELSE '> 100 um' END"
_INF = "avg((d <= 15)::INT::DOUBLE)"

_STATES = " UNION ALL ".join(f"SELECT '{k}' AS state, comp AS a, coalesce({v}, false) AS b FROM cd8" for k, v in STATES.items())

SQL = {
    "cd8_states": f"WITH RECURSIVE {_BANDED}, cd8 AS (SELECT *, CASE WHEN agg THEN 'aggregate' WHEN d <= 15 THEN 'tumour contact' WHEN d <= 50 THEN 'border' ELSE 'stroma' END AS comp FROM banded WHERE cell_type = 'CD8 T (GZMK+)'), st AS ({_STATES}), c AS (SELECT state, a, count(*) FILTER (WHERE b) AS y, count(*) FILTER (WHERE NOT b) AS no FROM st GROUP BY 1, 2), u AS (SELECT state, a, unnest([y, no]) AS n, unnest([true, false]) AS b FROM c), e AS (SELECT *, (sum(n) OVER (PARTITION BY state, a))::DOUBLE * sum(n) OVER (PARTITION BY state, b) / sum(n) OVER (PARTITION BY state) AS e FROM u), x AS (SELECT state, CASE WHEN min(e) > 0 AND count(DISTINCT a) > 1 THEN sum((n - e) * (n - e) / nullif(e, 0)) END AS chi2, count(DISTINCT a) - 1 AS dof FROM e GROUP BY 1), p AS (SELECT state, coalesce({chi2_tail('chi2', 'dof')}, 1) AS p FROM x), q AS ({fdr('p')}) SELECT c.state, a AS compartment, round(100.0::DOUBLE * y / (y + no), 6) AS pct, round(p, 9) AS p, round(q, 9) AS q FROM c JOIN q ON q.state = c.state",
    "tile_index": f"WITH {TISSUE}, c AS (SELECT id, space, floor(x / 50)::BIGINT AS tx, floor(y / 50)::BIGINT AS ty FROM tissue), k AS (SELECT space, tx, ty, row_number() OVER (ORDER BY space, tx, ty) - 1 AS number FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT coalesce(number, -1) AS number, count(*) AS n, min(id) AS first FROM c LEFT JOIN k USING (space, tx, ty) GROUP BY 1",
    "domain_mix": f"WITH {TISSUE}, n AS (SELECT a.space, a.cell_type, (SELECT min({_D2}) FROM tissue b WHERE b.space = a.space AND NOT b.is_tumour) AS dist FROM tissue a WHERE a.is_tumour) SELECT space, cell_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY space), 6) AS pct, round(median(dist), 6) AS depth_um FROM n GROUP BY 1, 2",
    "viewer_export": f"WITH RECURSIVE {_BANDED} SELECT id, round(x, 3) AS x, round(y, 3) AS y, cell_type, coalesce(niche, 'none') AS niche, CASE WHEN agg THEN 'aggregate' ELSE 'none' END AS place FROM banded",
    "infiltration": f"WITH {DISTANCE}, b AS (SELECT {_INF} AS base FROM far WHERE NOT is_tumour AND d IS NOT NULL) SELECT cell_type, count(*) AS n, round(median(d), 6) AS median_um, round(100 * {_INF}, 6) AS pct_contact, round(100 * avg((d > 100)::INT::DOUBLE), 6) AS pct_beyond_100, CASE WHEN {_INF} > any_value(base) * 1.2 THEN 'infiltrating' WHEN {_INF} < any_value(base) * 0.8 THEN 'excluded' ELSE 'similar' END AS versus FROM far, b WHERE NOT is_tumour AND d IS NOT NULL AND (coalesce(in_time_types, false) OR cell_type = 'Fibroblast') GROUP BY 1",
    "distance_to_tumour": f"WITH {DISTANCE} SELECT id, round(d, 6) AS d FROM far",
    "exclusion_on_positions": f"WITH {DISTANCE}, c AS (SELECT * FROM far WHERE NOT is_tumour AND d IS NOT NULL), e AS (SELECT cell_type, d FROM c WHERE cell_type IN ('CD8 T (GZMK+)', 'CD163+ macrophage', 'Fibroblast') UNION ALL SELECT 'baseline', d FROM c) SELECT cell_type, round(median(d), 6) AS median_um, round(100 * {_INF}, 6) AS pct_contact FROM e GROUP BY 1",
    "radius_neighbours": f"WITH {TISSUE}, {_NEAR(15)} SELECT src AS id, count(*) AS n FROM near GROUP BY 1",
    "niche_composition": f"WITH {TISSUE}, {_NEAR(50)} SELECT src AS id, lineage, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 9) AS share FROM near GROUP BY 1, 2",
    "neighbourhood_composition_excl": f"WITH {TISSUE}, {_NEAR(30)} SELECT src AS id, lineage, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 9) AS share FROM near WHERE src <> dst GROUP BY 1, 2",
    "neighbourhood_mean": f"WITH {TISSUE}, {_NEAR(30)} SELECT src AS id, round(sum(transcript_counts) / count(*)::DOUBLE, 6) AS mean FROM near GROUP BY 1 HAVING count(transcript_counts) > 0",
    "knn_spatial": f"WITH {TISSUE} SELECT * FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id)::INT AS rank, round({_D2}, 6) AS dist FROM tissue a JOIN tissue b ON a.space = b.space AND a.id <> b.id) WHERE rank <= {K}",
    "delaunay_edges": f"WITH {EDGES} SELECT src, dst, round(dist, 6) AS dist FROM edge",
    "graph_stats": f"WITH {EDGES}, deg AS (SELECT v.id, count(e.src) AS deg FROM vec v LEFT JOIN edge e ON e.src = v.id GROUP BY 1) SELECT count(*) AS cells, round(avg(deg), 6) AS mean_degree, median(deg) AS median_degree, sum((deg = 0)::INT)::BIGINT AS isolated, (SELECT count(*) FROM edge) AS entries, (SELECT round(median(dist), 6) FROM edge) AS median_um FROM deg",
    "khop_rings": f"WITH {EDGES}, one AS (SELECT src, dst FROM edge), two AS (SELECT DISTINCT a.src, b.dst FROM one a JOIN one b ON a.dst = b.src WHERE a.src <> b.dst EXCEPT SELECT src, dst FROM one), three AS (SELECT DISTINCT a.src, b.dst FROM two a JOIN one b ON a.dst = b.src WHERE a.src <> b.dst EXCEPT SELECT src, dst FROM one EXCEPT SELECT src, dst FROM two) SELECT src, 1 AS layer, count(*) AS n FROM one GROUP BY 1 UNION ALL SELECT src, 2, count(*) FROM two GROUP BY 1 UNION ALL SELECT src, 3, count(*) FROM three GROUP BY 1",
    "dbscan_aggregates": f"WITH RECURSIVE {TISSUE}, {_DBSCAN} SELECT id, cluster FROM dbscan",
    "aggregate_table": f"WITH RECURSIVE {TISSUE}, {_CIRCLE} SELECT space, n_core, round(cx, 8) AS cx, round(cy, 8) AS cy, round(radius, 8) AS radius, count(*) AS cells, round(100 * avg((cell_type = 'B cell')::INT::DOUBLE), 6) AS pct_core, round(100 * avg((lineage = 'T / NK')::INT::DOUBLE), 6) AS pct_t_nk, round(100 * avg(is_tumour::INT::DOUBLE), 6) AS pct_tumour FROM held GROUP BY cluster, space, n_core, held.cx, held.cy, held.radius",
    "compartments": f"WITH RECURSIVE {_BANDED} SELECT CASE WHEN agg THEN 'aggregate' WHEN d <= 15 THEN 'tumour contact' WHEN d <= 50 THEN 'border' ELSE 'stroma' END AS compartment, cell_type, count(*) AS n FROM banded GROUP BY 1, 2",
    "ratio_by_band": f"WITH RECURSIVE {_BANDED}, every AS (SELECT unnest(['aggregate', '<= 15 um', '15-50 um', '50-100 um', '> 100 um']) AS location) SELECT location, count(*) FILTER (WHERE cell_type = 'CD8 T (GZMK+)') AS numerator, count(*) FILTER (WHERE cell_type = 'CD163+ macrophage') AS denominator, round(count(*) FILTER (WHERE cell_type = 'CD8 T (GZMK+)') / nullif(count(*) FILTER (WHERE cell_type = 'CD163+ macrophage'), 0), 9) AS value FROM every LEFT JOIN (SELECT *, {_BAND} AS bd FROM banded) b ON bd = location GROUP BY 1",
    "tile_phenotypes": f"WITH {_TILED} SELECT space, tx, ty, tumour, intra, stroma, programme, round(intra_density, 4) AS intra_density, round(stroma_density, 4) AS stroma_density, round(total_density, 4) AS total_density, phenotype FROM t2",
    "phenotype_by_programme": f"WITH {_TILED} SELECT programme, {_PCT3}, count(*) AS tiles FROM t2 GROUP BY 1 UNION ALL SELECT 'All tumour tiles', {_PCT3}, count(*) FROM t2",
    "phenotype_sensitivity": f"WITH {_TILED}, c AS (SELECT * EXCLUDE (phenotype), CASE WHEN total_density < desert_below THEN 'desert' WHEN intra_density >= least_ratio * stroma_density THEN 'inflamed' ELSE 'excluded' END AS phenotype FROM t2, (SELECT unnest([25.0, 50.0, 100.0])::DOUBLE AS desert_below), (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS least_ratio)) SELECT desert_below, least_ratio, {_PCT3} FROM c GROUP BY 1, 2",
    "tile_labels": f"WITH {_TILED} SELECT t.space, coalesce(phenotype, 'not scored') AS phenotype, count(*) AS n FROM tiled t LEFT JOIN t2 ON t.space = t2.space AND t.tx = t2.tx AND t.ty = t2.ty GROUP BY 1, 2",
    "densest_contact_tile": f"WITH {TISSUE}, c AS (SELECT space, floor(x / 120)::BIGINT AS tx, floor(y / 120)::BIGINT AS ty, sum(is_tumour::INT)::BIGINT AS a, sum((cell_type = 'CD8 T (GZMK+)')::INT)::BIGINT AS b FROM tissue GROUP BY 1, 2, 3) SELECT space, tx, ty, n FROM (SELECT space, tx, ty, least(a, b) AS n, row_number() OVER (PARTITION BY space ORDER BY least(a, b) DESC, tx, ty) AS rn FROM c) WHERE rn = 1",
    "tiles_and_majority": f"WITH {TISSUE}, c AS (SELECT space, floor(x / 50)::BIGINT AS tx, floor(y / 50)::BIGINT AS ty, lineage, count(*) AS n FROM tissue GROUP BY 1, 2, 3, 4) SELECT space, tx, ty, 50.0::DOUBLE * tx + 25 AS x, 50.0::DOUBLE * ty + 25 AS y, cells, lineage FROM (SELECT *, sum(n) OVER (PARTITION BY space, tx, ty)::BIGINT AS cells, row_number() OVER (PARTITION BY space, tx, ty ORDER BY n DESC, lineage) AS rn FROM c) WHERE rn = 1 AND cells >= 5",
    "blocks": f"WITH {TISSUE} SELECT space, 'b' || floor(x / 200)::BIGINT || '_' || floor(y / 200)::BIGINT AS block, count(*) AS n FROM tissue GROUP BY 1, 2",
    "bbox_window": f"WITH {TISSUE} SELECT cell_type, count(*) AS n FROM tissue WHERE x > 50 AND x < 250 AND y > 50 AND y < 250 GROUP BY 1",
    "depth_in_nest": f"WITH {TISSUE}, n AS (SELECT a.space, a.cell_type, (SELECT min({_D2}) FROM tissue b WHERE b.space = a.space AND NOT b.is_tumour) AS dist FROM tissue a WHERE a.is_tumour) SELECT space, cell_type, count(*) AS n, round(median(dist), 6) AS depth_um, round(quantile_cont(dist, 0.9), 6) AS p90_um FROM n GROUP BY 1, 2",
    "name_domains": f"WITH {TISSUE}, n AS (SELECT space, lineage, count(*) AS n FROM tissue GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY space) AS share, row_number() OVER (PARTITION BY space ORDER BY n DESC, lineage) AS rn FROM n), w AS (SELECT space, max(CASE WHEN lineage = 'Epithelial' THEN share ELSE 0 END) AS epi, max(lineage || ' ' || round_even(100 * share, 0)::INT || '%') FILTER (WHERE rn = 1) AS one, max(lineage || ' ' || round_even(100 * share, 0)::INT || '%') FILTER (WHERE rn = 2) AS two, max(share) FILTER (WHERE rn = 2) AS s2 FROM s GROUP BY 1) SELECT space, 'D' || row_number() OVER (ORDER BY epi DESC, space) || ': ' || one || CASE WHEN two IS NULL OR s2 < 0.15 THEN '' ELSE ' + ' || two END AS name FROM w",
}
