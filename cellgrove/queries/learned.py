"""Queries with fitted models, and features taken from neighbours."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cellgrove.functions import tile
from cellgrove.operators import models as md
from cellgrove.operators import neighbours as nb
from cellgrove.operators import stats as st
from cellgrove.operators import tissue as ts
from cellgrove.plans import cut, kept, quantiles
from cellgrove.queries.base import EDGES, VECTORS, order_genes, tissue, vector_edges, vector_genes, vectors
from cellgrove.sources.tables import read
from cellgrove.streaming import quality_stream


def _features(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), "embedding")
    return e.select("id", "label", (F.col("id") % 12).alias("block"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


def pca(spark, d):
    """Variance shares of the first five components of the standardised, log-normalised counts."""
    from cellgrove.operators.matrix import log_normalised

    x = log_normalised(order_genes(spark, d), None)
    names = [r.gene for r in x.select("gene").distinct().orderBy("gene").collect()]  # the genes of a panel
    _, share = md.principal_components(kept(md.wide(x, "cell_id", "gene", "lognorm", names)), 5)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(share)], "component int, share double")


def kmeans_niches(spark, d):
    """Niches: k-means on the lineage mix within 50 µm, numbered by falling epithelial share and named by their lineages."""
    c = kept(tissue(spark, d).withColumn("label", F.col("lineage")))
    mix = nb.neighbour_shares(c, 50.0, itself=True)
    names = sorted(r.lineage for r in c.select("lineage").distinct().collect())  # a handful of lineages
    w, centres = md.kmeans_labels(kept(md.wide(mix, "id", "label", "share", names)), 5)
    n = w.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"))
    rows = [(i, names[j], float(v)) for i, c_ in enumerate(centres) for j, v in enumerate(c_)]
    cent = spark.createDataFrame(rows, "cluster int, label string, share double")
    order = sorted(range(len(centres)), key=lambda i: -centres[i][names.index("Epithelial")] if "Epithelial" in names else i)
    rank = spark.createDataFrame([(i, k + 1) for k, i in enumerate(order)], "cluster int, rank int")
    return ts.two_names(cent, "cluster", 0.85).join(rank, "cluster").join(n, "cluster").select(F.concat(F.lit("N"), F.col("rank").cast("string"), F.lit(": "), F.col("name")).alias("niche"), "cells")


def gmm_autok(spark, d):
    """Stability of Gaussian mixtures on cellcharter_embedding for 4 to 12 components, three runs each; chosen marks the most stable."""
    f = kept(cellcharter_embedding(spark, d).select("id", array_to_vector("embedding").alias("features")))
    s = md.stable_mixtures(f, "id", list(range(4, 13)), 3)
    best = s.orderBy(F.col("stability").desc(), "k").first().k
    return s.withColumn("chosen", F.col("k") == best)


def kmeans_agreement(spark, d):
    """Agreement of k-means on principal components with the labels."""
    f, _ = md.principal_components(kept(_features(spark, d)), 8)
    w, _ = md.kmeans_labels(kept(f.select("id", "label", array_to_vector("pca").alias("features"))), 10)
    return st.agreement_scores(w.select(F.col("cluster").alias("a"), F.col("label").alias("b")))


def atlas_classifier(spark, d):
    """Accuracy and confidence per class on held-out blocks of a classifier trained on the others."""
    f = kept(_features(spark, d).withColumn("weight", F.lit(1.0)))
    fitted = md.train_classifier(f.where("block < 9"), "label")
    p = md.predict(fitted, f.where("block >= 9"))
    p = kept(p.select("label", "pred", "prob"))
    s = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.avg((F.col("prob") >= 0.5).cast("double")).alias("confident"))
    return s.join(quantiles(p, ["label"], "prob", {"median_prob": 0.5}), "label")


def cv_classify(spark, d):
    """Balanced accuracy, macro F1 and chance of grouped cross-validation."""
    p = md.cross_validated_labels(_features(spark, d), "label", "block", 3)
    return st.overall_scores(p.select(F.col("label").alias("truth"), "pred"))


def cv_classify_random(spark, d):
    """The same with rows dealt to folds one by one, on twenty principal components."""
    p = md.cross_validated_labels(_features(spark, d), "label", None, 3, components=20)
    return st.overall_scores(p.select(F.col("label").alias("truth"), "pred"))


def cv_gene_r(spark, d):
    """Out-of-fold correlation of ridge regression, its penalty chosen per fold, for two targets that are no features."""
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 12).alias("block"), F.col("label").cast("double").alias("y2"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rest = F.concat(F.slice("e", 1, 1), F.slice("e", 3, 62))  # every component but the second, which is the target
    f = e.select("block", "y2", F.col("e")[1].alias("y1"), array_to_vector(rest).alias("features"))
    return md.cross_validated_r(f, ["y1", "y2"], "block", 3)


def communities(spark, d):
    """Sizes of the communities of the neighbour graph (label propagation, a substitute for Leiden)."""
    e = vector_edges(spark, d).select("src", "dst", F.lit(1.0).alias("w"))
    return md.communities(e, vectors(spark, d)).groupBy("community").agg(F.count(F.lit(1)).alias("n"))


#: The reference's neighbours, chosen lambda and number of components.
BANKSY_K, BANKSY_LAMBDA, BANKSY_PCS = 15, 0.8, 20


def _around(spark, d, k, lam, genes=None):
    near = nb.nearest_k(vectors(spark, d), k).select("src", "dst", F.exp(-F.col("dist") * F.col("dist") / 1800.0).alias("w"))
    v = vector_genes(spark, d)
    v = (v if genes is None else v.where(F.col("gene").isin(genes))).select("id", "gene", F.log1p("cnt").alias("value"))
    return md.neighbour_features(v, near, lam).select("id", "gene", F.round("own", 8).alias("own"), F.round("around", 8).alias("around"))


def banksy_features(spark, d):
    """The part of banksy_matrix's method that SQL checks: four genes, five nearest points, lambda 0.2."""
    return _around(spark, d, 5, 0.2, ["g3", "g4", "g5", "g6"])


def banksy_matrix(spark, d):
    """Own and neighbour-weighted values of all genes, with Gaussian weights over the 15 nearest points."""
    return _around(spark, d, BANKSY_K, BANKSY_LAMBDA)


def banksy(spark, d):
    """Domains from banksy_matrix: k-means on its principal components, in place of graph clustering."""
    f = kept(banksy_matrix(spark, d))
    long = f.select("id", F.concat(F.lit("own_"), "gene").alias("k"), F.col("own").alias("v")).unionByName(f.select("id", F.concat(F.lit("near_"), "gene").alias("k"), F.col("around").alias("v")))
    genes = sorted(r.gene for r in f.select("gene").distinct().collect())  # the genes of a panel
    names = [f"{a}_{g}" for a in ("near", "own") for g in genes]
    # standardising undoes the factors of lambda, so they weight the standardised features
    weights = [BANKSY_LAMBDA**0.5] * len(genes) + [(1 - BANKSY_LAMBDA) ** 0.5] * len(genes)
    p, _ = md.principal_components(kept(md.wide(long, "id", "k", "v", names)), BANKSY_PCS, None, weights)
    w, _ = md.kmeans_labels(kept(p.select("id", array_to_vector("pca").alias("features"))), 4)
    return w.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def cellcharter_embedding(spark, d):
    """30 components of all genes for each point, followed by their means over its rings of neighbours 1 to 3; an empty ring gives zeros."""
    from cellgrove.operators.matrix import log_normalised

    x = log_normalised(vector_genes(spark, d).withColumnRenamed("id", "cell_id"), None)
    names = [r.gene for r in x.select("gene").distinct().orderBy("gene").collect()]  # the genes of a panel
    p, _ = md.principal_components(kept(md.wide(x, "cell_id", "gene", "lognorm", names)), 30)
    v = cut(p.select(F.col("cell_id").alias("id"), F.posexplode("pca").alias("gene", "value")))
    r = md.ring_means(v, cut(nb.rings(vector_edges(spark, d), 3))).withColumn("k", F.concat_ws("_", "layer", "gene"))
    w = md.wide(r, "id", "k", "mean", [f"{layer}_{i}" for layer in range(4) for i in range(30)])
    return w.select("id", vector_to_array("features").alias("embedding"))


def cellcharter_features(spark, d):
    """The part of cellcharter_embedding's method that SQL checks: mean of two genes over the point itself and its rings of neighbours 1 to 3, summed per ring."""
    v = vector_genes(spark, d).where(F.col("gene").isin("g3", "g4")).select("id", "gene", F.log1p("cnt").alias("value"))
    r = md.ring_means(v, cut(nb.rings(vector_edges(spark, d), 3)))
    return r.groupBy("gene", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mean"), 6).alias("total"))


def tile_blocks_split(spark, d):
    """Cells per fold when whole 200 µm blocks are dealt to folds."""
    b = F.concat_ws("_", "space", tile("x", 200).cast("string"), tile("y", 200).cast("string"))
    return tissue(spark, d).withColumn("fold", md.folds(b, 4)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def transcript_windows(spark, d):
    """Hourly quality figures of the transcript table, by the operator that also runs on a stream."""
    e = read(spark, d, "events").select("ts", F.col("event_type").alias("feature"), F.col("value").alias("qv"))
    return quality_stream(e).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "feature", "n", "passed")


QUERIES = {f.__name__: f for f in (pca, kmeans_niches, gmm_autok, kmeans_agreement, atlas_classifier, cv_classify, cv_classify_random, cv_gene_r, communities, banksy_features, banksy_matrix, banksy, cellcharter_embedding, cellcharter_features, tile_blocks_split, transcript_windows)}

SQL = {
    "banksy_features": f"WITH {VECTORS}, k AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS rn FROM vec a JOIN vec b ON a.id <> b.id), w AS (SELECT src, dst, exp(-dist * dist / 1800.0) / sum(exp(-dist * dist / 1800.0)) OVER (PARTITION BY src) AS w FROM k WHERE rn <= 5), v AS (SELECT id, gene, ln(1 + cnt) AS value FROM vgene WHERE gene IN ('g3', 'g4', 'g5', 'g6')), m AS (SELECT src AS id, gene, sum(w * value) AS m FROM w JOIN v ON v.id = dst GROUP BY 1, 2) SELECT coalesce(v.id, m.id) AS id, coalesce(v.gene, m.gene) AS gene, round(sqrt(0.8) * coalesce(value, 0), 8) AS own, round(sqrt(0.2) * coalesce(m, 0), 8) AS around FROM v FULL JOIN m ON m.id = v.id AND m.gene = v.gene",
    "cellcharter_features": f"WITH {EDGES}, one AS (SELECT src, dst FROM edge), two AS (SELECT DISTINCT a.src, b.dst FROM one a JOIN one b ON a.dst = b.src WHERE a.src <> b.dst EXCEPT SELECT src, dst FROM one), three AS (SELECT DISTINCT a.src, b.dst FROM two a JOIN one b ON a.dst = b.src WHERE a.src <> b.dst EXCEPT SELECT src, dst FROM one EXCEPT SELECT src, dst FROM two), ring AS (SELECT *, 1 AS layer FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three), v AS (SELECT id, gene, ln(1 + cnt) AS value FROM vgene WHERE gene IN ('g3', 'g4')), n AS (SELECT src, layer, count(*) AS n FROM ring GROUP BY 1, 2), m AS (SELECT src, layer, gene, sum(value) AS s FROM ring JOIN v ON v.id = dst GROUP BY 1, 2, 3), r AS (SELECT gene, 0 AS layer, value AS mean FROM v UNION ALL SELECT gene, m.layer, s / n FROM m JOIN n ON n.src = m.src AND n.layer = m.layer) SELECT gene, layer, count(*) AS n, round(sum(mean), 6) AS total FROM r GROUP BY 1, 2",
    "transcript_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS feature, count(*) AS n, sum(coalesce(value >= 20, false)::INT)::BIGINT AS passed FROM events GROUP BY 1, 2",
}
