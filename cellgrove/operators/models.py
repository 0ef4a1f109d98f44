"""Models on feature vectors with pyspark.ml, and graph communities. Where Spark has no equivalent of an algorithm the
substitute is named as one."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators.stats import agreement_scores
from cellgrove.plans import cut, kept


def wide(rows: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """key, features: one dense vector per key in the order of names; absent values are 0."""
    m = rows.where(F.col(name).isin(names)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, F.col(value).cast("double")))).alias("_m"))  # at most len(names) entries each
    cells = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(0.0)) for n in names])
    return m.select(key, array_to_vector(cells).alias("features"))


def principal_components(df: DataFrame, k: int, clip: float | None = 10.0, weights: list[float] | None = None) -> tuple[DataFrame, list[float]]:
    """Adds pca (k numbers) of the standardised features, clipped; and the variance shares of the components.

    weights, one per feature, multiply the standardised features. A feature without spread becomes 0. Signs are those
    that Spark's eigenvectors happen to have.
    """
    scaled = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(df).transform(df)
    if clip is not None:
        scaled = scaled.withColumn("_s", array_to_vector(F.transform(vector_to_array("_s"), lambda x: F.greatest(F.lit(-clip), F.least(F.lit(clip), x)))))
    if weights is not None:
        scaled = scaled.withColumn("_s", array_to_vector(F.zip_with(vector_to_array("_s"), F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)))
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    return model.transform(scaled).withColumn("pca", vector_to_array("_p")).drop("_s", "_p"), list(model.explainedVariance)


def kmeans_labels(df: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Adds cluster by k-means on features (parallel oversampled seeding); and the centres."""
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=30).fit(df)
    return model.transform(df), [list(map(float, c)) for c in model.clusterCenters()]


#: Rows that are worth a task of a mixture's fit.
ROWS = 2_000
#: Mixtures that are fitted at the same time.
FITS = 6


def stable_mixtures(df: DataFrame, key: str, ks: list[int], runs: int = 2, seed: int = 0) -> DataFrame:
    """k, stability: mean Fowlkes-Mallows index between Gaussian mixtures fitted from different seeds, for each k."""
    spark = df.sparkSession
    df = kept(df.coalesce(max(1, -(-df.count() // ROWS))))  # each task inverts every covariance in every step

    def score(k: int) -> tuple[int, float]:
        fits = [kept(GaussianMixture(k=k, seed=seed + r, maxIter=25, featuresCol="features", predictionCol="c").fit(df).transform(df).select(key, "c")) for r in range(runs)]
        scores = [agreement_scores(a.withColumnRenamed("c", "a").join(b.withColumnRenamed("c", "b"), key)).first().fmi for i, a in enumerate(fits) for b in fits[i + 1 :]]
        return k, float(sum(s or 0.0 for s in scores) / max(1, len(scores)))

    # a few parameter values, each a distributed fit of many short jobs: several run at once, the largest first
    with ThreadPool(FITS) as pool:
        rows = pool.map(inheritable_thread_target(spark)(score), sorted(ks, reverse=True), chunksize=1)
    return spark.createDataFrame(sorted(rows), "k int, stability double")


def folds(group: Column, n: int, seed: int = 0) -> Column:
    """The fold of a group, by hash: rows of one group are never on both sides."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), group.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows of all / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    n = n.withColumns({"_t": F.sum("_n").over(Window.partitionBy(F.lit(0))), "_k": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})  # one row per class
    return df.join(n, label).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def train_classifier(train: DataFrame, label: str, c: float = 0.1):
    """Scaling without centring and multinomial logistic regression with an L2 penalty of 1 / (C n)."""
    n = max(1, train.count())
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True).fit(train)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", family="multinomial", elasticNetParam=0.0, regParam=1.0 / (c * n), maxIter=60).fit(scaler.transform(train))
    return scaler, model


def predict(fitted, df: DataFrame) -> DataFrame:
    """Adds pred (number of the class) and prob, its probability."""
    scaler, model = fitted
    out = model.transform(scaler.transform(df))
    return out.withColumns({"pred": F.col("prediction").cast("int"), "prob": F.array_max(vector_to_array("probability"))}).drop("scaled", "rawPrediction", "probability", "prediction")


def cross_validated_labels(df: DataFrame, label: str, group: str | None, n_folds: int, c: float = 0.1, components: int | None = None, key: str = "id") -> DataFrame:
    """df with pred and prob from models that saw none of the row's group. Classes are weighted to balance.

    Without a group, rows are dealt to folds one by one, by hash of the key. With components, the standardised features
    are first turned into so many principal components, fitted on the training rows of each fold.
    """
    df = kept(df.withColumn("_fold", folds(F.col(group or key), n_folds)))
    parts = []
    for k in range(n_folds):  # a few folds, each a distributed fit
        train, rest = df.where(F.col("_fold") != k), df.where(F.col("_fold") == k)
        if components is not None:
            scaler = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(train)
            model = PCA(k=components, inputCol="_s", outputCol="_p").fit(scaler.transform(train))
            train, rest = (model.transform(scaler.transform(x)).drop("features", "_s").withColumnRenamed("_p", "features") for x in (train, rest))
        fitted = train_classifier(balanced_weights(train, label), label, c)
        parts.append(predict(fitted, rest))
    return reduce(DataFrame.unionByName, parts).drop("_fold")


def cross_validated_r(df: DataFrame, targets: list[str], group: str, n_folds: int, regs: tuple[float, ...] = (0.01, 0.1, 1.0)) -> DataFrame:
    """target, r, n: correlation of each target with its out-of-fold ridge prediction; 0 where it is undefined.

    In each fold the penalty is chosen among regs by the correlation on a fifth of the training groups, held out by
    hash; ties go to the first. The targets must not be among the features.
    """
    df = kept(df.withColumns({"_fold": folds(F.col(group), n_folds), "_inner": folds(F.col(group), 5, seed=1)}))

    def fit(rows: DataFrame, target: str, reg: float):
        return LinearRegression(featuresCol="features", labelCol=target, predictionCol="p", regParam=reg, elasticNetParam=0.0, solver="normal").fit(rows)

    def score(rows: DataFrame, target: str) -> float:
        r = rows.agg(F.corr(target, "p")).first()[0]
        return -2.0 if r is None or r != r else r

    out = []
    for t in targets:
        parts = []
        for k in range(n_folds):
            train = df.where(F.col("_fold") != k)
            inner, judge = train.where("_inner <> 0"), train.where("_inner = 0")
            able = len(regs) > 1 and inner.limit(1).count() and judge.limit(1).count()
            best = max(regs, key=lambda reg: (score(fit(inner, t, reg).transform(judge), t), -regs.index(reg))) if able else regs[0]  # noqa: B023
            parts.append(fit(train, t, best).transform(df.where(F.col("_fold") == k)).select(F.col(t).alias("y"), "p"))
        r = reduce(DataFrame.unionByName, parts).agg(F.corr("y", "p").alias("r"), F.count(F.lit(1)).alias("n"))
        out.append(r.select(F.lit(t).alias("target"), F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0)).alias("r"), "n"))
    return reduce(DataFrame.unionByName, out)


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 12) -> DataFrame:
    """id, community: weighted label propagation over a symmetric graph (src, dst, w). A substitute for modularity
    clustering, which Spark lacks: compare its groups by agreement scores only.

    In each round half of the nodes, by hash, take the label with the largest weight among their neighbours and
    themselves (own weight 1; ties to the smaller label), so that labels do not swap for ever. It ends after `rounds`
    rounds, settled or not: on graphs without clear groups labels go on changing for more than a hundred.
    """
    label = nodes.select("id", F.col("id").alias("community"))
    edges = kept(edges.select("src", "dst", "w"))
    best = Window.partitionBy("id").orderBy(F.col("w").desc(), "community")
    for r in range(rounds):
        votes = edges.join(label.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "community", "w").unionByName(label.withColumn("w", F.lit(1.0)))
        top = votes.groupBy("id", "community").agg(F.sum("w").alias("w")).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("id", F.col("community").alias("new"))
        moves = F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(2)) == 0
        label = cut(label.join(top, "id").select("id", F.when(moves, F.col("new")).otherwise(F.col("community")).alias("community")))
    return label


def neighbour_features(values: DataFrame, neighbours: DataFrame, lam: float) -> DataFrame:
    """id, gene, own, around: sqrt(1 - lam) times the cell's value and sqrt(lam) times the weighted mean of its
    neighbours' values, absent ones as 0. neighbours: src, dst, w; values: id, gene, value. A gene is given for a
    cell if the cell or a neighbour has it."""
    w = kept(neighbours.join(neighbours.groupBy("src").agg(F.sum("w").alias("sw")), "src").select("src", "dst", (F.col("w") / F.col("sw")).alias("w")))
    near = w.join(values.withColumnsRenamed({"id": "dst"}), "dst").groupBy(F.col("src").alias("id"), "gene").agg(F.sum(F.col("w") * F.col("value")).alias("m"))
    both = values.join(near, ["id", "gene"], "full")
    return both.select("id", "gene", (F.sqrt(F.lit(1 - lam)) * F.coalesce("value", F.lit(0.0))).alias("own"), (F.sqrt(F.lit(lam)) * F.coalesce("m", F.lit(0.0))).alias("around"))


def ring_means(values: DataFrame, rings: DataFrame) -> DataFrame:
    """id, gene, layer, mean: the mean of the values over each ring of neighbours, absent values as 0; layer 0 is the
    cell itself. rings: src, dst, layer."""
    n = rings.groupBy("src", "layer").agg(F.count(F.lit(1)).alias("n"))
    s = rings.join(values.withColumnRenamed("id", "dst"), "dst").groupBy("src", "layer", "gene").agg(F.sum("value").alias("s")).join(n, ["src", "layer"])
    return values.select("id", "gene", F.lit(0).alias("layer"), F.col("value").alias("mean")).unionByName(s.select(F.col("src").alias("id"), "gene", "layer", (F.col("s") / F.col("n")).alias("mean")))
