"""Images as pixel tables (img, row, col, r, g, b): affine maps, stains, patches, alignment. Spark joins the pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stain vectors of hematoxylin, eosin and the residual in optical density (rows; columns red, green, blue).
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def affine(x: Column, y: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """x and y under a 3 x 3 matrix whose last row is 0 0 1."""
    return m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2]


def inverse(m: list[list[float]]) -> list[list[float]]:
    """The inverse map, worked out once on the driver: nine numbers."""
    return np.linalg.inv(np.asarray(m, dtype=float)).tolist()


def with_stains(pixels: DataFrame) -> DataFrame:
    """Adds hematoxylin, eosin and residual: -ln((value + 1) / 256) unmixed by the stain vectors of length 1."""
    basis = np.array(STAINS) / np.linalg.norm(STAINS, axis=1, keepdims=True)
    unmix = np.linalg.inv(basis)
    od = [-F.log((F.col(c) + 1) / 256.0) for c in ("r", "g", "b")]
    return pixels.withColumns({n: sum((od[i] * float(unmix[i][k]) for i in range(3)), F.lit(0.0)) for k, n in enumerate(("hematoxylin", "eosin", "residual"))})


def at_points(points: DataFrame, pixels: DataFrame, um_per_px: float, height: int, width: int) -> DataFrame:
    """points (id, img, x, y in µm) with the pixel under each: rounded (halves to even) and clipped to the image."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround(c / um_per_px).cast("int")))
    return points.withColumns({"col": clip(F.col("x"), width), "row": clip(F.col("y"), height)}).join(pixels, ["img", "row", "col"], "left")


def patch_features(points: DataFrame, pixels: DataFrame, um_per_px: float, side: int) -> DataFrame:
    """id and mean and population SD of six channels over the side x side pixels around each point; what lies outside
    the image is white (255, no stain). Pixels are found by an equi-join on row and column."""
    half = side // 2
    c = points.withColumns({"_c": F.bround(F.col("x") / um_per_px).cast("int"), "_r": F.bround(F.col("y") / um_per_px).cast("int")})
    c = c.withColumn("dr", F.explode(F.sequence(F.lit(-half), F.lit(side - half - 1)))).withColumn("dc", F.explode(F.sequence(F.lit(-half), F.lit(side - half - 1))))
    c = c.select("id", "img", (F.col("_r") + F.col("dr")).alias("row"), (F.col("_c") + F.col("dc")).alias("col"))
    p = c.join(with_stains(pixels), ["img", "row", "col"], "left")
    names = {"r": 255.0, "g": 255.0, "b": 255.0, "hematoxylin": 0.0, "eosin": 0.0, "residual": 0.0}
    v = {n: F.coalesce(F.col(n).cast("double"), F.lit(w)) for n, w in names.items()}
    return p.groupBy("id").agg(*[F.avg(x).alias(f"{n}_mean") for n, x in v.items()], *[F.stddev_pop(x).alias(f"{n}_sd") for n, x in v.items()])


def shift_correlation(a: DataFrame, b: DataFrame, height: int, width: int, most: int = 10) -> DataFrame:
    """dr, dc, r: correlation of two pixel grids (row, col, v; a also mask) for every shift of b up to `most` pixels,
    wrapping at the edges, over a's masked pixels."""
    s = F.sequence(F.lit(-most), F.lit(most))
    shifted = b.withColumn("dr", F.explode(s)).withColumn("dc", F.explode(s)).select(F.pmod(F.col("row") + F.col("dr"), F.lit(height)).alias("row"), F.pmod(F.col("col") + F.col("dc"), F.lit(width)).alias("col"), "dr", "dc", F.col("v").alias("vb"))
    return a.where("mask").select("row", "col", F.col("v").alias("va")).join(shifted, ["row", "col"]).groupBy("dr", "dc").agg(F.corr("va", "vb").alias("r"))
