"""Reading the tables and bringing them into the canonical form: one row per cell, micrometres, known types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.functions import finite, fold

#: Steps read as named datasets; the names are files in the dataset folder.
CATALOGUE = ("cells", "sections", "fov", "type_labels", "sub_profiles", "atlas_obs", "donor_links", "sample_targets", "documents", "eval_items", "mix_targets", "embeddings", "events", "lineitem", "orders", "customer", "part", "supplier", "nation", "region")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the dataset folder; columns and filters of the query reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_step(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """As read, but an unknown name is a KeyError and a missing file a FileNotFoundError."""
    if name not in CATALOGUE:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(CATALOGUE)}")
    jvm, path = spark._jvm, f"{folder}/{name}.parquet"
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def current(df: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """The newest row of each key. Rows without a key are dropped: nothing says what they describe.

    Spark limits the groups before the shuffle as well (WindowGroupLimit), so copies of one hot key do not travel.
    """
    w = Window.partitionBy(key).orderBy(*newest)
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


_KINDS = {"type": "cell_type", "type_lineage": "lineage", "is_tumour": "is_tumour", "in_time_types": "in_time_types"}


def typed_cells(spark: SparkSession, folder: str, columns: list[str], position: bool = False, kinds: tuple[str, ...] = ("type", "type_lineage", "is_tumour", "in_time_types")) -> DataFrame:
    """Current rows of cells with cell_id, section_id, the given columns, and the type.

    The type (those of type, type_lineage, is_tumour, in_time_types that kinds names) is what type_labels says of the folded time_type, else of
    the folded cell_type, else null. With position, x_um and y_um are micrometres, null where x, y, the unit or the
    pixel size is missing or not a number. Only the needed columns are shuffled, labels already replaced by types.
    """
    cells, labels = read(spark, folder, "cells"), read(spark, folder, "type_labels")
    look = labels.select(F.col("raw_label"), F.struct("cell_type", "lineage", "is_tumour", "in_time_types").alias("t")).where("raw_label is not null").dropDuplicates(["raw_label"])
    a, b = look.select(F.col("raw_label").alias("la"), F.col("t").alias("ta")), look.select(F.col("raw_label").alias("lb"), F.col("t").alias("tb"))
    need = ["cell_id", "section_id", "row_id", "loaded_at", "time_type", "cell_type", *columns] + (["x", "y", "coord_unit"] if position else [])
    df = cells.select(*dict.fromkeys(need))
    df = df.withColumn("la", fold("time_type")).withColumn("lb", fold("cell_type")).join(a, "la", "left").join(b, "lb", "left")
    df = df.withColumn("t", F.coalesce("ta", "tb")).drop("la", "lb", "ta", "tb")
    if position:
        px = read(spark, folder, "sections").select(F.col("section_id").alias("ps"), "px_um").where("section_id is not null").dropDuplicates(["ps"])
        # one projection per step: Spark then folds each unit once and not once for every place it is looked at
        df = df.join(px, df.section_id == px.ps, "left").withColumn("_unit", fold("coord_unit"))
        unit = F.col("_unit")
        scale = F.when(unit.isNull() | unit.isin("um", "µm", "μm"), F.lit(1.0)).when(unit == "mm", F.lit(1000.0)).when(unit == "px", F.col("px_um"))
        df = df.withColumn("_scale", scale).withColumns({"_x": F.col("x") * F.col("_scale"), "_y": F.col("y") * F.col("_scale")})
        both = finite("_x").isNotNull() & finite("_y").isNotNull()
        df = df.withColumns({"x_um": F.when(both, F.col("_x")), "y_um": F.when(both, F.col("_y"))})
    out = ["cell_id", "section_id", *[c for c in columns if c not in ("cell_id", "section_id")]]
    df = df.select(*dict.fromkeys([*out, "row_id", "loaded_at"]), *[F.col(f"t.{_KINDS[k]}").alias(k) for k in kinds], *(["x_um", "y_um"] if position else []))
    return current(df, "cell_id", [F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc_nulls_last()])


def current_atlas(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Current rows of atlas_obs (latest loaded_at of each obs_id; equal ones are identical)."""
    df = read(spark, folder, "atlas_obs").select(*dict.fromkeys(["obs_id", "loaded_at", *columns]))
    return current(df, "obs_id", [F.col("loaded_at").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns if c != "obs_id"]])
