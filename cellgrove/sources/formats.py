"""Other shapes that inputs and results come in: platform adapters, JSON, CSV, polygons, compressed labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    """What differs between imaging platforms, so that the operators need not know the platform."""

    cell_id: str = "cell_id"
    x: str = "x"
    y: str = "y"
    control_columns: tuple[str, ...] = ()
    min_qv: float = 20.0
    not_genes: str = r"^(NegControl|BLANK|Unassigned|Deprecated)"
    unassigned: str = "UNASSIGNED"

    def cells(self, df: DataFrame) -> DataFrame:
        """df with cell_id, x, y and control_counts, the sum of the control columns (null counts as 0)."""
        control = sum((F.coalesce(F.col(c), F.lit(0)) for c in self.control_columns), F.lit(0))
        return df.withColumns({"cell_id": F.col(self.cell_id).cast("string"), "x": F.col(self.x).cast("double"), "y": F.col(self.y).cast("double"), "control_counts": control.cast("double")})

    def transcripts(self, df: DataFrame) -> DataFrame:
        """feature, cell_id (null: in no cell), x, y, is_gene of the transcripts at or above the quality floor."""
        cell = F.when(F.col("cell_id") != self.unassigned, F.col("cell_id"))
        return df.where(F.col("qv") >= self.min_qv).select(F.col("feature_name").alias("feature"), cell.alias("cell_id"), F.col("x_location").alias("x"), F.col("y_location").alias("y"), (~F.col("feature_name").rlike(self.not_genes)).alias("is_gene"))


def window_of(transcripts: DataFrame, x0: float, x1: float, y0: float, y1: float, genes: list[str] | None = None) -> DataFrame:
    """Transcripts strictly inside a window, of some genes; plain comparisons, which Parquet row groups can skip by."""
    t = transcripts.where((F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1))
    return t.where(F.col("feature").isin(genes)) if genes is not None else t


def fov_json(spark: SparkSession, path: str) -> DataFrame:
    """fov, x, y, width, height from JSON {"units": "microns", "fov_locations": {fov: {...}}}; other units are refused."""
    place = "struct<x:double,y:double,width:double,height:double>"
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", f"units string, fov_locations map<string,{place}>").alias("j"))
    if j.where("j.units is null or j.units <> 'microns'").limit(1).count():
        raise ValueError("imaging rectangles are not in microns")
    return j.select(F.explode("j.fov_locations").alias("fov", "p")).select("fov", "p.*")


def label_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, read with a given schema: vendor clusters, earlier results."""
    return spark.read.csv(path, header=True, schema=schema)


def polygons(vertices: DataFrame) -> DataFrame:
    """cell_id, outline ARRAY<STRUCT<x, y>> in the order of ord, area by the shoelace formula.

    vertices: cell_id, ord, x, y: one cell's outline is small. Fewer than three corners have area 0.
    """
    o = vertices.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("outline"))
    nxt = F.concat(F.slice("outline", 2, F.size("outline")), F.slice("outline", 1, 1))
    terms = F.zip_with("outline", nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return o.withColumn("area", F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2)


def polygon_edges(outlines: DataFrame, space: str) -> DataFrame:
    """The sides of outlines (cell_id, outline, <space>) as the edges that points_in_regions takes."""
    nxt = F.concat(F.slice("outline", 2, F.size("outline")), F.slice("outline", 1, 1))
    e = outlines.select(F.col(space).alias("space"), F.col("cell_id").alias("region_id"), F.explode(F.arrays_zip(F.col("outline").alias("a"), nxt.alias("b"))).alias("e"))
    return e.select("space", "region_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def save_table(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header; for small results only."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_labels(df: DataFrame, path: str) -> None:
    """Labels of many cells as compressed CSV, one file per partition."""
    df.write.mode("overwrite").csv(path, header=True, compression="gzip")


def save_step(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """A step's rows as Parquet, sorted within files by the given columns so that later filters skip row groups."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)
