"""Points near other points or in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.operators.regions import contacts_against_record, points_in_regions, rectangles
from cellgrove.queries.sql import CELL
from cellgrove.sources.tables import read, typed_cells


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts of at most 15 µm between a non-tumour and a tumour cell that the recorded distance denies."""
    return contacts_against_record(typed_cells(spark, folder, ["dist_to_tumour_um"], position=True, kinds=("is_tumour",)), contact=15.0)


def p5_fields_of_cells(spark: SparkSession, folder: str) -> DataFrame:
    """For each section and imaging rectangle, the cells in it; where rectangles overlap a cell counts in each."""
    cells = typed_cells(spark, folder, [], position=True, kinds=()).where("x_um is not null")
    points = cells.select(F.col("section_id").alias("space"), F.col("cell_id").alias("point_id"), F.col("x_um").alias("px"), F.col("y_um").alias("py"))
    fov = read(spark, folder, "fov").select(F.col("section_id").alias("space"), F.col("fov").alias("region_id"), "x", "y", "width", "height")
    inside = points_in_regions(points, rectangles(fov), strip=200.0, width=200.0, boundary="half_open")
    return inside.groupBy(F.col("space").alias("section_id"), F.col("region_id").alias("fov")).agg(F.count(F.lit(1)).alias("n_cells"))


QUERIES = {"p5_found": p5_found, "p5_fields_of_cells": p5_fields_of_cells}

SQL = {
    "p5_found": f"""WITH {CELL}, a AS (SELECT * FROM cell WHERE typ IS NOT NULL AND NOT tum AND xu IS NOT NULL AND NOT coalesce(dist_to_tumour_um >= 0 AND dist_to_tumour_um <= 15 AND NOT isnan(dist_to_tumour_um), false)),
b AS (SELECT * FROM cell WHERE tum AND xu IS NOT NULL)
SELECT least(a.cell_id, b.cell_id) AS cell_a, greatest(a.cell_id, b.cell_id) AS cell_b FROM a JOIN b ON a.section_id = b.section_id AND b.xu BETWEEN a.xu - 15 AND a.xu + 15
WHERE sqrt((a.xu - b.xu) * (a.xu - b.xu) + (a.yu - b.yu) * (a.yu - b.yu)) <= 15""",
    "p5_fields_of_cells": f"WITH {CELL} SELECT c.section_id, f.fov, count(*) AS n_cells FROM cell c JOIN fov f ON c.section_id = f.section_id AND xu >= f.x AND xu < f.x + f.width AND yu >= f.y AND yu < f.y + f.height GROUP BY 1, 2",
}
