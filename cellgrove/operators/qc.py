"""Quality control of cells, genes and imaging rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import ratio
from cellgrove.operators.regions import points_in_regions
from cellgrove.operators.regions import rectangles as upright_sides
from cellgrove.plans import kept, quantiles

MAD = 1.4826
RULES = ("low_counts", "low_genes", "small", "large", "control")


def with_metrics(cells: DataFrame, genes: DataFrame | None = None, control: str | None = None) -> DataFrame:
    """Adds nucleus_ratio, density, and from genes (cell_id, gene, cnt) n_genes, total_counts and control_frac.

    nucleus_ratio is null without a nucleus, density and control_frac where the denominator is 0. A gene counts if its
    count is above 0; cells without counts have 0 genes. control names the column of control counts.
    """
    out = cells.withColumn("nucleus_ratio", ratio("nucleus_area", "cell_area")).withColumn("density", ratio("transcript_counts", "cell_area"))
    if genes is not None:
        per = genes.where("cnt > 0").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("cnt").alias("total_counts"))
        out = out.join(per, "cell_id", "left").withColumns({"n_genes": F.coalesce("n_genes", F.lit(0)), "total_counts": F.coalesce("total_counts", F.lit(0.0))})
        if control:
            out = out.withColumn("control_frac", ratio(control, "total_counts"))
    return out


def mad_bounds(df: DataFrame, column: str, nmads: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """low, high (and med, mad) on the scale of log1p, mapped back: median +- nmads * 1.4826 * MAD. Nulls are left out."""
    by = by or []
    logs = df.where(F.col(column).isNotNull()).select(*by, F.log1p(column).alias("_l"))
    logs = kept(logs)
    med = kept(quantiles(logs, by, "_l", {"med": 0.5}))
    both = logs.join(med, by) if by else logs.join(F.broadcast(med))  # one row
    far = quantiles(both.select(*by, F.abs(F.col("_l") - F.col("med")).alias("_d")), by, "_d", {"_mad": 0.5})
    mad = (med.join(far, by) if by else med.join(F.broadcast(far))).withColumn("mad", F.col("_mad") * MAD)
    return mad.select(*by, "med", "mad", F.expm1(F.col("med") - nmads * F.col("mad")).alias("low"), F.expm1(F.col("med") + nmads * F.col("mad")).alias("high"))


def robust_z(column: str, med: str, mad: str):
    """(value - median) / (1.4826 * MAD), null where the MAD is 0."""
    return (F.col(column) - F.col(med)) / F.when(F.col(mad) != 0, MAD * F.col(mad))


def qc_flags(cells: DataFrame, min_counts: int = 10, min_genes: int = 5, area_nmads: float = 3.0, max_control: float = 0.05) -> DataFrame:
    """Adds one boolean per rule: transcript_counts, n_genes below their floors, cell_area outside its MAD bounds, and
    control_frac above its limit. All comparisons are strict; a null value breaks no rule."""
    bounds = mad_bounds(cells, "cell_area", area_nmads).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    out = cells.join(F.broadcast(bounds))  # one row
    rule = {"low_counts": F.col("transcript_counts") < min_counts, "low_genes": F.col("n_genes") < min_genes, "small": F.col("cell_area") < F.col("_low"), "large": F.col("cell_area") > F.col("_high"), "control": F.col("control_frac") > max_control}
    return out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rule.items()}).drop("_low", "_high")


def within_bounds(cells: DataFrame, min_counts: int = 10, min_genes: int = 5, area_nmads: float = 3.0) -> DataFrame:
    """The cells with at least min_counts transcripts and min_genes genes whose area lies within its MAD bounds, the
    bounds included; the rules for counts without control probes. A null value fails."""
    bounds = mad_bounds(cells, "cell_area", area_nmads).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    ok = (F.col("transcript_counts") >= min_counts) & (F.col("n_genes") >= min_genes) & F.col("cell_area").between(F.col("_low"), F.col("_high"))
    return cells.join(F.broadcast(bounds)).where(ok).drop("_low", "_high")  # one row


def rule_table(flags: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """rule, flagged, pct, only_this: cells each rule flags, their percentage, and those that no other rule flags."""
    broken = sum((F.col(r).cast("int") for r in rules), F.lit(0))
    long = flags.withColumn("_n", broken).select("_n", F.explode(F.create_map(*[x for r in rules for x in (F.lit(r), F.col(r))])).alias("rule", "hit"))
    return long.groupBy("rule").agg(F.sum(F.col("hit").cast("bigint")).alias("flagged"), F.round(100 * F.avg(F.col("hit").cast("double")), 6).alias("pct"), F.sum((F.col("hit") & (F.col("_n") == 1)).cast("bigint")).alias("only_this"))


def assign_rectangle(points: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Adds region: the first rectangle (by ord) of its space that holds the point, half-open on the far sides; else null.

    points: id, space, x, y, ...; rectangles: space, region, ord, x, y, width, height.
    """
    spots = points.select("space", F.col("id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    places = rectangles.select("space", F.struct(F.col("ord"), F.col("region")).alias("region_id"), "x", "y", "width", "height")
    held = points_in_regions(spots, upright_sides(places), strip=200.0, width=200.0, boundary="half_open")
    first = held.groupBy(F.col("point_id").alias("id")).agg(F.min("region_id")["region"].alias("region"))
    return points.join(first, "id", "left")


def tile_outliers(tiles: DataFrame, columns: list[str], least: int = 200, z: float = 3.0) -> DataFrame:
    """Adds z_<column> and outlier: tiles whose robust z exceeds z in some column, judged among tiles of at least
    `least` cells; smaller tiles have null z and are no outliers. A constant column gives null z."""
    big = tiles.where(F.col("cells") >= least)
    out = tiles
    for c in columns:
        med = kept(quantiles(big, [], c, {f"_m_{c}": 0.5}))
        far = quantiles(big.join(F.broadcast(med)).select(F.abs(F.col(c) - F.col(f"_m_{c}")).alias("_x")), [], "_x", {f"_d_{c}": 0.5})
        none = F.lit(True)
        out = out.join(F.broadcast(med), none, "left").join(F.broadcast(far), none, "left")  # one row each
        out = out.withColumn(f"z_{c}", F.when(F.col("cells") >= least, robust_z(c, f"_m_{c}", f"_d_{c}")))
    hit = [F.coalesce(F.abs(F.col(f"z_{c}")) > z, F.lit(False)) for c in columns]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    return out.withColumn("outlier", any_hit).drop(*[f"_{k}_{c}" for k in "md" for c in columns])


def gene_detection(transcripts: DataFrame, control_pattern: str, n_cells: int | None = None) -> DataFrame:
    """feature, total, fold (over the mean control feature), pct_assigned, and pct_cells where n_cells is given.

    transcripts: feature, cell_id (null: in no cell). Control features match the pattern and are not returned; without
    any, fold is null.
    """
    per = transcripts.where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("total"), F.avg(F.col("cell_id").isNotNull().cast("double")).alias("assigned"), F.countDistinct("cell_id").alias("cells"))
    control = per.where(F.col("feature").rlike(control_pattern)).agg(F.avg("total").alias("floor"))
    out = per.where(~F.col("feature").rlike(control_pattern)).join(F.broadcast(control))  # one row
    cols = ["feature", "total", F.round(ratio("total", "floor"), 6).alias("fold"), F.round(100 * F.col("assigned"), 6).alias("pct_assigned")]
    if n_cells is not None:
        cols.append(F.round(100 * F.col("cells") / n_cells, 6).alias("pct_cells"))
    return out.select(*cols)
