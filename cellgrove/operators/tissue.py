"""Tumour and immune cells in tissue: distances, compartments, tiles, niches and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions import half_even, ratio, tile
from cellgrove.operators.neighbours import placed_aggregates
from cellgrove.operators.regions import near_points
from cellgrove.plans import cut, few, kept, quantiles, ranked

CONTACT = 15
#: Side of the tiles by which cells far from every aggregate are left out, in micrometres.
REACH_TILE = 100.0
PHENOTYPES = ("inflamed", "excluded", "desert")


def infiltration(cells: DataFrame, shown: Column, contact: float = CONTACT) -> DataFrame:
    """cell_type, n, median_um, pct_contact, pct_beyond_100, versus: how near each shown type lies to tumour cells.

    cells: cell_type, is_tumour, d (distance to the nearest tumour cell) and what shown refers to: whether a cell's type
    gets a row. The baseline is the share of all non-tumour cells within contact, shown or not; a type is infiltrating
    above 1.2 and excluded below 0.8 of it, else similar. Tumour cells and cells without a distance count nowhere.
    """
    near = (F.col("d") <= contact).cast("double")
    cells = kept(cells.where("not is_tumour and d is not null").select("cell_type", "d", F.coalesce(shown, F.lit(False)).alias("shown")))
    base = cells.agg(F.avg(near).alias("base"))
    cells = cells.where("shown")
    g = cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.avg(near).alias("c"), F.avg((F.col("d") > 100).cast("double")).alias("far"))
    g = g.join(F.broadcast(base)).join(quantiles(cells, ["cell_type"], "d", {"median_um": 0.5}), "cell_type")  # base: one row
    versus = F.when(F.col("c") > F.col("base") * 1.2, "infiltrating").when(F.col("c") < F.col("base") * 0.8, "excluded").otherwise("similar")
    return g.select("cell_type", "n", F.round("median_um", 6).alias("median_um"), F.round(100 * F.col("c"), 6).alias("pct_contact"), F.round(100 * F.col("far"), 6).alias("pct_beyond_100"), versus.alias("versus"))


def compartment(d: Column, in_aggregate: Column, contact: float = CONTACT) -> Column:
    """aggregate, tumour contact (d <= contact), border (<= 50), else stroma; an unknown distance is stroma."""
    return F.when(in_aggregate, "aggregate").when(d <= contact, "tumour contact").when(d <= 50, "border").otherwise("stroma")


def band(d: Column, in_aggregate: Column, contact: float = CONTACT) -> Column:
    """Distance band: aggregate, <= contact, <= 50, <= 100 or beyond (also for an unknown distance)."""
    return F.when(in_aggregate, "aggregate").when(d <= contact, f"<= {contact} um").when(d <= 50, f"{contact}-50 um").when(d <= 100, "50-100 um").otherwise("> 100 um")


def ratio_by_band(cells: DataFrame, numerator: str, denominator: str, contact: float = CONTACT) -> DataFrame:
    """location, numerator, denominator, value: counts of two types per band and their ratio, null over 0; all bands."""
    bands = ["aggregate", f"<= {contact} um", f"{contact}-50 um", "50-100 um", "> 100 um"]
    every = cells.sparkSession.createDataFrame([(b,) for b in bands], "location string")
    n = cells.withColumn("location", band(F.col("d"), F.col("in_aggregate"), contact)).groupBy("location").agg(*[F.sum((F.col("cell_type") == t).cast("bigint")).alias(c) for c, t in (("numerator", numerator), ("denominator", denominator))])
    out = every.join(n, "location", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("numerator", "denominator")})
    return out.withColumn("value", ratio("numerator", "denominator"))


def tumour_tiles(cells: DataFrame, cell_type: str, size: float = 400, least: int = 50, contact: float = CONTACT) -> DataFrame:
    """Tiles of each space with at least `least` tumour cells: densities per mm2 of cell area of one type inside
    (d <= contact) and outside, and the most frequent tumour type (programme; ties to the smaller name).

    cells: space, x, y, cell_type, is_tumour, d, cell_area. A null area adds nothing. The outside area is floored at
    1e-9 mm2; the inside density is null without tumour area.
    """
    of = F.col("cell_type") == cell_type
    c = kept(cells.withColumns({"tx": tile("x", size), "ty": tile("y", size)}))
    add = lambda cond, v=F.lit(1): F.sum(F.when(cond, v).otherwise(0))
    area = F.coalesce("cell_area", F.lit(0.0))
    t = c.groupBy("space", "tx", "ty").agg(add(F.col("is_tumour")).alias("tumour"), add(of & (F.col("d") <= contact)).alias("intra"), add(of & (F.col("d") > contact)).alias("stroma"), add(F.col("is_tumour"), area).cast("double").alias("area_tumour"), add(~F.col("is_tumour"), area).cast("double").alias("area_stroma")).where(F.col("tumour") >= least)
    w = Window.partitionBy("space", "tx", "ty").orderBy(F.col("n").desc(), "cell_type")
    mode = c.where("is_tumour").groupBy("space", "tx", "ty", "cell_type").agg(F.count(F.lit(1)).alias("n")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("space", "tx", "ty", F.col("cell_type").alias("programme"))
    intra = ratio("intra", F.col("area_tumour") / 1e6)
    stroma = F.col("stroma") / F.greatest(F.col("area_stroma") / 1e6, F.lit(1e-9))
    total = ratio(F.col("intra") + F.col("stroma"), (F.col("area_tumour") + F.col("area_stroma")) / 1e6)
    return t.join(mode, ["space", "tx", "ty"], "left").withColumns({"intra_density": intra, "stroma_density": stroma, "total_density": total})


def phenotype(desert: Column | float = 50.0, least_ratio: Column | float = 0.5) -> Column:
    """desert if the total density is below desert, else inflamed if inside >= ratio x outside, else excluded."""
    return F.when(F.col("total_density") < desert, "desert").when(F.col("intra_density") >= least_ratio * F.col("stroma_density"), "inflamed").otherwise("excluded")


def phenotype_by_programme(tiles: DataFrame) -> DataFrame:
    """programme, one percentage per phenotype, tiles; and a row for all tiles."""
    n = tiles.rollup("programme").agg(*[F.round(100 * F.avg((F.col("phenotype") == p).cast("double")), 6).alias(p) for p in PHENOTYPES], F.count(F.lit(1)).alias("tiles"), F.grouping("programme").alias("_all"))
    return n.select(F.when(F.col("_all") == 1, "All tumour tiles").otherwise(F.col("programme")).alias("programme"), *PHENOTYPES, "tiles")


def sensitivity(tiles: DataFrame, deserts: tuple = (25, 50, 100), ratios: tuple = (0.3, 0.5, 0.7)) -> DataFrame:
    """desert_below, least_ratio, and the percentage of tiles of each phenotype, for every pair of cutoffs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("desert_below"), F.lit(float(r)).alias("least_ratio")) for d in deserts for r in ratios]))
    t = tiles.select("total_density", "intra_density", "stroma_density", pairs.alias("c")).select("*", "c.*")
    t = t.withColumn("phenotype", phenotype(F.col("desert_below"), F.col("least_ratio")))
    return t.groupBy("desert_below", "least_ratio").agg(*[F.round(100 * F.avg((F.col("phenotype") == p).cast("double")), 6).alias(p) for p in PHENOTYPES])


def tile_numbers(cells: DataFrame, least: int) -> DataFrame:
    """Adds number: that of the cell's tile among the tiles of at least `least` cells, in order of space, tx and ty from
    0, and -1 in smaller tiles. cells: space, tx, ty."""
    big = cells.groupBy("space", "tx", "ty").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    numbered = ranked(big, [], ["space", "tx", "ty"], "_rank").select("space", "tx", "ty", (F.col("_rank") - 1).alias("number"))
    return cells.join(numbered, ["space", "tx", "ty"], "left").withColumn("number", F.coalesce("number", F.lit(-1)))


def two_names(shares: DataFrame, group: str, sure: float, least_second: float = 0.0) -> DataFrame:
    """group, name, from group, label, share: the largest label and its percentage, with the second one unless the
    first reaches `sure` or the second is below `least_second`. Ties go to the smaller label, halves to the even."""
    w = Window.partitionBy(group).orderBy(F.col("share").desc(), "label")
    top = shares.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    text = F.concat(F.col("label"), F.lit(" "), half_even(100 * F.col("share")).cast("int").cast("string"), F.lit("%"))
    both = top.groupBy(group).agg(F.max(F.when(F.col("rn") == 1, text)).alias("one"), F.max(F.when(F.col("rn") == 2, text)).alias("two"), F.max("share").alias("s1"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("share"))), F.lit(0.0)).alias("s2"))
    return both.select(group, F.when((F.col("s1") >= sure) | F.col("two").isNull() | (F.col("s2") < least_second), F.col("one")).otherwise(F.concat("one", F.lit(" + "), F.col("two"))).alias("name"))


def aggregates(cells: DataFrame, core_type: str, eps: float = 25, least: int = 20, rim: float = 20) -> tuple[DataFrame, DataFrame]:
    """(members, table): dense aggregates of one type with a rim, the largest first within the whole table.

    cells: id, space, x, y, cell_type, lineage, is_tumour. Clusters by placed_aggregates; centre = mean of the core
    type's points, radius = 90th percentile of their distances plus rim. members: id, name of the aggregate whose
    circle holds the cell, the smallest one where circles overlap. table: each circle's own composition.
    """
    own = cells.where(F.col("cell_type") == core_type).select("id", "space", "x", "y")
    label = cut(placed_aggregates(cut(own), eps, least))  # one type's cells, then circles: short plans from here on
    centre = cut(label.groupBy("space", "cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n_core")))
    away = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    far = quantiles(label.join(centre, ["space", "cluster"]).withColumn("_away", away), ["space", "cluster"], "_away", {"_far": 0.9})
    radius = cut(centre.join(far, ["space", "cluster"]).withColumn("radius", F.col("_far") + rim).drop("_far"))
    circles = cut(ranked(radius, [], [F.col("n_core").desc(), F.col("cluster")], "rank"))
    # only cells in tiles that a circle meets travel on
    at = {"_tx": tile("x", REACH_TILE), "_ty": tile("y", REACH_TILE)}
    met = lambda c: F.explode(F.sequence(tile(F.col(c) - F.col("radius") - 1e-3, REACH_TILE), tile(F.col(c) + F.col("radius") + 1e-3, REACH_TILE)))
    tiles = cut(circles.select("space", "cy", "radius", met("cx").alias("_tx")).select("space", "_tx", met("cy").alias("_ty")).distinct())
    cells = kept(cells.select("id", "space", "x", "y", "cell_type", "lineage", "is_tumour").withColumns(at).join(few(tiles), ["space", "_tx", "_ty"], "left_semi"))
    spots = cells.select("space", F.col("id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = near_points(spots, circles.select("space", F.col("rank").alias("region_id"), "cx", "cy", "radius"), "radius", strip=200.0)
    held = near.select(F.col("point_id").alias("id"), F.col("region_id").alias("rank"))
    inside = cut(held.join(cells.select("id", "cell_type", "lineage", "is_tumour"), "id").join(circles.drop("cluster"), "rank"))
    members = inside.groupBy("id").agg(F.concat(F.lit("A"), F.max("rank").cast("string")).alias("aggregate"))
    pct = lambda cond: F.round(100 * F.avg(cond.cast("double")), 6)
    table = inside.groupBy("rank", "space", "n_core", "cx", "cy", "radius").agg(F.count(F.lit(1)).alias("cells"), pct(F.col("cell_type") == core_type).alias("pct_core"), pct(F.col("lineage") == "T / NK").alias("pct_t_nk"), pct(F.col("is_tumour")).alias("pct_tumour"))
    return members, table
