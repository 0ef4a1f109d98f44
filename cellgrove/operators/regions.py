"""Points near other points, and points in regions, for hundreds of millions of points.

Both operators turn a geometric predicate into an equi-join on small bins, so Spark partitions and shuffles the
work by place. Bins that hold very many points are split by a salt, and only the other side is repeated for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import tile, uniform
from cellgrove.plans import kept

#: A bin with more points than this is split into shares of about this many.
BIN_ROWS = 20_000
_JUDGED = 64


def _salted(points: DataFrame, others: DataFrame, bins: list[str], key: str, rows: int = BIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Adds _salt to both: shares of a hot bin's points, and a copy of the other side's row for each share.

    Which bins are hot is judged from one point in _JUDGED; that decides the cost only, never the result.
    """
    some = points.where(F.pmod(F.xxhash64(key), F.lit(_JUDGED)) == 0) if rows > 10 * _JUDGED else points
    each = _JUDGED if rows > 10 * _JUDGED else 1
    hot = some.groupBy(*bins).count().where(F.col("count") * each > rows).select(*bins, F.ceil(F.col("count") * each / rows).cast("int").alias("_shares"))
    shares = F.coalesce("_shares", F.lit(1))
    points = points.join(hot, bins, "left").withColumn("_salt", F.floor(uniform(F.col(key)) * shares).cast("int")).drop("_shares")
    others = others.join(hot, bins, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return points, others


def points_in_regions(points: DataFrame, edges: DataFrame, strip: float, width: float | None = None, boundary: str = "closed", carry: list[str] = (), bin_rows: int = BIN_ROWS) -> DataFrame:
    """The region or regions that contain each point, by crossing parity.

    points: space, point_id, px, py. edges: space, region_id, x1, y1, x2, y2 (one row per polygon side, in any
    order and direction), and the columns in carry, which are constant within a region. space is any grouping that
    points and regions have to share (a section, a country); a null space matches nothing.

    Edges are binned into strips of the second coordinate (strip wide) and into bins of the first (width wide, by
    default 64 strips) from the region's left end to the edge's right end, which is where points can lie whose ray
    to the right meets the edge. The ray crossings are grouped by point and region; an odd number is inside.
    boundary="closed": a point on a side or a corner is inside. "half_open": a side belongs to what lies above or to
    the right of it, so that adjoining regions share no point; level sides are then left out of the join.
    Rows with a null or non-finite coordinate or id are left out; repeated edges count once, repeated points too.
    Returns space, point_id, px, py, region_id and carry, each pair once.
    """
    if boundary not in ("closed", "half_open"):
        raise ValueError("boundary is closed or half_open")
    width = width or 64 * strip
    inf = F.lit(float("inf"))
    ok = lambda *cs: [~F.isnan(c) & (F.abs(c) < inf) for c in cs]

    pts = points.select("space", "point_id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    pts = pts.where(F.col("space").isNotNull() & F.col("point_id").isNotNull())
    for c in ok(F.col("px"), F.col("py")):
        pts = pts.where(c)
    pts = pts.withColumn("_by", tile("py", strip)).withColumn("_bx", tile("px", width))

    carry = list(carry)
    e = edges.select("space", "region_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], *carry, *([c for c in ("region_left",) if c in edges.columns]))
    e = e.where(F.col("space").isNotNull() & F.col("region_id").isNotNull())
    for c in ok(*map(F.col, ("x1", "y1", "x2", "y2"))):
        e = e.where(c)
    if "region_left" not in e.columns:
        left = e.groupBy("space", "region_id").agg(F.min(F.least("x1", "x2")).alias("region_left"))
        e = e.join(left, ["space", "region_id"])
    level = F.col("y1") == F.col("y2")
    if boundary == "half_open":
        e = e.where(~level)
    e = e.withColumn("_by", F.explode(F.sequence(tile(F.least("y1", "y2"), strip), tile(F.greatest("y1", "y2"), strip))))
    e = e.withColumn("_bx", F.explode(F.sequence(tile("region_left", width), tile(F.greatest("x1", "x2"), width)))).drop("region_left")

    bins = ["space", "_by", "_bx"]
    pts, e = _salted(pts, e, bins, "point_id", bin_rows)
    px, py, x1, y1, x2, y2 = map(F.col, ("px", "py", "x1", "y1", "x2", "y2"))
    at = x1 + (py - y1) * (x2 - x1) / F.when(y1 != y2, y2 - y1)
    crossing = ((y1 > py) != (y2 > py)) & (px < at)
    both = pts.join(e.hint("shuffle_merge"), [*bins, "_salt"])
    keys = [*bins, "_salt", "point_id", "px", "py", "region_id", *carry]  # the join's own keys first: no second shuffle
    if boundary == "half_open":
        hits = both.where(crossing).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1)
    else:
        straight = F.when(level, (px >= F.least("x1", "x2")) & (px <= F.greatest("x1", "x2")) & (py == y1)).otherwise((py >= F.least("y1", "y2")) & (py <= F.greatest("y1", "y2")) & (px == at))
        corner = ((px == x1) & (py == y1)) | ((px == x2) & (py == y2))
        once = both.where(crossing | straight | corner).groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.max(crossing.cast("int")).alias("_c"), F.max((straight | corner).cast("int")).alias("_on"))
        hits = once.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.max("_on").alias("_on")).where((F.col("_n") % 2 == 1) | (F.col("_on") == 1))
    return hits.select("space", "point_id", "px", "py", "region_id", *carry)


def boxes(points: DataFrame, half: Column | float, carry: list[str] = ()) -> DataFrame:
    """The upright sides of a square around each row (space, region_id, cx, cy), as edges for points_in_regions.

    half: half a side, a number or a column. Level sides cross no level ray, so half-open parity needs none of them.
    """
    half = half if isinstance(half, Column) else F.lit(float(half))
    sides = F.array(F.col("cx") - half, F.col("cx") + half)
    points = points.select("space", "region_id", "cx", "cy", *carry)
    return points.select("space", "region_id", "cx", "cy", *carry, (F.col("cx") - half).alias("region_left"), half.alias("_half"), F.explode(sides).alias("x1")).select("space", "region_id", "cx", "cy", *carry, "region_left", "x1", (F.col("cy") - F.col("_half")).alias("y1"), F.col("x1").alias("x2"), (F.col("cy") + F.col("_half")).alias("y2"))


def near_points(points: DataFrame, centres: DataFrame, distance: float | str, strip: float | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """All pairs of a point and a centre of the same space at most distance apart.

    points: space, point_id, px, py. centres: space, region_id, cx, cy. distance is a number, or names a column of
    centres; then strip is the width of the bins. Each centre becomes a square region that holds its whole circle;
    crossing parity finds the points in it, the exact distance decides. Rows with a null or non-finite coordinate or id,
    or a null distance, match nothing; a point lies near itself if it is on both sides.
    Returns space, point_id, region_id, distance.
    """
    own = isinstance(distance, str)
    reach = F.col(distance) if own else F.lit(float(distance))
    carry = ["cx", "cy", *([distance] if own else [])]
    strip = strip or 4 * (distance * (1 + 1e-9) + 1e-9)
    sides = boxes(centres, reach * (1 + 1e-9) + 1e-9, [distance] if own else [])
    found = points_in_regions(points, sides, strip=strip, width=strip, boundary="half_open", carry=carry, bin_rows=bin_rows)
    d = F.sqrt((F.col("px") - F.col("cx")) * (F.col("px") - F.col("cx")) + (F.col("py") - F.col("cy")) * (F.col("py") - F.col("cy")))
    return found.withColumn("_d", d).where(F.col("_d") <= reach).select("space", "point_id", "region_id", F.col("_d").alias("distance"))


def contacts_against_record(cells: DataFrame, contact: float = 15.0) -> DataFrame:
    """Pairs in contact of a cell of known non-tumour type and a tumour cell whose recorded distance denies it.

    cells: cell_id, section_id, x_um, y_um, is_tumour (null: unknown type), dist_to_tumour_um; one row per cell. The
    record denies a contact if it is null, not a number, below 0 or above contact. Returns cell_a < cell_b.
    """
    d = F.col("dist_to_tumour_um")
    denies = d.isNull() | F.isnan(d) | (d < 0) | (d > contact)
    placed = kept(cells.where(F.col("is_tumour").isNotNull() & F.col("x_um").isNotNull() & F.col("y_um").isNotNull() & (F.col("is_tumour") | denies)).select("cell_id", "section_id", "x_um", "y_um", "is_tumour"))
    points = placed.where(~F.col("is_tumour")).select(F.col("section_id").alias("space"), F.col("cell_id").alias("point_id"), F.col("x_um").alias("px"), F.col("y_um").alias("py"))
    centres = placed.where("is_tumour").select(F.col("section_id").alias("space"), F.col("cell_id").alias("region_id"), F.col("x_um").alias("cx"), F.col("y_um").alias("cy"))
    near = near_points(points, centres, contact)
    return near.select(F.least("point_id", "region_id").alias("cell_a"), F.greatest("point_id", "region_id").alias("cell_b"))


def rectangles(fov: DataFrame) -> DataFrame:
    """Imaging rectangles (space, region_id, x, y, width, height) as the upright sides for half-open parity."""
    x, w = F.col("x").cast("double"), F.col("width").cast("double")
    sides = fov.select("space", "region_id", "x", "y", "width", "height", F.explode(F.array(x, x + w)).alias("x1"))
    return sides.select("space", "region_id", F.col("x").cast("double").alias("region_left"), "x1", F.col("y").cast("double").alias("y1"), F.col("x1").alias("x2"), (F.col("y") + F.col("height")).cast("double").alias("y2"))


