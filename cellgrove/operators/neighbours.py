"""Neighbour joins on points: within a radius, nearest, k nearest, and what is read off the neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions import tile
from cellgrove.plans import cut, kept


def _placed(df: DataFrame) -> DataFrame:
    inf = F.lit(float("inf"))
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < inf) for c in ("x", "y")]
    return df.where(F.col("space").isNotNull() & F.col("id").isNotNull() & ok[0] & ok[1])


def _reached(points: DataFrame, others: DataFrame, radius: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """space, src, x, y, dst, _x, _y, dist of radius_pairs: with the coordinates of both sides, and src_<c>, dst_<c> of
    each column in carry, so that the pairs need not be joined again."""
    # each point of the other side lies in about four cells of twice the radius, where it would lie in nine of the radius
    return _met(points, _spread(others, radius, 2 * radius, carry), radius, 2 * radius, carry)


def _met(points: DataFrame, spread: DataFrame, radius: float, side: float, carry: tuple[str, ...] = ()) -> DataFrame:
    a = _placed(points).select("space", F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in carry], "x", "y", tile("x", side).alias("_gx"), tile("y", side).alias("_gy"))
    d = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
    return a.join(spread, ["space", "_gx", "_gy"]).withColumn("dist", d).where(F.col("dist") <= radius)


def _spread(others: DataFrame, radius: float, side: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """space, _gx, _gy, dst, _x, _y, dst_<c> of each column in carry: each point once for each grid cell of the given side
    that the square around its circle meets."""

    def cells(c: str) -> Column:
        reach = F.lit(radius) + F.lit(1e-9) * (F.lit(radius) + F.abs(F.col(c)))  # more than rounding can move a point
        return F.sequence(tile(F.col(c) - reach, side), tile(F.col(c) + reach, side))

    b = _placed(others).select("space", F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in carry], F.col("x").alias("_x"), F.col("y").alias("_y"))
    return b.withColumn("_gx", F.explode(cells("_x"))).withColumn("_gy", F.explode(cells("_y")))


def radius_pairs(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """src, dst, space, dist: each point with every other-side point of its space at most radius away.

    points, others: id, space, x, y. Points get the grid cell they lie in, the other side is repeated for the
    cells that its circle can meet; an equi-join on the cell and an exact test do the rest. A point on both sides lies near
    itself. Rows with nulls match nothing. AQE splits grid cells that hold too many points.
    """
    return _reached(points, others, radius).select("space", "src", "dst", "dist")


def banded_pairs(points: DataFrame, least: float, most: float, bands: int) -> DataFrame:
    """space, band, a, b, n: ordered pairs of different points by label in bands of equal width, (least, most] together.

    points: id, space, x, y, label; ids are unique within a space, points without a label are left out. Labels travel
    with the points and pairs are counted where they arise; only counts are shuffled.
    """
    named = points.where("label is not null")
    pairs = _reached(named, named, most, ("label",)).where((F.col("src") < F.col("dst")) & (F.col("dist") > least))
    band = F.greatest(F.ceil((F.col("dist") - least) / F.lit((most - least) / bands)) - 1, F.lit(0))
    n = pairs.groupBy("space", F.least(band, F.lit(bands - 1)).cast("int").alias("band"), F.col("src_label").alias("a"), F.col("dst_label").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return n.select("space", "band", F.explode(both).alias("e"), "n").groupBy("space", "band", "e.a", "e.b").agg(F.sum("n").alias("n"))


#: Side of the finest tiles of the nearest join, in the unit of the coordinates, and the factor from level to level.
TILE, FACTOR = 24.0, 4


def _levels(placed: DataFrame, side: str, levels: int) -> list[DataFrame]:
    """Occupied tiles of every level, the finest first: space, <side>x, <side>y, <side>n, and the box of their points."""
    x, y, n, box = f"{side}x", f"{side}y", f"{side}n", [f"{side}{b}" for b in ("x0", "x1", "y0", "y1")]
    t = placed.groupBy("space", x, y).agg(F.count(F.lit(1)).alias(n), F.min("x").alias(box[0]), F.max("x").alias(box[1]), F.min("y").alias(box[2]), F.max("y").alias(box[3]))
    out = [cut(t)]  # a short plan: every level of the descent refers to it
    for level in range(1, levels):
        up = out[0].groupBy("space", F.floor(F.col(x) / FACTOR**level).alias(x), F.floor(F.col(y) / FACTOR**level).alias(y))
        out.append(up.agg(F.sum(n).alias(n), F.min(box[0]).alias(box[0]), F.max(box[1]).alias(box[1]), F.min(box[2]).alias(box[2]), F.max(box[3]).alias(box[3])))
    return out


def _within_reach(points: DataFrame, targets: DataFrame, k: int, extent: float, size: float) -> DataFrame:
    """space, px, py, tx, ty: for each occupied tile of points the target tiles that can hold one of its k nearest targets.

    A descent over two pyramids of tiles at once: the farthest distances between the boxes of two tiles bound how far
    the k-th nearest target can be, and target tiles that begin beyond it are dropped with all that lies in them. What
    is left per tile are the target tiles in a ring about two tiles wide, wherever the targets are; points are never
    paired here.
    """
    levels = 1
    while 8 * size * FACTOR ** (levels - 1) < extent:
        levels += 1
    p, t = _levels(points, "p", levels), _levels(targets, "t", levels)
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"t{a}0") - F.col(f"p{a}1"), F.col(f"p{a}0") - F.col(f"t{a}1"))
    span = lambda a: F.greatest(F.col(f"t{a}1") - F.col(f"p{a}0"), F.col(f"p{a}1") - F.col(f"t{a}0"))
    near, far = (F.sqrt(f("x") * f("x") + f("y") * f("y")) for f in (gap, span))
    pairs = None
    for level in range(levels - 1, -1, -1):
        if pairs is None:
            own = ["space", "px", "py"]
            pairs = p[level].join(t[level], "space").withColumns({"near": near, "far": far})  # an eighth of the largest space: some dozens of tiles each
        else:
            own = ["space", "ux", "uy", "px", "py"]  # begins with the keys of the last join: no shuffle in between
            up = pairs.select("space", F.col("px").alias("ux"), F.col("py").alias("uy"), F.col("tx").alias("vx"), F.col("ty").alias("vy"), F.col("bound").alias("most"))
            one = p[level].withColumns({"ux": F.floor(F.col("px") / FACTOR), "uy": F.floor(F.col("py") / FACTOR)})
            two = t[level].withColumns({"vx": F.floor(F.col("tx") / FACTOR), "vy": F.floor(F.col("ty") / FACTOR)})
            pairs = up.join(two, ["space", "vx", "vy"]).join(one, ["space", "ux", "uy"]).withColumns({"near": near, "far": far})
            pairs = pairs.where(F.col("most").isNull() | (F.col("near") <= F.col("most") * (1 + 1e-12)))
        tile_of = Window.partitionBy(*own)
        if k > 1:
            held = F.sum("tn").over(tile_of.orderBy("far").rangeBetween(Window.unboundedPreceding, 0))
            pairs = pairs.withColumn("held", held).withColumn("bound", F.min(F.when(F.col("held") >= k, F.col("far"))).over(tile_of))
        else:
            pairs = pairs.withColumn("bound", F.min("far").over(tile_of))
        pairs = pairs.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-12))).select("space", "px", "py", "tx", "ty", "bound")
    return pairs


def _extent(*sides: DataFrame) -> float:
    every = sides[0].select("space", "x", "y")
    for s in sides[1:]:
        every = every.unionByName(s.select("space", "x", "y"))
    box = every.groupBy("space").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w"))
    return box.agg(F.max("w")).first()[0] or 0.0


def _near_pairs(points: DataFrame, targets: DataFrame, k: int, size: float) -> DataFrame:
    """space, px, py, src, dst, dist: each point with all targets of the tiles within its tile's reach."""
    at = lambda side: {f"{side}x": tile("x", size), f"{side}y": tile("y", size)}
    # of targets on one spot only the k smallest ids can be among the k nearest
    spot = Window.partitionBy("space", "x", "y").orderBy("id")
    targets = kept(targets.withColumn("_rn", F.row_number().over(spot)).where(F.col("_rn") <= k).drop("_rn").withColumns(at("t")))
    points = kept(points.withColumns(at("p")))
    reach = _within_reach(points, targets, k, _extent(points, targets), size)
    them = reach.join(targets.select("space", "tx", "ty", F.col("id").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y")), ["space", "tx", "ty"])
    both = points.select("space", "px", "py", F.col("id").alias("src"), "x", "y").join(them, ["space", "px", "py"])
    d = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
    return both.select("space", "px", "py", "src", "dst", d.alias("dist"))


def nearest(points: DataFrame, targets: DataFrame, size: float = TILE) -> DataFrame:
    """id, target, dist: the nearest target of each point within its space; ties go to the smaller target.

    points, targets: id, space, x, y; ids are unique. Points and targets are put into tiles, a descent over coarser
    tiles finds the few target tiles that can hold the nearest target of a tile, and only those are joined. A point
    whose space has no target gets nulls; a point that is a target has distance 0; points without a place are left out.
    """
    points, targets = _placed(points).select("id", "space", "x", "y"), _placed(targets).select("id", "space", "x", "y")
    able = targets.select("space").distinct()
    hit = _near_pairs(points, targets, 1, size).groupBy("space", "px", "py", F.col("src").alias("id")).agg(F.min(F.struct("dist", "dst")).alias("n"))
    none = points.join(able, "space", "left_anti").select("id")
    return hit.select("id", F.col("n.dst").alias("target"), F.col("n.dist").alias("dist")).unionByName(none, allowMissingColumns=True)


def nearest_k(points: DataFrame, k: int, size: float = TILE) -> DataFrame:
    """src, dst, dist, rank: the k nearest other points of each point in its space, ties by id; fewer if there are no more.

    As nearest, with the tiles that can hold one of the k + 1 nearest, the point itself included. Coincident points are
    neighbours at distance 0.
    """
    points = _placed(points).select("id", "space", "x", "y")
    order = Window.partitionBy("space", "px", "py", "src").orderBy("dist", "dst")
    pairs = _near_pairs(points, points, k + 1, size).where("src <> dst")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "dist", "rank")


def neighbour_shares(points: DataFrame, radius: float, itself: bool) -> DataFrame:
    """id, label, n, share: the mix of labels among the neighbours of each point within radius.

    points: id, space, x, y, label. With itself the point counts as its own neighbour; without, it does not, and a
    point with no neighbour has no rows. Points with a null label are no neighbours, but have some.
    """
    named = points.where("label is not null")
    pairs = radius_pairs(points, named, radius)
    if not itself:
        pairs = pairs.where("src <> dst")
    n = pairs.join(named.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("id")))


def neighbour_mean(points: DataFrame, values: DataFrame, radius: float) -> DataFrame:
    """id, gene, mean: the mean over the neighbours within radius (the point included); absent values count as 0.

    values: id, gene, value (zeros absent). Genes that no neighbour has are absent.
    """
    pairs = kept(radius_pairs(points, points, radius).select("src", "dst"))
    n = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    sums = pairs.join(values.select(F.col("id").alias("dst"), "gene", "value"), "dst").groupBy("src", "gene").agg(F.sum("value").alias("s"))
    return sums.join(n, "src").select(F.col("src").alias("id"), "gene", (F.col("s") / F.col("n")).alias("mean"))


def delaunay_edges(points: DataFrame, longest: float, halo: float | None = None) -> DataFrame:
    """space, src < dst, dist: edges of the Delaunay graph not longer than longest (ties kept).

    An edge belongs to it if some circle through both ends holds no other point. The centre lies on the bisector at
    t; every other point bounds t from one side, so the edge stands if the largest lower bound does not exceed the
    smallest upper bound. Points within the halo of the middle (at first half of longest) decide, and refuse most
    pairs at once; where the smallest such circle leaves the halo, the edge is judged again with four times the halo, and
    so on until the halo holds the whole space. Of four points on one circle both diagonals stand. Coincident points
    are joined to each other and to the same neighbours.
    """
    halo = halo or longest / 2
    points = kept(_placed(points).select("id", "space", "x", "y"))
    edges = _reached(points, points, longest).where("src < dst").select("space", "src", "dst", "dist", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("_x").alias("bx"), F.col("_y").alias("by"))
    box = points.groupBy("space").agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).toDF("space", "w", "h")
    extent = box.agg(F.max(F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")))).first()[0] or 0.0
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    vx, vy = F.col("cx") - F.col("mx"), F.col("cy") - F.col("my")
    beside = 2 * (vx * -uy + vy * ux)
    over = vx * vx + vy * vy - (ux * ux + uy * uy) / 4
    bound = over / F.when(beside != 0, beside)
    out = None
    while True:
        last = halo > 2 * extent
        third = _spread(points, halo, halo).select("space", "_gx", "_gy", F.col("dst").alias("third"), F.col("_x").alias("cx"), F.col("_y").alias("cy"))
        e = edges.withColumns({"mx": mx, "my": my}).withColumns({"_gx": tile("mx", halo), "_gy": tile("my", halo)}).join(third, ["space", "_gx", "_gy"])  # both ends are there themselves
        decides = (F.col("third") != F.col("src")) & (F.col("third") != F.col("dst")) & (F.sqrt(vx * vx + vy * vy) <= halo)
        e = e.groupBy("space", "src", "dst", "dist", "ax", "ay", "bx", "by").agg(
            F.max(F.when(decides & (beside < 0), bound)).alias("low"), F.min(F.when(decides & (beside > 0), bound)).alias("high"), F.max(F.when(decides & (beside == 0) & (over < 0), 1).otherwise(0)).alias("between"))
        lo, hi = F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf")))
        e = e.where("between = 0").withColumn("lo", lo).withColumn("hi", hi).where(F.col("lo") <= F.col("hi") + F.lit(1e-9) * (1 + F.abs("hi")))
        t = F.greatest(F.lit(0.0), F.col("lo"), -F.col("hi"))  # distance of the smallest circle's centre, in edge lengths
        e = cut(e.select("space", "src", "dst", "dist", "ax", "ay", "bx", "by", ((t + F.sqrt(t * t + 0.25)) * F.col("dist")).alias("reach")))
        sure = e.where((F.col("reach") <= halo) | F.lit(last)).select("space", "src", "dst", "dist")
        out = sure if out is None else out.unionByName(sure)
        edges = e.where(F.col("reach") > halo).drop("reach")
        if last or not edges.limit(1).count():
            return out
        halo *= 4


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (src < dst) as directed ones, each in both directions."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def rings(edges: DataFrame, layers: int) -> DataFrame:
    """src, dst, layer: points first reached over `layer` edges; edges are directed both ways."""
    near = edges.select("src", "dst").distinct()
    seen = near.withColumn("layer", F.lit(1))
    front = seen
    for k in range(2, layers + 1):
        step = front.select("src", F.col("dst").alias("via")).join(near.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct().where("src <> dst")
        front = cut(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("layer", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def dense_aggregates(points: DataFrame, eps: float, least: int) -> DataFrame:
    """id, cluster, core: density-based clusters (DBSCAN). cluster is the smallest core id of the cluster.

    A core point has at least `least` points within eps, itself included; core points within eps of each other are
    one cluster; other points within eps of a core point join the smallest such cluster. Noise has no row.
    """
    return placed_aggregates(points, eps, least).select("id", "cluster", "core")


#: Side of the tiles in which links are contracted first, in eps.
BLOCK = 40


def placed_aggregates(points: DataFrame, eps: float, least: int) -> DataFrame:
    """id, space, x, y, cluster, core: dense_aggregates with the places of the points, whose ids are unique.

    Neighbours are counted where the pairs arise; core points are then paired with each other by place once more, and
    so are the others with them, which moves less than joining all pairs to the core points would.
    """
    from cellgrove.operators.components import pair_components

    at = ["space", "x", "y"]
    n = _reached(points, points, eps).groupBy(F.col("src").alias("id"), *at).agg(F.count(F.lit(1)).alias("n"))
    counted = cut(n.select("id", *at, (F.col("n") >= least).alias("core")))
    core = counted.where("core")
    links = _reached(core, core, eps).where("src < dst").select("src", "dst", "space", tile("x", BLOCK * eps).alias("_bx"), tile("y", BLOCK * eps).alias("_by"))
    label = pair_components(links, ["space", "_bx", "_by"]).withColumnRenamed("record", "id")
    members = cut(core.join(label, "id", "left").select("id", *at, F.coalesce("label", "id").alias("cluster"), "core"))
    near = _met(counted.where("not core"), _spread(members, eps, 2 * eps, ("cluster",)), eps, 2 * eps)
    rim = near.groupBy(F.col("src").alias("id"), *at).agg(F.min("dst_cluster").alias("cluster"))
    return members.unionByName(rim.withColumn("core", F.lit(False)))
