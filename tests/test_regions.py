import math
import random

from pyspark.sql import functions as F

from cellgrove.operators.neighbours import delaunay_edges, dense_aggregates, nearest, nearest_k, neighbour_mean, neighbour_shares, radius_pairs, rings
from cellgrove.operators.regions import boxes, contacts_against_record, near_points, points_in_regions, rectangles


def cloud(n, seed, spaces=("s", "t"), side=100.0):
    r = random.Random(seed)
    return [(f"p{i:04d}", spaces[i % len(spaces)], round(r.uniform(0, side), 2), round(r.uniform(0, side), 2)) for i in range(n)]


def test_near_points_equals_brute_force(spark, rows):
    a, b = cloud(150, 1), [(i.replace("p", "q"), s, x, y) for i, s, x, y in cloud(150, 2)]
    a += [("dup1", "s", 5.0, 5.0), ("dup2", "s", 5.0, 5.0), ("null", "s", None, 5.0), ("nospace", None, 5.0, 5.0), ("nan", "s", float("nan"), 1.0)]
    b += [("edge", "s", 20.0, 5.0), ("beyond", "s", 20.000001, 5.0)]
    pts = spark.createDataFrame(a, "point_id string, space string, px double, py double").withColumn("extra", F.lit(1))
    ctr = spark.createDataFrame(b, "region_id string, space string, cx double, cy double").withColumn("px", F.lit(0.0))
    got = {(r.point_id, r.region_id) for r in near_points(pts, ctr, 15.0, bin_rows=20).collect()}
    want = {(p, q) for p, s, x, y in a for q, t, u, v in b if s == t and s and x is not None and math.dist((x, y), (u, v)) <= 15}
    assert got == want and ("dup1", "edge") in got and ("dup1", "beyond") not in got


def star(n, r, cx, cy, rng):
    """A star-shaped polygon as its corners."""
    return [(cx + rng.uniform(0.3, 1) * r * math.cos(2 * math.pi * k / n), cy + rng.uniform(0.3, 1) * r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def inside(p, poly):
    x, y = p
    odd = False
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_polygons_equal_brute_force(spark):
    rng = random.Random(3)
    polys = {f"r{k}": star(9, 30, rng.uniform(10, 90), rng.uniform(10, 90), rng) for k in range(8)}
    pts = cloud(300, 4, ("s",))
    edges = [("s", k, *a, *b) for k, p in polys.items() for a, b in zip(p, p[1:] + p[:1])]
    pf = spark.createDataFrame(pts, "point_id string, space string, px double, py double")
    ef = spark.createDataFrame(edges, "space string, region_id string, x1 double, y1 double, x2 double, y2 double")
    want = {(i, k) for i, _, x, y in pts for k, p in polys.items() if inside((x, y), p)}
    for boundary in ("closed", "half_open"):
        got = {(r.point_id, r.region_id) for r in points_in_regions(pf, ef, strip=7.0, width=11.0, boundary=boundary, bin_rows=5).collect()}
        assert got == want


def test_boundaries_are_explicit(spark):
    square = [("s", "a", 0.0, 0.0, 10.0, 0.0), ("s", "a", 10.0, 0.0, 10.0, 10.0), ("s", "a", 10.0, 10.0, 0.0, 10.0), ("s", "a", 0.0, 10.0, 0.0, 0.0)]
    pts = [("corner", "s", 0.0, 0.0), ("top", "s", 5.0, 10.0), ("right", "s", 10.0, 5.0), ("left", "s", 0.0, 5.0), ("in", "s", 5.0, 5.0), ("out", "s", 10.1, 5.0), ("far", "s", 5.0, 10.1), ("topcorner", "s", 10.0, 10.0)]
    pf = spark.createDataFrame(pts, "point_id string, space string, px double, py double")
    ef = spark.createDataFrame(square + square[:1], "space string, region_id string, x1 double, y1 double, x2 double, y2 double")
    closed = {r.point_id for r in points_in_regions(pf, ef, 4.0).collect()}
    assert closed == {"corner", "top", "right", "left", "in", "topcorner"}
    half = {r.point_id for r in points_in_regions(pf, ef, 4.0, boundary="half_open").collect()}
    assert half == {"corner", "left", "in"}
    none = spark.createDataFrame([], pf.schema)
    assert points_in_regions(none, ef, 4.0).count() == 0 and points_in_regions(pf, ef.limit(0), 4.0).count() == 0


def test_contacts_against_record(spark, rows):
    c = [("b", "s", 0.0, 0.0, True, None), ("a", "s", 3.0, 4.0, False, 99.0), ("c", "s", 3.0, 4.0, False, 5.0), ("d", "s", 3.0, 4.0, False, float("nan")), ("e", "s", 3.0, 4.0, None, None), ("f", "t", 3.0, 4.0, False, None), ("g", "s", None, 4.0, False, None)]
    df = spark.createDataFrame(c, "cell_id string, section_id string, x_um double, y_um double, is_tumour boolean, dist_to_tumour_um double")
    assert rows(contacts_against_record(df)) == [("a", "b"), ("b", "d")]


def test_rectangles_and_boxes(spark):
    f = spark.createDataFrame([("s", "A", 0.0, 0.0, 10.0, 10.0)], "space string, region_id string, x double, y double, width double, height double")
    assert rectangles(f).count() == 2
    assert boxes(spark.createDataFrame([("s", "a", 1.0, 1.0)], "space string, region_id string, cx double, cy double"), 2).count() == 2


def test_neighbour_joins(spark, rows):
    p = cloud(120, 5)
    df = spark.createDataFrame(p, "id string, space string, x double, y double")
    dist = lambda a, b: math.dist(a[2:], b[2:])
    pairs = {(r.src, r.dst) for r in radius_pairs(df, df, 12.0).collect()}
    assert pairs == {(a[0], b[0]) for a in p for b in p if a[1] == b[1] and dist(a, b) <= 12}
    k = {}
    for r in nearest_k(df, 4, 5.0).collect():
        k.setdefault(r.src, {})[r["rank"]] = r.dst
    for a in p:
        best = sorted((dist(a, b), b[0]) for b in p if b[1] == a[1] and b[0] != a[0])[:4]
        assert [k[a[0]][i + 1] for i in range(4)] == [x for _, x in best]
    t = df.where("id like '%7'")
    got = {r.id: r.target for r in nearest(df, t, 5.0).collect()}
    ts = [b for b in p if b[0].endswith("7")]
    for a in p:
        own = [(dist(a, b), b[0]) for b in ts if b[1] == a[1]]
        assert got[a[0]] == (min(own)[1] if own else None)


def test_neighbour_summaries(spark, rows):
    pts = spark.createDataFrame([(1, "s", 0.0, 0.0, "a"), (2, "s", 5.0, 0.0, "b"), (3, "s", 100.0, 0.0, "a"), (4, "s", 0.0, 5.0, None)], "id int, space string, x double, y double, label string")
    assert rows(neighbour_shares(pts, 10.0, itself=False)) == [(1, "b", 1, 1.0), (2, "a", 1, 1.0), (4, "a", 1, 0.5), (4, "b", 1, 0.5)]
    assert (3, "a", 1, 1.0) in rows(neighbour_shares(pts, 10.0, itself=True))
    v = spark.createDataFrame([(1, "g", 4.0), (3, "g", 10.0)], "id int, gene string, value double")
    assert [(r[0], round(r[2], 9)) for r in rows(neighbour_mean(pts.drop("label"), v, 6.0))] == [(1, round(4 / 3, 9)), (2, 2.0), (3, 10.0), (4, 2.0)]


def test_delaunay_equals_empty_circles(spark):
    p = [(i, "s", x, y) for i, (_, _, x, y) in enumerate(cloud(40, 6, ("s",), 60.0))]
    got = {(r.src, r.dst) for r in delaunay_edges(spark.createDataFrame(p, "id int, space string, x double, y double"), 25.0, halo=13.0).collect()}
    import itertools

    want = set()
    for a, b, c in itertools.combinations(p, 3):  # a triangle whose circle is empty gives three edges
        (ax, ay), (bx, by), (cx, cy) = a[2:], b[2:], c[2:]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = math.dist((ux, uy), (ax, ay))
        if all(math.dist((ux, uy), q[2:]) >= r - 1e-9 for q in p):
            want |= {tuple(sorted((x[0], y[0]))) for x, y in ((a, b), (b, c), (a, c)) if math.dist(x[2:], y[2:]) <= 25}
    assert got == want


def test_dense_aggregates_and_rings(spark, rows):
    p = [(i, "s", float(i % 5), float(i // 5)) for i in range(25)] + [(30, "s", 4.0, 6.4), (40, "s", 90.0, 90.0)] + [(50 + i, "s", 50.0, 50.0) for i in range(9)]
    got = {r.id: (r.cluster, r.core) for r in dense_aggregates(spark.createDataFrame(p, "id int, space string, x double, y double"), 2.5, 9).collect()}
    assert {got[i][0] for i in range(25)} == {got[12][0]} and 40 not in got and got[30] == (got[12][0], False)
    assert {got[50 + i] for i in range(9)} == {(50, True)}  # copies of one place are a cluster
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)], "src int, dst int")
    assert rows(rings(e, 3).where("src = 1")) == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]
