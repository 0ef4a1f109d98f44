"""Permutations computed from ranks, and enrichment per space on them, against brute force."""

import random
from collections import Counter, defaultdict
from statistics import fmean, pstdev

import numpy as np
import pytest

from cellgrove.operators.neighbours import banded_pairs, delaunay_edges
from cellgrove.operators.permutations import dealt, space_enrichment


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000])
def test_dealt_is_a_permutation(n):
    for row in dealt(np.arange(n), n, np.arange(20), 7):
        assert sorted(row) == list(range(n))
    part = np.arange(0, n, 3)  # a rank's place does not depend on the other ranks asked for
    assert (dealt(part, n, np.arange(20), 7) == dealt(np.arange(n), n, np.arange(20), 7)[:, part]).all()


def test_dealt_is_even():
    n, perms = 10, 20_000
    places = dealt(np.arange(n), n, np.arange(perms), 3)
    for a in range(n):
        seen = np.bincount(places[:, a], minlength=n)
        assert ((seen - perms / n) ** 2 / (perms / n)).sum() < 40  # chi-square, 9 degrees of freedom
    pairs = np.bincount(places[:, 0] * n + places[:, 1], minlength=n * n)
    expected = perms / (n * (n - 1))
    assert sum((pairs[i * n + j] - expected) ** 2 / expected for i in range(n) for j in range(n) if i != j) < 160  # 89 degrees


def test_enrichment_per_space(spark):
    rng, perms = random.Random(4), 60
    points = [(f"{s}{i:02}", s, "abc"[min(2, i % 5)] if s == "s" else "ad"[i % 2]) for s in ("s", "t") for i in range(30)]
    edges = sorted({(s, *sorted((f"{s}{rng.randrange(30):02}", f"{s}{rng.randrange(30):02}"))) for s in ("s", "t") for _ in range(80)})
    edges = [e for e in edges if e[1] != e[2]]
    df = spark.createDataFrame(points + [("x", "s", None), (None, "s", "a"), ("y", None, "a")], "id string, space string, value string")
    got = space_enrichment(spark.createDataFrame(edges + [("s", "s00", "x"), ("s", None, "s01")], "space string, src string, dst string"), df, perms, 5)
    got = {(r.space, r.a, r.b): r for r in got.collect()}
    keys = {r.space: r.k for r in df.where("space is not null").selectExpr("space", "xxhash64(space) as k").distinct().collect()}
    seen, null = defaultdict(Counter), defaultdict(list)
    for s in ("s", "t"):
        order = sorted((v, i) for i, sp, v in points if sp == s)
        place = {i: k for k, (_, i) in enumerate(order)}
        tables = [{i: order[k][0] for i, k in place.items()}] + [{i: order[row[k]][0] for i, k in place.items()} for row in dealt(np.arange(30), 30, np.arange(perms), 5 ^ keys[s])]
        counts = [Counter(pair for sp, a, b in edges if sp == s for pair in ((t[a], t[b]), (t[b], t[a]))) for t in tables]
        kinds = sorted({v for v, _ in order})
        for a in kinds:
            for b in kinds:
                seen[s][a, b] = counts[0][a, b]
                null[s, a, b] = [c[a, b] for c in counts[1:]]
    assert set(got) == set(null)
    for k, n in null.items():
        r, obs = got[k], seen[k[0]][k[1:]]
        assert r.n == obs and r.expected == pytest.approx(fmean(n)) and r.sd == pytest.approx(pstdev(n), abs=1e-9)
        assert r.p == pytest.approx((1 + sum(x >= obs for x in n)) / (perms + 1))
    empty = space_enrichment(spark.createDataFrame([], "space string, src string, dst string"), df.limit(0), perms)
    assert empty.count() == 0


def test_delaunay_with_far_circles(spark):
    # nearly collinear points on a hull: the circles are far larger than the first halo
    points = [(i, "a", 10.0 * i, 0.001 * (i - 5) ** 2) for i in range(11)] + [(20, "a", 50.0, 400.0)]
    df = spark.createDataFrame(points, "id int, space string, x double, y double")
    got = {(r.src, r.dst) for r in delaunay_edges(df, 30.0).collect()}
    xy = {i: (x, y) for i, _, x, y in points}

    def stands(i, j):
        (ax, ay), (bx, by) = xy[i], xy[j]
        mx, my, ux, uy, lo, hi = (ax + bx) / 2, (ay + by) / 2, bx - ax, by - ay, float("-inf"), float("inf")
        for k, (cx, cy) in xy.items():
            if k not in (i, j):
                vx, vy = cx - mx, cy - my
                side, over = 2 * (vx * -uy + vy * ux), vx * vx + vy * vy - (ux * ux + uy * uy) / 4
                if side < 0:
                    lo = max(lo, over / side)
                elif side > 0:
                    hi = min(hi, over / side)
                elif over < 0:
                    return False
        return lo <= hi + 1e-9 * (1 + abs(hi))

    want = {(i, j) for i in xy for j in xy if i < j and (xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2 <= 900 and stands(i, j)}
    assert got == want and len(want) >= 10


def test_banded_pairs(spark):
    rng = random.Random(8)
    points = [(i, "st"[i % 2], rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice(["a", "b", None])) for i in range(60)]
    points += [(60, "s", 0.0, 0.0, "a"), (61, "s", 0.0, 0.0, "b"), (62, "s", 45.0, 0.0, "a"), (63, "s", 5.0, 0.0, "b"), (64, None, 1.0, 1.0, "a"), (65, "s", None, 1.0, "a")]
    got = {(r.space, r.band, r.a, r.b): r.n for r in banded_pairs(spark.createDataFrame(points, "id int, space string, x double, y double, label string"), 5.0, 45.0, 8).collect()}
    want = Counter()
    for i, s, x, y, a in points:
        for j, t, u, v, b in points:
            if i != j and s is not None and s == t and None not in (x, u, a, b):
                d = ((x - u) ** 2 + (y - v) ** 2) ** 0.5
                for k in range(8):
                    if 5 + 5 * k < d <= 10 + 5 * k:
                        want[s, k, a, b] += 1
    assert got == dict(want)
