import math
import random
import threading

from pyspark.sql import functions as F

from cellgrove.operators import models as md
from cellgrove.operators import neighbours as nb
from cellgrove.operators.components import pair_components
from cellgrove.queries import base, tissue

POINT = "id string, space string, x double, y double, is_tumour boolean"
DATA = "/root/testdata/sf0.001"


def test_pairs_are_contracted_in_chunks(spark):
    rng = random.Random(5)
    names = [f"S{i:03d}" for i in range(300)]
    pairs = [(rng.choice(names), rng.choice(names), rng.randrange(4)) for _ in range(200)] + [(f"é{i}", f"é{i + 1}", i % 3) for i in range(40)]
    least = {}
    for a, b, _ in pairs:
        least |= {a: a} if a not in least else {}
        least |= {b: b} if b not in least else {}
    for _ in least:
        for a, b, _ in pairs:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(pairs, "src string, dst string, part int")
    for chunk in (3, 40, 1000):  # ties that fit no chunk, ties that fit one, no ties within a part
        got = [tuple(r) for r in pair_components(df, ["part"], chunk).collect()]
        assert dict(got) == least and len(got) == len(least)


def test_points_lie_in_few_cells(spark, rows):
    rng = random.Random(6)
    p = [(f"c{i}", "s", rng.uniform(-100, 100), rng.uniform(-100, 100), None) for i in range(300)] + [("a", "t", 0.0, 0.0, None), ("b", "t", 15.0, 0.0, None), ("c", "t", -15.0, 0.0, None), ("d", "t", 15.0001, 15.0, None)]
    df = spark.createDataFrame(p, POINT)
    assert nb._spread(df, 15.0, 30.0).count() < 4.6 * len(p)
    want = sorted((a[0], b[0]) for a in p for b in p if a[1] == b[1] and math.dist(a[2:4], b[2:4]) <= 15)
    assert rows(nb.radius_pairs(df, df, 15.0).select("src", "dst")) == want


def test_only_other_cells_look_for_tumour(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(base, "nearest", lambda points, targets: asked.append(points) or nb.nearest(points, targets))
    df = spark.createDataFrame([("a", "s", 0.0, 0.0, True), ("b", "s", 3.0, 4.0, False), ("c", "s", 3.0, 4.0, None), ("d", "t", 0.0, 0.0, False)], POINT)
    assert {r.id: r.d for r in base.with_distance(df).collect()} == {"a": 0.0, "b": 5.0, "c": 5.0, "d": None}
    assert {r.id for r in asked[0].collect()} == {"b", "c", "d"}


def _shown(spark, monkeypatch, query):
    seen = []

    def near(cells, *tumour):
        seen.extend(r[0] for r in cells.select("cell_type").distinct().collect())
        return base.with_distance(cells, *tumour)

    monkeypatch.setattr(tissue, "with_distance", near)
    query(spark, DATA).collect()
    return set(seen)


def test_states_look_at_their_cells_only(spark, monkeypatch):
    assert _shown(spark, monkeypatch, tissue.cd8_states) <= {"CD8 T (GZMK+)"}


def test_ratio_looks_at_its_two_types_only(spark, monkeypatch):
    assert _shown(spark, monkeypatch, tissue.ratio_by_band) <= {"CD8 T (GZMK+)", "CD163+ macrophage"}


def test_export_needs_no_distance(spark, monkeypatch):
    assert not _shown(spark, monkeypatch, tissue.viewer_export)
    assert tissue.viewer_export(spark, DATA).count() == base.tissue(spark, DATA).count()


def test_mixtures_are_fitted_at_once(spark, monkeypatch):
    both = threading.Barrier(2, timeout=90)

    class Waiting(md.GaussianMixture):
        def fit(self, df):
            both.wait()  # breaks if fits follow each other
            return super().fit(df)

    monkeypatch.setattr(md, "GaussianMixture", Waiting)
    df = spark.range(40).select("id", md.array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") % 2).cast("double"))).alias("features"))
    got = md.stable_mixtures(df, "id", [2, 3], 2).collect()
    assert [r.k for r in got] == [2, 3] and all(0 <= r.stability <= 1 for r in got)
