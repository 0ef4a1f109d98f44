import json

import pytest
from pyspark.sql import functions as F

from cellgrove.operators import labels as lb
from cellgrove.operators import matrix as mx
from cellgrove.operators.regions import points_in_regions
from cellgrove.sources import formats as fm


def test_unlabelled_cluster_is_named(spark, rows):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, cluster string")
    t = spark.createDataFrame([("a", "T", "L"), ("a", "T", "L"), ("b", "U", "M")], "cluster string, cell_type string, lineage string")
    assert rows(lb.apply_coarse(c, "cluster", t).select("id", "cell_type", "lineage")) == [(1, "T", "L"), (2, "U", "M"), (3, None, None)]
    with pytest.raises(ValueError, match="b"):
        lb.apply_coarse(c, "cluster", t.where("cluster = 'a'"))


def test_guard_markers(spark):
    r = spark.createDataFrame([("g", f"m{i}", i) for i in range(1, 15)], "grp string, gene string, rank int")
    lb.guard_markers(r, spark.createDataFrame([("g", "m10")], "grp string, gene string"))
    with pytest.raises(ValueError, match="m11"):
        lb.guard_markers(r, spark.createDataFrame([("g", "m11")], "grp string, gene string"))


def test_merge_priority(spark, rows):
    c = spark.createDataFrame([(1, "T", "T / NK", "high"), (2, "Mac", "Myeloid", "high"), (3, "B", "B / plasma", "mixed"), (4, None, None, None)], "id int, cell_type string, lineage string, conf string")
    f = spark.createDataFrame([(1, "NK", "low", False), (2, "cDC2", "high", True)], "id int, fine_type string, fine_conf string, from_subset boolean")
    o = spark.createDataFrame([("NK", "Innate"), ("cDC2", "Other")], "cell_type string, lineage string")
    assert rows(lb.merge_labels(c, f, o)) == [(1, "NK", "Innate", "low"), (2, "cDC2", "Myeloid", "high"), (3, "B", "B / plasma", "mixed"), (4, None, None, None)]


def test_rates_rules_and_verdicts(spark):
    r = spark.createDataFrame([(30.0, 60.0, 19.0, 25.0, 0.0, 0.0, 24.0, 0.0, None), (29.0, 60.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "cd4 double, t double, cd8a double, foxp3 double, f1 double, f2 double, f3 double, f4 double, f5 double")
    assert [(x.clean, x.regulatory) for x in lb.clean_t_helper(r).collect()] == [(True, True), (False, False)]
    v = lb.verdicts(spark.createDataFrame([(0.4, None)], "a double, b double"), [("q", "a", 0.4, "yes", "no"), ("r", "b", 1.0, "yes", "no")])
    assert {x.question: x.verdict for x in v.collect()} == {"q": "yes", "r": "not scored"}
    h = lb.head_and_tail(spark.createDataFrame([(i, i // 2) for i in range(10)], "k int, v int"), "v", "k", 2)
    assert {x.k for x in h.collect()} == {0, 1, 8, 9}


def test_gene_sets_of_one_gene_are_dropped(spark):
    x = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "c", 2.0), (2, "d", 1.0)], "cell_id int, gene string, lognorm double")
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id int")
    s = spark.createDataFrame([("s", "a"), ("s", "b"), ("lone", "a"), ("lone", "zzz")], "name string, gene string")
    got = {(r.cell_id, r.name): r.score for r in mx.gene_set_scores(x, cells, s, bins=1, controls=1).collect()}
    assert set(got) == {(1, "s"), (2, "s"), (3, "s")} and got[1, "s"] == pytest.approx(2.0) and got[2, "s"] == pytest.approx(-1.5) and got[3, "s"] == 0


def test_adapter_and_windows(spark, rows):
    a = fm.Adapter(cell_id="CID", control_columns=("neg", "blank"))
    c = a.cells(spark.createDataFrame([(7, 1.0, 2.0, 1, None)], "CID int, x double, y double, neg int, blank int")).first()
    assert (c.cell_id, c.control_counts) == ("7", 1.0)
    t = spark.createDataFrame([("EPCAM", "UNASSIGNED", 25.0, 1.0, 1.0), ("NegControlX", "c1", 30.0, 2.0, 2.0), ("KRT8", "c1", 10.0, 3.0, 3.0)], "feature_name string, cell_id string, qv double, x_location double, y_location double")
    got = a.transcripts(t)
    assert rows(got.select("feature", "cell_id", "is_gene")) == [("EPCAM", None, True), ("NegControlX", "c1", False)]
    assert rows(fm.window_of(got, 1.0, 3.0, 0.0, 3.0).select("feature")) == [("NegControlX",)]


def test_rectangles_from_json_and_units(spark, tmp_path):
    p = tmp_path / "f.json"
    p.write_text(json.dumps({"units": "microns", "fov_locations": {"A1": {"x": 0, "y": 1.5, "width": 10, "height": 20}}}, indent=1))
    assert [tuple(r) for r in fm.fov_json(spark, str(p)).collect()] == [("A1", 0.0, 1.5, 10.0, 20.0)]
    p.write_text(json.dumps({"units": "pixels", "fov_locations": {}}))
    with pytest.raises(ValueError):
        fm.fov_json(spark, str(p)).collect()


def test_outlines_and_what_they_hold(spark):
    v = spark.createDataFrame([("c", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])] + [("d", 0, 1.0, 1.0)], "cell_id string, ord int, x double, y double")
    o = fm.polygons(v.orderBy(F.rand(1)))
    assert {r.cell_id: r.area for r in o.collect()} == {"c": 12.0, "d": 0.0}
    pts = spark.createDataFrame([("p", "s", 2.0, 2.0), ("q", "s", 5.0, 2.0)], "point_id string, space string, px double, py double")
    e = fm.polygon_edges(o.withColumn("section", F.lit("s")), "section")
    assert [r.point_id for r in points_in_regions(pts, e, 2.0).where("region_id = 'c'").collect()] == ["p"]


def test_round_trips(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, label string")
    fm.save_table(df, str(tmp_path / "t"))
    fm.save_labels(df, str(tmp_path / "l"))
    fm.save_step(df, str(tmp_path / "s"), ["id"])
    assert rows(fm.label_csv(spark, str(tmp_path / "t"), "id int, label string")) == rows(df) == rows(fm.label_csv(spark, str(tmp_path / "l"), "id int, label string")) == rows(spark.read.parquet(str(tmp_path / "s")))
