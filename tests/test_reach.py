import math
import random

import pytest
from pyspark.sql import functions as F

from cellgrove.functions import chi2_tail, normal_tail, t_two_sided
from cellgrove.operators import matrix as mx
from cellgrove.operators import neighbours as nb
from cellgrove.operators import qc
from cellgrove.operators import stats as st
from cellgrove.operators import tissue as ts
from cellgrove.plans import few, kept, release, running_total

POINT = "id int, space string, x double, y double"


def test_nearest_of_far_and_odd_points(spark):
    rng = random.Random(1)
    p = [(i, "s", rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(300)] + [(400, "s", float("nan"), 1.0), (401, "s", float("inf"), 1.0), (402, None, 1.0, 1.0), (403, "t", 1.0, 1.0), (404, "s", None, 1.0)]
    t = [(1000 + i, "s", 5000 + rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(100)] + [(2000 + i, "s", 4990.0, 7.0) for i in range(50)]
    df, tf = spark.createDataFrame(p, POINT).withColumn("dist", F.lit(1)), spark.createDataFrame(t, POINT)
    got = {r.id: (r.target, r.dist) for r in nb.nearest(df, tf).collect()}
    for i, s, x, y in p[:300]:
        d, best = min((math.dist((x, y), q[2:]), q[0]) for q in t)
        assert got[i][0] == best and abs(got[i][1] - d) < 1e-9
    assert got[403] == (None, None) and set(got) == {*range(300), 403}
    assert nb.nearest(df.limit(0), tf).count() == 0 and {r.target for r in nb.nearest(df, tf.limit(0)).collect()} == {None}


def test_far_targets_are_met_tile_by_tile(spark):
    rng = random.Random(2)
    n = 1500
    pf = spark.createDataFrame([(i, "s", rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(n)], POINT)
    tf = spark.createDataFrame([(i, "s", 9000 + rng.uniform(0, 2000), rng.uniform(0, 2000)) for i in range(n)], POINT)
    assert nb._near_pairs(pf, tf, 1, nb.TILE).count() < n * n / 20  # all pairs would be 2.25 million; a ring two tiles wide is left


def test_nearest_k_of_copies(spark):
    df = spark.createDataFrame([(i, "s", 1.0, 1.0) for i in range(40)] + [(50, "s", 2.0, 1.0), (60, "t", 0.0, 0.0)], POINT)
    got = {}
    for r in nb.nearest_k(df, 3).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3)] and sorted(got[39]) == [(1, 0), (2, 1), (3, 2)] == sorted(got[50]) and 60 not in got


def test_tails(spark):
    z = [-40.0, -6.5, -1.0, 0.0, 0.3, 2.0, 7.0, 7.2, 12.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(normal_tail("z")).collect()]
    assert all(abs(g - math.erfc(v / math.sqrt(2)) / 2) <= 1e-12 * max(g, 1e-300) + 1e-15 for g, v in zip(got, z, strict=True))
    # known values: chi-square 3.841459 and 18.307038 leave 5 %, t of 2.200985 with 11 and 2.228139 with 10 degrees leave 5 %
    c = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (18.307038053275146, 10), (19.675137572682495, 11), (0.0, 3), (None, 2), (1.0, 0), (5000.0, 4)], "x double, k int")
    p = [r[0] for r in c.select(chi2_tail("x", "k")).collect()]
    assert all(abs(v - 0.05) < 1e-9 for v in p[:4]) and p[4] == 1.0 and p[5] is None and p[6] is None and p[7] == 0.0
    t = spark.createDataFrame([(2.2009851600829, 2.2281388519649), (0.0, None)], "a double, b double").select(t_two_sided("a", 11), t_two_sided("b", 10)).collect()
    assert abs(t[0][0] - 0.05) < 1e-9 and abs(t[0][1] - 0.05) < 1e-9 and t[1][0] == 1.0 and t[1][1] is None


def test_baseline_is_of_all_other_cells(spark):
    rows = [("T", False, 10.0)] * 5 + [("T", False, 200.0)] * 5 + [("X", False, 10.0)] * 30 + [("tumour", True, 0.0)] * 50 + [("T", False, None)]
    df = spark.createDataFrame(rows, "cell_type string, is_tumour boolean, d double")
    r = ts.infiltration(df, F.col("cell_type") == "T").collect()
    assert [(x.cell_type, x.n, x.pct_contact, x.versus) for x in r] == [("T", 10, 50.0, "excluded")]  # 35 of 40 are in contact


def test_sensitivity_has_a_row_per_pair_of_cutoffs(spark):
    t = spark.createDataFrame([(30.0, 10.0, 40.0), (80.0, 30.0, 50.0), (200.0, 10.0, 100.0), (None, None, 1.0)], "total_density double, intra_density double, stroma_density double")
    got = {(r.desert_below, r.least_ratio): (r.inflamed, r.excluded, r.desert) for r in ts.sensitivity(t.limit(3)).collect()}
    assert len(got) == 9 and got[25.0, 0.5] == (33.333333, 66.666667, 0.0) and got[100.0, 0.7] == (0.0, 33.333333, 66.666667)
    assert ts.sensitivity(t).count() == 9


def test_sums_over_batches_and_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, None]), i, rng.choice([0, 1, 5, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, j int, o int, v int").withColumn("_b", F.lit(1))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.o: r.running for r in running_total(df, ["k", "j"], ["o"], "v", parts=5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, sums = {}, {}
    for k, j, o, v in rows:
        sums[k, j] = sums.get((k, j), 0) + (v or 0)
        want[o] = sums[k, j]
    assert got == want
    halves = running_total(df.withColumn("v", F.col("v") / 2.0), [], [F.col("o").desc()], "v").where("o = 0").first().running
    assert abs(halves - sum((r[3] or 0) / 2 for r in rows)) < 1e-6


def test_small_tables_and_release(spark):
    assert few(spark.range(5), 4)._jdf.queryExecution().toString().count("broadcast") == 0
    k = kept(spark.range(3))
    assert k.count() == 3 and k.storageLevel.useMemory
    release()
    assert not k.storageLevel.useMemory and k.count() == 3


def test_samples_and_bounds(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 20 + i) for i in range(3)], "label string, id int")
    assert {r[0]: r[1] for r in mx.equal_sample(df, "label", "id", 3).groupBy("label").count().collect()} == {"a": 3, "b": 3}
    with pytest.raises(ValueError, match="b"):
        mx.equal_sample(df, "label", "id", 4)
    d = spark.createDataFrame([(f"d{i % 20}", "x", i) for i in range(400)], "donor string, label string, id int")
    g = mx.grouped_caps(d, "donor", "label", "id", 30, most_train=50, most_test=7)
    n = {r.held_out: (r.n, r.donors) for r in g.groupBy("held_out").agg(F.count("*").alias("n"), F.collect_set("donor").alias("donors")).collect()}
    assert n[False][0] == 50 and n[True][0] == 7 and not set(n[False][1]) & set(n[True][1])
    c = spark.createDataFrame([(10, 5, 8.0), (9, 5, 9.0), (10, 4, 10.0), (10, 5, None), (10, 5, 11.0), (10, 5, 1e9)], "transcript_counts int, n_genes int, cell_area double")
    assert sorted(r.cell_area for r in qc.within_bounds(c).collect()) == [8.0, 11.0]


def test_second_counts_under_first_ids(spark, rows):
    x = spark.createDataFrame([("p1", "g", 2.0), ("p1", "h", 1.0), ("p9", "g", 5.0)], "cell_id string, gene string, cnt double")
    c = spark.createDataFrame([("p1", 11, 0.0, 1.0, 2.0, 3.0), ("p2", 12, 0.0, 1.0, 2.0, 3.0), ("p9", None, 0.0, 1.0, 2.0, 3.0)], "cell_id string, original_id int, x double, y double, area double, volume double")
    counts, cells = mx.renamed_counts(x, c)
    assert rows(counts) == [("11", "g", 2.0), ("11", "h", 1.0)] and {r.cell_id: r.transcript_counts for r in cells.collect()} == {"11": 3, "12": 0}


def test_tile_numbers_and_bands(spark):
    c = spark.createDataFrame([(i, "s", 0, i // 3) for i in range(8)], "id int, space string, tx int, ty int")
    assert [r.number for r in ts.tile_numbers(c, 3).orderBy("id").collect()] == [0] * 3 + [1] * 3 + [-1] * 2
    b = spark.createDataFrame([(0, "a", "b", 1.0), (1, "a", "b", 2.0), (2, "a", "b", 3.0)], "band int, a string, b string, ratio double")
    assert {r.wanted: r.ratio for r in st.at_distance(b, [0, 10, 20, 40], [1, 15, 99]).collect()} == {1.0: 1.0, 15.0: 1.0, 99.0: 3.0}
