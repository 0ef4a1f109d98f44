import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellgrove.functions import fold, half_even, tile, uniform
from cellgrove.operators import matrix as mx
from cellgrove.operators import qc
from cellgrove.operators import stats as st
from cellgrove.operators import tissue as ts
from cellgrove.operators.components import min_label_components
from cellgrove.plans import ranked, running_total
from cellgrove.sources.tables import current, load_step


def test_columns(spark):
    df = spark.createDataFrame([("  A\t  b ", -0.5, 2.5)], "s string, x double, y double")
    r = df.select(fold("s").alias("s"), tile("x", 1).alias("t"), half_even("y").alias("h"), uniform("s").alias("u")).first()
    assert (r.s, r.t, r.h) == ("a b", -1, 2.0) and 0 < r.u < 1


def test_running_total_over_hot_and_null_keys(spark):
    rng = random.Random(0)
    data = [("hot" if i % 3 else None if i % 2 else f"k{i % 7}", i, rng.randint(0, 5) if i % 11 else None) for i in range(600)]
    got = running_total(spark.createDataFrame(data, "k string, o int, v int"), ["k"], ["o"], "v", parts=5).collect()
    total, want = Counter(), {}
    for k, o, v in data:
        total[k] += v or 0
        want[o] = total[k]
    assert {r.o: r.running for r in got} == want
    assert ranked(spark.createDataFrame([], "k string, o int"), ["k"], ["o"]).count() == 0
    no_key = ranked(spark.range(50), [], [F.col("id").desc()], parts=4)
    assert {r.id: r["rank"] for r in no_key.collect()} == {i: 50 - i for i in range(50)}


def test_current_rows(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 1, None), (None, 9, 9)], "k string, row int, t int")
    assert rows(current(df, "k", [F.col("t").desc_nulls_last(), F.col("row").desc()])) == [("a", 2, 5), ("b", 1, None)]


def test_catalogue(spark, tmp_path):
    with pytest.raises(KeyError):
        load_step(spark, str(tmp_path), "nothing")
    with pytest.raises(FileNotFoundError):
        load_step(spark, str(tmp_path), "cells")


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(f"r{rng.randint(0, 120):03d}", f"e{rng.randint(0, 150)}") for _ in range(200)] + [(f"c{i:02d}", f"l{j}") for i in range(40) for j in (i, i + 1)]
    links += links[:20] + [(None, "e1"), ("r001", None)]
    parent: dict = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for r, e in links:
        if r and e:
            parent[find("E" + e)] = find(r)
    groups: dict = {}
    for r in {r for r, e in links if r and e}:
        groups.setdefault(find(r), set()).add(r)
    want = {r: min(g) for g in groups.values() for r in g}
    got = {r.record: r.label for r in min_label_components(spark.createDataFrame(links, "record string, entity string")).collect()}
    assert got == want
    assert min_label_components(spark.createDataFrame([], "record string, entity string")).count() == 0


def test_mad_bounds_are_symmetric_on_the_log_scale(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(math.exp(rng.gauss(4, 0.3)),) for _ in range(4000)] + [(None,)], "x double")
    b = qc.mad_bounds(df, "x", 3.0).first()
    lo, hi = math.log1p(b.low), math.log1p(b.high)
    assert abs((hi + lo) / 2 - b.med) < 1e-9 and abs((hi - lo) - 6 * 0.3) < 0.15


def test_quality_rules(spark):
    data = [(i, 100, 20, 80.0 + i % 9, 0.01) for i in range(200)] + [(900, 3, 20, 84.0, None), (901, 100, 2, 84.0, 0.0), (902, 100, 20, 5000.0, 0.0), (903, 100, 20, 84.0, 0.4)]
    f = qc.qc_flags(spark.createDataFrame(data, "cell_id int, transcript_counts int, n_genes int, cell_area double, control_frac double"))
    t = {r.rule: r.flagged for r in qc.rule_table(f).collect()}
    assert (t["low_counts"], t["low_genes"], t["control"]) == (1, 1, 1) and t["large"] >= 1


def test_first_rectangle_wins(spark):
    p = spark.createDataFrame([(1, "s", 1.0, 1.0), (2, "s", 9.0, 1.0), (3, "s", 10.0, 1.0), (4, "s", 99.0, 1.0)], "id int, space string, x double, y double")
    r = spark.createDataFrame([("s", "A1", 1, 0.0, 0.0, 10.0, 10.0), ("s", "A2", 2, 8.0, 0.0, 10.0, 10.0)], "space string, region string, ord int, x double, y double, width double, height double")
    assert {x.id: x.region for x in qc.assign_rectangle(p, r).collect()} == {1: "A1", 2: "A1", 3: "A2", 4: None}


def test_metrics_of_cells_without_counts(spark):
    c = spark.createDataFrame([(1, 20, 100.0, None, 2.0), (2, 5, 0.0, 1.0, 0.0)], "cell_id int, transcript_counts int, cell_area double, nucleus_area double, control_counts double")
    g = spark.createDataFrame([(1, "a", 18.0), (1, "b", 2.0), (1, "c", 0.0)], "cell_id int, gene string, cnt double")
    r = {x.cell_id: x for x in qc.with_metrics(c, g, "control_counts").collect()}
    assert (r[1].n_genes, r[1].control_frac, r[1].density, r[1].nucleus_ratio) == (2, 0.1, 0.2, None)
    assert (r[2].n_genes, r[2].control_frac, r[2].density) == (0, None, None)


def test_false_discovery_rates(spark):
    p = [0.01, 0.04, 0.03, 0.04, None, 0.9]
    got = {r.i: r.q for r in st.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    known = sorted(x for x in p if x is not None)
    m = len(known)
    for i, x in enumerate(p):
        want = None if x is None else min(1, min(y * m / sum(z <= y for z in known) for y in known if y >= x))
        assert got[i] == (None if want is None else pytest.approx(want))


def test_shuffles_keep_groups(spark):
    df = spark.createDataFrame([(i, f"v{i}", "ab"[i % 2]) for i in range(20)], "id int, value string, g string")
    s = st.shuffled(df, 3, "x", ["g"]).collect()
    for perm in range(3):
        for g in "ab":
            assert sorted(r.value for r in s if r.perm == perm and r.g == g) == sorted(f"v{i}" for i in range(20) if "ab"[i % 2] == g)


def test_agreement_of_equal_and_constant_labels(spark):
    one = st.agreement_scores(spark.createDataFrame([(i % 3, -(i % 3)) for i in range(30)] + [(None, 1)], "a int, b int")).first()
    assert one.n == 30 and one.ari == pytest.approx(1) and one.nmi == pytest.approx(1) and one.fmi == pytest.approx(1)
    flat = st.agreement_scores(spark.createDataFrame([(i % 2, 0) for i in range(30)], "a int, b int")).first()
    assert flat.ari == pytest.approx(0) and flat.nmi == pytest.approx(0)


def test_phenotypes_and_names(spark):
    t = spark.createDataFrame([(10.0, 1.0, 1.0), (100.0, 60.0, 100.0), (100.0, 10.0, 100.0)], "total_density double, intra_density double, stroma_density double")
    assert [r[0] for r in t.select(ts.phenotype()).collect()] == ["desert", "inflamed", "excluded"]
    s = spark.createDataFrame([("n1", "Epithelial", 0.91), ("n1", "Myeloid", 0.09), ("n2", "T / NK", 0.46), ("n2", "B / plasma", 0.14), ("n2", "Mast", 0.1)], "g string, label string, share double")
    assert {r.g: r["name"] for r in ts.two_names(s, "g", 0.85).collect()} == {"n1": "Epithelial 91%", "n2": "T / NK 46% + B / plasma 14%"}


def test_lognorm_of_rows_and_empty_cells(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 0.0)], "cell_id int, gene string, cnt double")
    r = {(v.cell_id, v.gene): math.expm1(v.lognorm) for v in mx.log_normalised(x).collect()}
    assert r[1, "a"] + r[1, "b"] == pytest.approx(10_000) and r[2, "a"] == 0


def test_foreign_genes_and_calls(spark):
    x = spark.createDataFrame([(1, "EPCAM", 3.0), (2, "EPCAM", 3.0), (3, "CD68", 2.0), (4, "CD68", 2.0), *[(i, "ACTB", 1.0) for i in (1, 2, 3, 4)]], "cell_id int, gene string, lognorm double")
    g = spark.createDataFrame([(1, "Epithelial"), (2, "Epithelial"), (3, "Myeloid"), (4, "Myeloid")], "cell_id int, grp string")
    assert [(r.gene, r.foreign) for r in mx.foreign_genes(x, g, "Myeloid").collect()] == [("EPCAM", "Epithelial")]
    a = spark.createDataFrame([("n", 1.0, None), ("s", 1.0, 0.01), ("u", 1.0, 0.01), ("i", 1.0, 0.01)], "gene string, log2fc double, q double")
    b = spark.createDataFrame([("s", 1.0, 0.01), ("u", -1.0, 0.01), ("i", 2.0, 0.02)], "gene string, log2fc double, q double")
    f = spark.createDataFrame([("s",)], "gene string")
    assert {r.gene: r.call for r in mx.called_genes(a, b, f).collect()} == {"n": "n.s.", "s": "spillover", "u": "not confirmed", "i": "intrinsic"}


def test_pseudobulk_needs_blocks(spark):
    with pytest.raises(ValueError):
        mx.pseudobulk(spark.createDataFrame([(1, "g", 1.0)], "cell_id int, gene string, cnt double"), spark.createDataFrame([(1, "b", "x")], "cell_id int, block string, domain string"), ("x", "y"))


def test_sample_caps_and_repeats(spark):
    df = spark.createDataFrame([(i, "a" if i < 100 else "b" if i < 110 else "c") for i in range(113)], "id int, label string")
    s = [sorted(r.id for r in mx.balanced_sample(d, "label", "id", 20).collect()) for d in (df, df.repartition(7))]
    assert s[0] == s[1] and len(s[0]) == 33


def test_raster(spark):
    from cellgrove.operators import raster as ra

    m = [[2.0, 0.0, 1.0], [0.0, 3.0, -1.0], [0.0, 0.0, 1.0]]
    x, y = ra.affine(F.lit(5.0), F.lit(7.0), m)
    u, v = ra.affine(x, y, ra.inverse(m))
    r = spark.range(1).select(u.alias("u"), v.alias("v")).first()
    assert (r.u, r.v) == (pytest.approx(5), pytest.approx(7))
    px = spark.createDataFrame([("i", a, b, 255, 255, 255) for a in range(6) for b in range(6)], "img string, row int, col int, r int, g int, b int")
    pts = spark.createDataFrame([(1, "i", 0.0, 0.0), (2, "i", 3.0, 3.0)], "id int, img string, x double, y double")
    f = {q.id: q for q in ra.patch_features(pts, px, 1.0, 4).collect()}
    assert f[1].r_mean == 255 and f[2].hematoxylin_sd == pytest.approx(0)
    a = spark.createDataFrame([(i, j, float((i * 7 + j * 3) % 5), True) for i in range(8) for j in range(8)], "row int, col int, v double, mask boolean")
    b = a.select(((F.col("row") - 1) % 8).alias("row"), F.col("col"), "v").withColumn("row", F.pmod("row", F.lit(8)))
    best = ra.shift_correlation(a, b, 8, 8, 2).orderBy(F.col("r").desc()).first()
    assert (best.dr, best.dc) == (1, 0) and best.r == pytest.approx(1)


def test_stream_equals_batch(spark, tmp_path):
    from cellgrove.streaming import quality_stream

    src = spark.createDataFrame([("2024-01-01 00:10:00", "a", 25.0), ("2024-01-01 00:50:00", "a", 5.0), ("2024-01-01 01:10:00", "b", None)], "ts string, feature string, qv double").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    q = quality_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("quality").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.sql("select * from quality").collect())) == sorted(map(tuple, quality_stream(src).collect()))
    finally:
        q.stop()


def test_models(spark):
    from pyspark.ml.functions import array_to_vector

    from cellgrove.operators import models as md

    rng = random.Random(0)
    data = [(i, i % 3, i % 10, [rng.gauss(3 * (i % 3 == k), 0.6) for k in range(4)]) for i in range(240)]
    df = spark.createDataFrame(data, "id int, label int, block int, v array<double>").withColumn("features", array_to_vector("v")).withColumn("y", F.col("v")[0] + F.col("v")[1])
    p = md.cross_validated_labels(df, "label", "block", 3)
    s = st.overall_scores(p.select(F.col("label").alias("truth"), "pred")).first()
    assert s.balanced_accuracy > 0.9 and s.chance == pytest.approx(1 / 3) and p.count() == 240
    assert st.overall_scores(md.cross_validated_labels(df, "label", None, 2, components=2).select(F.col("label").alias("truth"), "pred")).first().balanced_accuracy > 0.9
    rest = df.withColumn("features", array_to_vector(F.slice("v", 2, 3)))  # the target is the first component, given by the others
    r = md.cross_validated_r(rest.withColumn("y", F.col("v")[1] - F.col("v")[2]), ["y"], "block", 2, (0.01, 100.0)).first()
    assert r.r > 0.9
    e = spark.createDataFrame([(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(g, g + 5) if a != b], "src int, dst int, w double")
    c = {x.id: x.community for x in md.communities(e, spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15)]], "id int")).collect()}
    assert len({c[i] for i in range(5)}) == 1 and len({c[i] for i in range(10, 15)}) == 1 and c[0] != c[10]


def test_quantiles_equal_linear_interpolation(spark):
    import numpy as np

    from cellgrove.plans import quantiles

    rng = random.Random(4)
    data = [("hot" if i % 3 else f"g{i % 4}", round(rng.gauss(0, 3), 1)) for i in range(300)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("none", None), ("hot", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.a, r.b) for r in quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9}).collect()}
    by = {}
    for g, v in data:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, v in by.items():
        assert got[g] == (pytest.approx(np.percentile(v, 50)), pytest.approx(np.percentile(v, 90)))
    assert quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median([v for x in by.values() for v in x]))
    assert quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0 and quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0
