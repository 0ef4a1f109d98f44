"""Domain features over all genes against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import models as md
from cellgrove.queries import learned


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    d = str(tmp_path_factory.mktemp("domains"))
    points = [(i, i % 8, [0.02 * (i % 6) + rng.random() / 200, 0.02 * (i // 6) + rng.random() / 200] + [rng.uniform(-0.2, 0.5) for _ in range(62)]) for i in range(42)]
    spark.createDataFrame(points, "vec_id bigint, label int, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    return d, points


def banksy_by_hand(points):
    x = np.array([[math.log1p(max(math.floor(20 * v), 0)) for v in e] for _, _, e in points])
    xy = 1000 * np.array([e[:2] for _, _, e in points])
    around = np.zeros_like(x)
    for i in range(len(x)):
        dist = np.hypot(*(xy - xy[i]).T)
        near = sorted((j for j in range(len(x)) if j != i), key=lambda j: (dist[j], j))[:15]
        w = np.exp(-(dist[near] ** 2) / 1800)
        around[i] = w @ x[near] / w.sum()
    return x, around


def test_banksy_takes_all_genes(spark, folder, monkeypatch):
    d, points = folder
    own, around = banksy_by_hand(points)
    seen = {}
    inner = md.principal_components

    def spy(df, k, *rest):
        out = inner(df, k, *rest)
        seen.update(k=k, share=out[1], width=len(df.first().features))
        return out

    monkeypatch.setattr(md, "principal_components", spy)
    assert learned.banksy(spark, d).agg(F.sum("n")).first()[0] == len(points)
    both = np.hstack([around, own])
    sd = both.std(0, ddof=1)
    z = np.where(sd > 0, (both - both.mean(0)) / np.where(sd > 0, sd, 1), 0)
    z *= np.sqrt([0.8] * 64 + [0.2] * 64)
    var = np.linalg.svd(z - z.mean(0), compute_uv=False) ** 2
    assert seen["k"] == 20 and seen["width"] >= 120 and seen["share"] == pytest.approx(list(var[:20] / var.sum()), abs=1e-5)


def test_banksy_matrix_equals_brute_force(spark, folder):
    d, points = folder
    own, around = banksy_by_hand(points)
    got = {(r.id, int(r.gene[1:])): r for r in learned.banksy_matrix(spark, d).collect()}
    for i in range(len(points)):
        for g in range(64):
            r = got.get((i, g))
            assert (r.own if r else 0) == pytest.approx(math.sqrt(0.2) * own[i, g], abs=1e-6)
            assert (r.around if r else 0) == pytest.approx(math.sqrt(0.8) * around[i, g], abs=1e-6)


def test_cellcharter_embedding_and_mixtures(spark, folder, monkeypatch):
    from cellgrove.queries.base import vector_edges

    d, points = folder
    asked = {}

    def fits(df, key, ks, runs):
        asked.update(rows={r.id: r.features.toArray() for r in df.collect()}, ks=ks, runs=runs)
        return spark.createDataFrame([(k, 1.0 if k in (7, 9) else 0.5) for k in ks], "k int, stability double")

    monkeypatch.setattr(md, "stable_mixtures", fits)
    assert [r.k for r in learned.gmm_autok(spark, d).where("chosen").collect()] == [7]
    e = asked["rows"]
    assert asked["ks"] == list(range(4, 13)) and asked["runs"] == 3 and {len(v) for v in e.values()} == {120} and len(e) == len(points)
    near = {i: set() for i in e}
    for r in vector_edges(spark, d).collect():
        near[r.src].add(r.dst)
    for i in e:
        seen, front = {i}, {i}
        for layer in (1, 2, 3):
            front = {j for k in front for j in near[k]} - seen
            seen |= front
            want = np.mean([e[j][:30] for j in front], axis=0) if front else np.zeros(30)
            assert e[i][30 * layer : 30 * layer + 30] == pytest.approx(want, abs=1e-6)
    own = np.array([e[i][:30] for i in sorted(e)])
    counts = np.array([[max(math.floor(20 * v), 0) for v in p] for _, _, p in points], dtype=float)
    x = np.log1p(counts / counts.sum(1, keepdims=True) * np.median(counts.sum(1)))
    sd = x.std(0, ddof=1)
    z = np.clip(np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0), -10, 10)
    assert own.var(0, ddof=1) == pytest.approx(np.linalg.svd(z - z.mean(0), compute_uv=False)[:30] ** 2 / (len(x) - 1), rel=1e-3)
