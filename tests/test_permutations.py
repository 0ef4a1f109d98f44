"""The registered permutation tests against brute force with the reference's number of permutations."""

import random
from collections import Counter
from hashlib import md5
from statistics import fmean, pstdev

import pytest

from cellgrove.queries import statistics as sq
from cellgrove.queries.base import vector_edges

PERMS = 1000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    d = str(tmp_path_factory.mktemp("perms"))
    points = [(i, rng.randint(0, 7), [0.02 * (i % 7) + rng.random() / 200, 0.02 * (i // 7) + rng.random() / 200] + [rng.choice([-0.1, 0.2, 0.4]) for _ in range(62)]) for i in range(49)]
    spark.createDataFrame(points, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, points, [(e.src, e.dst) for e in vector_edges(spark, d).collect()]


def dealt(values, seed, perm):
    ids = sorted(values)
    return dict(zip(ids, (values[i] for i in sorted(ids, key=lambda i: (md5(f"{seed}|{perm}|{i}".encode()).hexdigest(), i)))))


def test_enrichment_draws_a_thousand(spark, folder):
    d, points, edges = folder
    lab = {i: f"l{t % 4}" for i, t, _ in points}
    null = [Counter((s[a], s[b]) for a, b in edges) for s in (dealt(lab, "nhood", p) for p in range(PERMS))]
    for r in sq.nhood_enrichment(spark, d).collect():
        n = [c[r.a, r.b] for c in null]
        assert r.expected == pytest.approx(fmean(n), abs=1e-5) and r.z == pytest.approx((r.n - fmean(n)) / pstdev(n), abs=1e-4)


def test_contacts_draw_a_thousand(spark, folder):
    d, points, edges = folder
    got = {r.pair: r for r in sq.contact_test(spark, d).collect()}
    for pair, ligand, receptor, send, receive in sq.PAIRS:
        mask = lambda gene, lin: {i: int(f"l{t % 4}" == lin and 20 * e[int(gene[1:])] >= 1) for i, t, e in points}
        kinds = {t: [i for i, u, _ in points if u == t] for _, t, _ in points}
        deal = lambda m, seed, p: {i: v for ids in kinds.values() for i, v in dealt({i: m[i] for i in ids}, seed, p).items()}
        left, right = mask(ligand, send), mask(receptor, receive)
        count = lambda a, b: sum(a[s] and b[t] for s, t in edges)
        seen, null = count(left, right), [count(deal(left, "cL", p), deal(right, "cR", p)) for p in range(PERMS)]
        assert got[pair].observed == seen and got[pair].expected == pytest.approx(fmean(null), abs=1e-5)
        assert got[pair].p == pytest.approx((1 + sum(n >= seen for n in null)) / (PERMS + 1), abs=1e-8)


def test_ligrec_draws_a_thousand(spark, folder):
    d, points, _ = folder
    cnt = lambda e, g: max(int(20 * e[int(g[1:])] // 1), 0)
    value = {i: e for i, _, e in points}

    def means(lab, gene):
        groups = {v: [cnt(value[i], gene) for i in lab if lab[i] == v] for v in set(lab.values())}
        return {v: fmean(c) for v, c in groups.items() if any(c)}

    lab = {i: f"l{t % 4}" for i, t, _ in points}
    null = [{g: means(s, g) for g in ("g2", "g3", "g5", "g8")} for s in (dealt(lab, "lr", p) for p in range(PERMS))]
    for r in sq.ligrec(spark, d).collect():
        draws = [(x[r.ligand].get(r.a), x[r.receptor].get(r.b)) for x in null]
        ge = sum(a is not None and b is not None and round((a + b) / 2, 9) >= round(r.score, 8) - 1e-7 for a, b in draws)
        assert r.p == pytest.approx((1 + ge) / (PERMS + 1), abs=1e-8)
