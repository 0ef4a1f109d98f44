"""Permutation tests, agreement, ranks and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.functions import fold
from cellgrove.operators import stats as st
from cellgrove.operators.neighbours import radius_pairs
from cellgrove.plans import kept
from cellgrove.queries.base import EDGES, TISSUE, VECTORS, tissue, vector_edges, vector_genes, vectors
from cellgrove.queries.sql import ATLAS
from cellgrove.queries.sql import chi2_tail, fdr, normal_tail
from cellgrove.queries.sql import fold as sql_fold
from cellgrove.sources.tables import current_atlas

PERMS = 1000  # the reference's number


def nhood_enrichment(spark, d):
    """Edges between lineages against label permutations."""
    labels = vectors(spark, d).select("id", F.col("lineage").alias("value"))
    return st.enrichment(vector_edges(spark, d), kept(labels), PERMS, "nhood").select("a", "b", "n", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"))


def top_pairs(spark, d):
    """The three strongest pairs of different lineages."""
    return nhood_enrichment(spark, d).where("a < b").orderBy(F.col("z").desc(), "a", "b").limit(3).select("a", "b", "z")


PAIRS = [("g2-g3", "g2", "g3", "l0", "l1"), ("g5-g8", "g5", "g8", "l2", "l2"), ("g10-g40", "g10", "g40", "l1", "l3")]


def contact_test(spark, d):
    """Ligand-receptor contacts against shuffles within cell types."""
    pairs = spark.createDataFrame(PAIRS, "pair string, ligand string, receptor string, send string, receive string")
    positive = vector_genes(spark, d).select("id", "gene")
    out = st.contact_test(vector_edges(spark, d), kept(vectors(spark, d).select("id", "cell_type", "lineage")), kept(positive), pairs, PERMS, "c")
    return out.select("pair", F.col("senders").cast("bigint").alias("senders"), F.col("receivers").cast("bigint").alias("receivers"), "observed", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def interaction_matrix(spark, d):
    """Share of each lineage's edges that lead to each lineage."""
    labels = vectors(spark, d).select("id", F.col("lineage").alias("value"))
    return st.interaction_matrix(vector_edges(spark, d), labels).select("a", "b", "n", F.round("share", 9).alias("share"))


def moran_i(spark, d):
    """Moran's I of every gene on the neighbour graph."""
    v = vector_genes(spark, d).select("id", "gene", F.col("cnt").alias("value"))
    return st.morans_i(v, vector_edges(spark, d), vectors(spark, d).select("id")).select("gene", F.round("moran", 8).alias("moran"), F.round("z", 6).alias("z"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


BANDS = [5.0, 50.0, 100.0, 200.0, 300.0]


def _labelled_pairs(spark, d, radius):
    v = kept(vectors(spark, d))
    a, b = v.select(F.col("id").alias("src"), F.col("lineage").alias("a")), v.select(F.col("id").alias("dst"), F.col("lineage").alias("b"))
    return radius_pairs(v, v, radius).where("src <> dst").join(a, "src").join(b, "dst")


def co_occurrence(spark, d):
    """How much likelier a lineage is at a distance from another than at large."""
    return st.co_occurrence(_labelled_pairs(spark, d, BANDS[-1]), BANDS).select("band", "a", "b", "n", F.round("ratio", 8).alias("ratio"))


def ripley(spark, d):
    """Ripley's L of each lineage at four radii."""
    v = kept(vectors(spark, d))
    area = v.agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    sizes = v.groupBy(F.col("lineage").alias("label")).agg(F.count(F.lit(1)).alias("n")).join(area)  # one row
    p = _labelled_pairs(spark, d, 200.0).where("a = b").select(F.col("a").alias("label"), "dist")
    return st.ripley_l(p, sizes, [25, 50, 100, 200]).select("label", "radius", F.round("l", 6).alias("l"))


def spearman(spark, d):
    """Rank correlation of transcript counts and cell area per type."""
    return st.spearman(tissue(spark, d), "transcript_counts", "cell_area", ["cell_type"]).select("cell_type", "n", F.round("rho", 8).alias("rho"))


def wilcoxon_markers(spark, d):
    """Rank sums of every gene and lineage against the other cells, zeros included."""
    v = vector_genes(spark, d).select("id", "gene", F.log1p("cnt").alias("value"))
    g = vectors(spark, d).select("id", F.col("lineage").alias("grp"))
    return st.rank_sum_markers(v, kept(g)).select("gene", "grp", "n", F.round("u", 3).alias("u"), F.round("z", 7).alias("z"), F.round("log2fc", 7).alias("log2fc"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def top_markers(spark, d):
    """The five strongest marker genes of each cell type (any q, mean above the others'), in order."""
    v = vector_genes(spark, d).select("id", "gene", F.log1p("cnt").alias("value"))
    g = vectors(spark, d).select("id", F.col("cell_type").alias("grp"))
    return st.best_markers(st.rank_sum_markers(v, kept(g)).withColumn("z", F.round("z", 7)), 5, 1.01, 0.0)


def bh_fdr(spark, d):
    """False discovery rates of the sections' chi-square tests of lineage against niche."""
    return st.benjamini_hochberg(_chi(spark, d), "p").select("space", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def _chi(spark, d):
    c = tissue(spark, d).where("niche is not null").groupBy("space", F.col("lineage").alias("a"), F.col("niche").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    full = c.groupBy("space").agg(F.collect_set("a").alias("as"), F.collect_set("b").alias("bs")).select("space", F.explode("as").alias("a"), "bs").select("space", "a", F.explode("bs").alias("b"))
    c = full.join(c, ["space", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return st.chi_square(c, ["space"])


def chi_square(spark, d):
    """Chi-square test of lineage against niche per section."""
    return _chi(spark, d).select("space", F.round("chi2", 6).alias("chi2"), "dof", F.round("p", 9).alias("p"))


def co_occurrence_at(spark, d):
    """The co-occurrence ratio of the first lineage around each other one, in the bands nearest to three distances."""
    bands = st.co_occurrence(_labelled_pairs(spark, d, BANDS[-1]), BANDS).where("b = 'l0'")
    return st.at_distance(bands, BANDS, [20, 100, 300]).select("a", "wanted", "upto", F.round("ratio", 8).alias("ratio"))


def _two_labels(spark, d):
    a = current_atlas(spark, d, ["cell_type_major", "cell_type_tumor", "ann_coarse"])
    return kept(a.select(fold("cell_type_major").alias("major"), fold("cell_type_tumor").alias("tumor"), fold("ann_coarse").alias("coarse")))


def ari_nmi(spark, d):
    """Agreement of the coarse and the fine labels of the atlas."""
    return st.agreement_scores(_two_labels(spark, d).select(F.col("coarse").alias("a"), F.col("major").alias("b"))).select("n", *[F.round(c, 8).alias(c) for c in ("ari", "nmi", "fmi")])


def f1_scores(spark, d):
    """Recall, precision and F1 per label of one atlas labeling against the other."""
    p = _two_labels(spark, d).where("major is not null and tumor is not null").select(F.col("major").alias("truth"), F.col("tumor").alias("pred"))
    return st.class_scores(p).select("label", "support", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1")])


def balanced_accuracy(spark, d):
    """Balanced accuracy, macro F1 and chance."""
    p = _two_labels(spark, d).where("major is not null and tumor is not null").select(F.col("major").alias("truth"), F.col("tumor").alias("pred"))
    return st.overall_scores(p).select(*[F.round(c, 9).alias(c) for c in ("balanced_accuracy", "macro_f1", "chance")])


def ligrec(spark, d):
    """Mean of ligand and receptor per pair of lineages with a permutation p, over label shuffles."""
    g = kept(vector_genes(spark, d).where(F.col("gene").isin("g2", "g3", "g5", "g8")))
    labels = kept(vectors(spark, d).select("id", F.col("lineage").alias("value")))
    pairs = spark.createDataFrame([("g2", "g3"), ("g5", "g8")], "ligand string, receptor string")

    def means(lab, by):
        n = lab.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
        s = g.join(lab, "id").groupBy(*by, "value", "gene").agg(F.sum("cnt").alias("s"))
        m = kept(s.join(n, [*by, "value"]).select(*by, "value", "gene", (F.col("s") / F.col("n")).alias("m")))
        a = pairs.join(m.withColumnsRenamed({"gene": "ligand", "value": "a", "m": "ma"}), "ligand")
        return a.join(m.withColumnsRenamed({"gene": "receptor", "value": "b", "m": "mb"}), ["receptor", *by]).select(*by, "ligand", "receptor", "a", "b", ((F.col("ma") + F.col("mb")) / 2).alias("score"))

    seen = means(labels, [])
    null = means(st.shuffled(labels, PERMS, "lr"), ["perm"]).select("ligand", "receptor", "a", "b", F.col("score").alias("s0"))
    out = seen.join(null, ["ligand", "receptor", "a", "b"], "left").groupBy("ligand", "receptor", "a", "b", "score").agg(F.sum((F.round("s0", 9) >= F.round("score", 9)).cast("int")).alias("ge"))
    return out.select("ligand", "receptor", "a", "b", F.round("score", 8).alias("score"), F.round((1 + F.coalesce("ge", F.lit(0))) / (PERMS + 1), 9).alias("p"))


QUERIES = {f.__name__: f for f in (nhood_enrichment, top_pairs, contact_test, interaction_matrix, moran_i, co_occurrence, co_occurrence_at, ripley, spearman, wilcoxon_markers, top_markers, bh_fdr, chi_square, ari_nmi, f1_scores, balanced_accuracy, ligrec)}

_PERM = f"perm AS (SELECT range AS perm FROM range({PERMS}))"
_SHUF = lambda src, seed, within, name: f"""{name}_slot AS (SELECT id{''.join(', ' + w for w in within)}, row_number() OVER ({'PARTITION BY ' + ', '.join(within) if within else ''} ORDER BY id) AS k FROM {src}),
{name}_deal AS (SELECT perm{''.join(', ' + w for w in within)}, value, row_number() OVER (PARTITION BY perm{''.join(', ' + w for w in within)} ORDER BY md5('{seed}|' || perm || '|' || id), id) AS k FROM {src}, perm),
{name} AS (SELECT perm, s.id{''.join(', s.' + w for w in within)}, value FROM {name}_slot s JOIN {name}_deal e ON s.k = e.k{''.join(f' AND s.{w} = e.{w}' for w in within)})"""  # noqa: E731
_ENRICH = f"""{EDGES}, {_PERM}, lab AS (SELECT id, lineage AS value FROM vec), {_SHUF('lab', 'nhood', [], 'shuf')},
seen AS (SELECT a.value AS a, b.value AS b, count(*) AS n FROM edge JOIN lab a ON a.id = src JOIN lab b ON b.id = dst GROUP BY 1, 2),
nul AS (SELECT perm, a.value AS a, b.value AS b, count(*)::DOUBLE AS n FROM edge JOIN shuf a ON a.id = src JOIN shuf b USING (perm) WHERE b.id = dst GROUP BY 1, 2, 3),
kinds AS (SELECT x.value AS a, y.value AS b FROM (SELECT DISTINCT value FROM lab) x, (SELECT DISTINCT value FROM lab) y),
enr AS (SELECT k.a, k.b, coalesce(any_value(s.n), 0) AS n, coalesce(sum(nul.n), 0) / {PERMS} AS expected, sqrt(greatest(0, coalesce(sum(nul.n * nul.n), 0) / {PERMS} - (coalesce(sum(nul.n), 0) / {PERMS}) ** 2)) AS sd FROM kinds k LEFT JOIN seen s ON s.a = k.a AND s.b = k.b LEFT JOIN nul ON nul.a = k.a AND nul.b = k.b GROUP BY 1, 2),
enz AS (SELECT a, b, n, round(expected, 6) AS expected, round((n - expected) / nullif(sd, 0), 6) AS z FROM enr)"""
_VALUES = ", ".join(str(p) for p in PAIRS)
_RANK = f"""{VECTORS}, v AS (SELECT id, gene, ln(1 + cnt) AS value FROM vgene), every AS (SELECT x.id, x.lineage AS grp, g.gene, coalesce(v.value, 0) AS value FROM vec x CROSS JOIN (SELECT DISTINCT gene FROM v) g LEFT JOIN v ON v.id = x.id AND v.gene = g.gene),
rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE AS r FROM every),
ti AS (SELECT gene, sum(k ** 3 - k) AS tie, sum(k) AS t FROM (SELECT gene, value, count(*)::DOUBLE AS k FROM every GROUP BY 1, 2) GROUP BY 1),
al AS (SELECT gene, sum(exp(value) - 1) AS alls FROM every GROUP BY 1),
gg AS (SELECT gene, grp, count(*) AS n, sum(r) AS rs, sum(exp(value) - 1) AS e FROM rk GROUP BY 1, 2),
mk AS (SELECT gene, grp, n, rs - n * (n + 1) / 2.0::DOUBLE AS u, n * (t - n) / 12.0::DOUBLE * (t + 1 - tie / (t * (t - 1))) AS var, n * (t - n) / 2.0::DOUBLE AS mu, e / n AS mi, (alls - e) / (t - n) AS mo FROM gg JOIN ti USING (gene) JOIN al USING (gene)),
mz AS (SELECT *, (u - mu) / sqrt(var) AS zz FROM mk), mp AS (SELECT *, 2 * ({normal_tail('abs(zz)')}) AS p FROM mz), mq AS ({fdr('mp', by='grp')}),
mark AS (SELECT gene, grp, n, round(u, 3) AS u, round(zz, 7) AS z, round(log2((mi + 1e-9) / (mo + 1e-9)), 7) AS log2fc, round(p, 9) AS p, round(q, 9) AS q FROM mq)"""
_LABELS = f"{ATLAS}, two AS (SELECT {sql_fold('cell_type_major')} AS major, {sql_fold('cell_type_tumor')} AS tumor, {sql_fold('ann_coarse')} AS coarse FROM atlas)"
_SCORES = f"{_LABELS}, p AS (SELECT major AS truth, tumor AS pred FROM two WHERE major IS NOT NULL AND tumor IS NOT NULL), sc AS (SELECT t.label, support, hit / support AS recall, coalesce(hit / called, 0) AS precision, 2.0::DOUBLE * hit / (support + coalesce(called, 0)) AS f1 FROM (SELECT truth AS label, count(*) AS support, sum((truth = pred)::INT) AS hit FROM p GROUP BY 1) t LEFT JOIN (SELECT pred AS label, count(*) AS called FROM p GROUP BY 1) c ON c.label = t.label)"

_BANDED_PAIRS = f"{VECTORS}, p AS (SELECT a.lineage AS a, b.lineage AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM vec a JOIN vec b ON a.id <> b.id), q AS (SELECT a, b, CASE WHEN dist > 5 AND dist <= 50 THEN 0 WHEN dist > 50 AND dist <= 100 THEN 1 WHEN dist > 100 AND dist <= 200 THEN 2 WHEN dist > 200 AND dist <= 300 THEN 3 END AS band FROM p), n AS (SELECT band, a, b, count(*) AS n FROM q WHERE band IS NOT NULL GROUP BY 1, 2, 3)"
_CHI = f"{TISSUE}, c AS (SELECT space, lineage AS a, niche AS b, count(*) AS n FROM tissue WHERE niche IS NOT NULL GROUP BY 1, 2, 3), f0 AS (SELECT x.space, a, b FROM (SELECT DISTINCT space, a FROM c) x JOIN (SELECT DISTINCT space, b FROM c) y ON x.space = y.space), g AS (SELECT f0.*, coalesce(n, 0) AS n FROM f0 LEFT JOIN c ON c.space = f0.space AND c.a = f0.a AND c.b = f0.b), h AS (SELECT *, (sum(n) OVER (PARTITION BY space, a))::DOUBLE * sum(n) OVER (PARTITION BY space, b) / sum(n) OVER (PARTITION BY space) AS e FROM g), ch AS (SELECT space, sum((n - e) * (n - e) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM h GROUP BY 1)"

SQL = {
    "nhood_enrichment": f"WITH {_ENRICH} SELECT * FROM enz",
    "top_pairs": f"WITH {_ENRICH} SELECT a, b, z FROM enz WHERE a < b ORDER BY z DESC, a, b LIMIT 3",
    "contact_test": f"""WITH {EDGES}, {_PERM}, pr(pair, ligand, receptor, send, receive) AS (VALUES {_VALUES}),
ml AS (SELECT pair, v.id, cell_type, (lineage = send AND g.id IS NOT NULL)::INT AS value FROM pr, vec v LEFT JOIN vgene g ON g.id = v.id AND g.gene = ligand),
mr AS (SELECT pair, v.id, cell_type, (lineage = receive AND g.id IS NOT NULL)::INT AS value FROM pr, vec v LEFT JOIN vgene g ON g.id = v.id AND g.gene = receptor),
{_SHUF('ml', 'cL', ['pair', 'cell_type'], 'sl')}, {_SHUF('mr', 'cR', ['pair', 'cell_type'], 'sr')},
obs AS (SELECT pr.pair, count(e.src) AS observed FROM pr LEFT JOIN (SELECT a.pair, src FROM edge JOIN ml a ON a.id = src AND a.value = 1 JOIN mr b ON b.id = dst AND b.value = 1 AND b.pair = a.pair) e ON e.pair = pr.pair GROUP BY 1),
nu AS (SELECT a.pair, a.perm, count(*)::DOUBLE AS n FROM edge JOIN sl a ON a.id = src AND a.value = 1 JOIN sr b ON b.id = dst AND b.value = 1 AND b.pair = a.pair AND b.perm = a.perm GROUP BY 1, 2),
stt AS (SELECT o.pair, observed, avg(coalesce(n, 0)) AS expected, sqrt(greatest(0, avg(coalesce(n, 0) * coalesce(n, 0)) - avg(coalesce(n, 0)) ** 2)) AS sd, sum((coalesce(n, 0) >= observed)::INT) AS ge FROM obs o CROSS JOIN perm LEFT JOIN nu ON nu.pair = o.pair AND nu.perm = perm.perm GROUP BY 1, 2),
fin AS (SELECT s.pair, (SELECT sum(value) FROM ml WHERE ml.pair = s.pair)::BIGINT AS senders, (SELECT sum(value) FROM mr WHERE mr.pair = s.pair)::BIGINT AS receivers, observed, expected, (observed - expected) / greatest(sd, 1e-9) AS z, (1 + ge) / {PERMS + 1}::DOUBLE AS p FROM stt s),
bh AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM fin)
SELECT pair, senders, receivers, observed, round(expected, 6) AS expected, round(z, 6) AS z, round(p, 9) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS q FROM bh""",
    "interaction_matrix": f"WITH {EDGES} SELECT a.lineage AS a, b.lineage AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a.lineage), 9) AS share FROM edge JOIN vec a ON a.id = src JOIN vec b ON b.id = dst GROUP BY 1, 2",
    "moran_i": f"WITH {EDGES}, w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM edge), every AS (SELECT x.id, g.gene, coalesce(v.cnt, 0) AS value FROM vec x CROSS JOIN (SELECT DISTINCT gene FROM vgene) g LEFT JOIN vgene v ON v.id = x.id AND v.gene = g.gene), z AS (SELECT id, gene, value - avg(value) OVER (PARTITION BY gene) AS z FROM every), top AS (SELECT a.gene, sum(w * a.z * b.z) AS t FROM w JOIN z a ON a.id = src JOIN z b ON b.id = dst AND b.gene = a.gene GROUP BY 1), zz AS (SELECT gene, sum(z * z) AS zz, count(*)::DOUBLE AS n FROM z GROUP BY 1), s0 AS (SELECT sum(w) AS s0 FROM w), s1 AS (SELECT sum((a.w + b.w) ** 2) / 2 AS s1 FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src), s2 AS (SELECT sum(s * s) AS s2 FROM (SELECT i, sum(w) AS s FROM (SELECT src AS i, w FROM w UNION ALL SELECT dst, w FROM w) GROUP BY 1)), mo AS (SELECT gene, n / s0 * t / nullif(zz, 0) AS moran, -1 / (n - 1) AS ex, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) AS v FROM top JOIN zz USING (gene), s0, s1, s2), mz AS (SELECT gene, moran, (moran - ex) / sqrt(v - ex * ex) AS z FROM mo), mp AS (SELECT *, {normal_tail('abs(z)')} AS p FROM mz), mq AS ({fdr('mp')}) SELECT gene, round(moran, 8) AS moran, round(z, 6) AS z, round(p, 9) AS p, round(q, 9) AS q FROM mq",
    "co_occurrence": f"WITH {_BANDED_PAIRS} SELECT band, a, b, n, round((n / sum(n) OVER (PARTITION BY band, a)) / (sum(n) OVER (PARTITION BY band, b) / sum(n) OVER (PARTITION BY band)), 8) AS ratio FROM n",
    "ripley": f"WITH {VECTORS}, ar AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS area FROM vec), s AS (SELECT lineage AS label, count(*) AS n FROM vec GROUP BY 1), r AS (SELECT unnest([25.0, 50.0, 100.0, 200.0])::DOUBLE AS radius), k AS (SELECT a.lineage AS label, radius, count(*) AS k FROM r, vec a JOIN vec b ON a.id <> b.id AND a.lineage = b.lineage WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= radius GROUP BY 1, 2) SELECT s.label, r.radius, round(sqrt(area * coalesce(k, 0) / (3.141592653589793 * n * (n - 1))), 6) AS l FROM s CROSS JOIN r CROSS JOIN ar LEFT JOIN k ON k.label = s.label AND k.radius = r.radius",
    "spearman": f"WITH {TISSUE}, t AS (SELECT * FROM tissue WHERE transcript_counts IS NOT NULL AND cell_area IS NOT NULL), r AS (SELECT cell_type, rank() OVER (PARTITION BY cell_type ORDER BY transcript_counts) + (count(*) OVER (PARTITION BY cell_type, transcript_counts) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY cell_type ORDER BY cell_area) + (count(*) OVER (PARTITION BY cell_type, cell_area) - 1) / 2.0::DOUBLE AS b FROM t) SELECT cell_type, count(*) AS n, round(corr(a, b), 8) AS rho FROM r GROUP BY 1",
    "wilcoxon_markers": f"WITH {_RANK} SELECT * FROM mark",
    "top_markers": f"WITH {_RANK.replace('x.lineage AS grp', 'x.cell_type AS grp')}, t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, gene) AS rn FROM mark WHERE q < 1.01 AND log2fc > 0) SELECT grp, string_agg(gene, ', ' ORDER BY rn) AS markers FROM t WHERE rn <= 5 GROUP BY 1",
    "bh_fdr": f"WITH {_CHI}, t AS (SELECT space, coalesce({chi2_tail('chi2', 'dof')}, 1) AS p FROM ch), f AS ({fdr('t')}) SELECT space, round(p, 9) AS p, round(q, 9) AS q FROM f",
    "chi_square": f"WITH {_CHI} SELECT space, round(chi2, 6) AS chi2, dof, round(coalesce({chi2_tail('chi2', 'dof')}, 1), 9) AS p FROM ch",
    "co_occurrence_at": f"WITH {_BANDED_PAIRS}, r AS (SELECT band, a, (n / sum(n) OVER (PARTITION BY band, a)) / (sum(n) OVER (PARTITION BY band, b) / sum(n) OVER (PARTITION BY band)) AS ratio, b, [50.0, 100.0, 200.0, 300.0][band + 1]::DOUBLE AS upto FROM n), w AS (SELECT unnest([20.0, 100.0, 300.0])::DOUBLE AS wanted) SELECT a, wanted, upto, round(ratio, 8) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY a, wanted ORDER BY abs(upto - wanted), upto) AS rn FROM r, w WHERE b = 'l0') WHERE rn = 1",
    "ari_nmi": f"WITH {_LABELS}, c AS (SELECT coarse AS a, major AS b, count(*)::DOUBLE AS n FROM two WHERE coarse IS NOT NULL AND major IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS pj FROM c), ma AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), mb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), h AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ma) AS pa, (SELECT sum(n * (n - 1) / 2) FROM mb) AS pb, (SELECT sum(-n / t * ln(n / t)) FROM ma, t) AS ha, (SELECT sum(-n / t * ln(n / t)) FROM mb, t) AS hb, (SELECT sum(c.n / t * ln(c.n * t / (ma.n * mb.n))) FROM c JOIN ma ON ma.a = c.a JOIN mb ON mb.b = c.b, t) AS mi) SELECT t::BIGINT AS n, round((pj - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 8) AS ari, round(mi / ((ha + hb) / 2), 8) AS nmi, round(pj / sqrt(pa * pb), 8) AS fmi FROM h, t",
    "f1_scores": f"WITH {_SCORES} SELECT label, support, round(recall, 9) AS recall, round(precision, 9) AS precision, round(f1, 9) AS f1 FROM sc",
    "balanced_accuracy": f"WITH {_SCORES} SELECT round(avg(recall), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, round(1.0::DOUBLE / count(*), 9) AS chance FROM sc",
    "ligrec": f"""WITH {VECTORS}, {_PERM}, lab AS (SELECT id, lineage AS value FROM vec), {_SHUF('lab', 'lr', [], 'shuf')}, pr(ligand, receptor) AS (VALUES ('g2', 'g3'), ('g5', 'g8')), lb AS (SELECT -1 AS perm, id, value FROM lab UNION ALL SELECT perm, id, value FROM shuf),
m AS (SELECT s.perm, s.value, gene, s / n AS m FROM (SELECT perm, value, gene, sum(cnt) AS s FROM lb JOIN vgene USING (id) GROUP BY 1, 2, 3) s JOIN (SELECT perm, value, count(*) AS n FROM lb GROUP BY 1, 2) n ON n.perm = s.perm AND n.value = s.value),
sc AS (SELECT x.perm, ligand, receptor, x.value AS a, y.value AS b, (x.m + y.m) / 2 AS score FROM pr JOIN m x ON x.gene = ligand JOIN m y ON y.gene = receptor AND y.perm = x.perm)
SELECT o.ligand, o.receptor, o.a, o.b, round(o.score, 8) AS score, round((1 + coalesce(sum((round(n.score, 9) >= round(o.score, 9))::INT), 0)) / {PERMS + 1}::DOUBLE, 9) AS p FROM sc o LEFT JOIN sc n ON n.perm >= 0 AND n.ligand = o.ligand AND n.receptor = o.receptor AND n.a = o.a AND n.b = o.b WHERE o.perm = -1 GROUP BY 1, 2, 3, 4, o.score""",
}
