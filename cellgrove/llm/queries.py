"""The queries of this subpackage and their SQL, where SQL can say it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.functions import finite, fold, tile
from cellgrove.llm.clusters import alike_groups, similarity_clusters, typical_members
from cellgrove.llm.cooccurrence import item_pairs
from cellgrove.llm.language import fit, label_cases, mail_languages, mail_stretches
from cellgrove.llm.leaks import leak_report, leaked_items
from cellgrove.llm.mixing import mix_sources, with_tokens
from cellgrove.llm.percentiles import percentiles, value_counts
from cellgrove.llm.sampling import sample_to_targets
from cellgrove.llm.splits import donor_entities, donors, grouped_split, key_of, same_person_pairs
from cellgrove.operators.components import min_label_components
from cellgrove.plans import cut, kept
from cellgrove.queries.sql import ATLAS, CELL
from cellgrove.queries.sql import fold as sql_fold
from cellgrove.sources.tables import current_atlas, read, typed_cells

TILE_UM = 50.0


def _tiles(spark: SparkSession, folder: str) -> DataFrame:
    cells = typed_cells(spark, folder, [], position=True, kinds=("type", "in_time_types")).where("in_time_types and x_um is not null")
    return cells.select(F.col("section_id").alias("grp"), tile("x_um", TILE_UM).alias("tx"), tile("y_um", TILE_UM).alias("ty"), F.col("type").alias("item"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of types that share at least 8 tiles of a section and at least twice as many as chance would give."""
    pairs = item_pairs(_tiles(spark, folder), ["tx", "ty"], min_count=8, min_lift=2.0)
    return pairs.select(F.col("grp").alias("section_id"), F.col("item_a").alias("type_a"), F.col("item_b").alias("type_b"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of types in common tiles, with counts and lift."""
    pairs = item_pairs(_tiles(spark, folder), ["tx", "ty"])
    return pairs.select(F.col("grp").alias("section_id"), F.col("item_a").alias("type_a"), F.col("item_b").alias("type_b"), "n_ab", "n_a", "n_b", F.col("n_baskets").alias("n_tiles"), F.round("lift", 6).alias("lift"))


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    cells = typed_cells(spark, folder, ["dist_to_tumour_um"], kinds=("type", "is_tumour"))
    d = finite("dist_to_tumour_um")
    return cells.where(~F.col("is_tumour") & (d >= 0) & (d < 90_000)).select("section_id", F.col("type").alias("cell_type"), F.to_date("loaded_at").alias("day"), d.alias("d"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of at least 50 valid distances whose 95th percentile is at least 6 times the median."""
    groups = ["section_id", "cell_type"]
    found = percentiles(value_counts(_distances(spark, folder), groups, "d"), groups, {"p50": 0.5, "p95": 0.95})
    return found.where("n_values >= 50 and p95 >= 6 * p50").select(*groups)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and upper percentiles of each group, from summaries of the loading days added up."""
    groups = ["section_id", "cell_type"]
    days = value_counts(_distances(spark, folder), [*groups, "day"], "d")
    whole = days.groupBy(*groups, "value").agg(F.sum("n").alias("n"))
    return percentiles(whole, groups, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p2_days(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles off by at most 1 %, from summaries of each loading day on a geometric grid, which add up."""
    groups = ["section_id", "cell_type"]
    days = value_counts(_distances(spark, folder), [*groups, "day"], "d", relative=0.01)
    whole = percentiles(days.groupBy(*groups, "value").agg(F.sum("n").alias("n")), groups, {"p50": 0.5, "p95": 0.95})
    return whole.select(*groups, "n_values", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of donor ids with rows that are one person."""
    return same_person_pairs(current_atlas(spark, folder, ["donor_id", "specimen_id"]), read(spark, folder, "donor_links"))


SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    atlas = current_atlas(spark, folder, ["donor_id", "specimen_id", "cell_type_major"])
    kinds = cut(atlas.select("donor_id", "specimen_id", fold("cell_type_major").alias("kind")))
    people = min_label_components(donor_entities(donors(kinds), read(spark, folder, "donor_links")))
    rows = kinds.select(key_of(F.col("donor_id")).alias("record"), "kind").where("record is not null")
    rows = kept(rows.join(people, "record", "left").withColumn("unit", F.coalesce("label", "record")))
    return rows, *grouped_split(rows, "unit", "kind", SPLITS)


def p3_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split of each donor id with rows: 80 % train, 10 % validation, 10 % test, a person's ids together."""
    rows, placed, _ = _split(spark, folder)
    ids = rows.select("record", "unit").distinct()
    return ids.join(placed, "unit").select(F.col("record").alias("donor_id"), F.col("unit").alias("person"), "split")


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each cell type's rows that each split reached, beside its target."""
    return _split(spark, folder)[2].select(F.col("stratum").alias("cell_type_major"), "split", "n_rows", "share", "target_share")


FIELDS = ["cell_type_major", "tissue", "platform"]


def _sampled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return sample_to_targets(current_atlas(spark, folder, FIELDS), read(spark, folder, "sample_targets"), FIELDS, "obs_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the targets that their samples could not meet."""
    return _sampled(spark, folder)[1].where("deficit > 0").select("target_id", "line_no")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows asked for, there and drawn, for every line."""
    return _sampled(spark, folder)[1].select("target_id", "line_no", "ask", "n_available", "n_drawn")


def p6_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn rows of every line."""
    return _sampled(spark, folder)[0]


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = with_tokens(read(spark, folder, "documents").select("doc_id", "source", "text"))
    # the share of natural language: such text has about four characters a token, encoded attachments not even two
    quality = F.length("text") / F.greatest("n_tokens", F.lit(1))
    docs = cut(docs.select("doc_id", "source", "n_tokens", quality.alias("quality")))
    return mix_sources(docs, read(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of which a mix drew every document as often as allowed and still has less than it needs."""
    return _mixed(spark, folder)[1].where("capped").select("mix_id", "source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source was to give and gave to each mix."""
    return _mixed(spark, folder)[1]


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn mails of every mix and how often each is taken."""
    return _mixed(spark, folder)[0]


def p8_mix_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """The same draw with sizes in fours of characters and equal quality, which SQL can follow."""
    docs = read(spark, folder, "documents").select("doc_id", "source", F.ceil(F.length("text") / 4).alias("n_tokens"), F.lit(1.0).alias("quality"))
    return mix_sources(cut(docs), read(spark, folder, "mix_targets"))[0]


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "sub_profiles")
    names = F.transform("markers", lambda m: F.upper(F.regexp_replace(m, r"(?U)^\s+|\s+$", "")))
    lead = fold(F.regexp_extract(F.regexp_replace("niche", r"(?iU)^\s*N\d+\s*:", ""), r"(?U)^(.*?)\d+(?:\.\d+)?\s*%", 1))
    return p.select(F.col("profile_id").alias("id"), F.when(lead != "", lead).alias("part"), F.filter(names, lambda m: m.isNotNull() & (m != "")).alias("features"), "section_id", "sub")


LEAST_MARKERS = 7


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles that share at least 7 marker names and the leading lineage, each with the first of its group."""
    rows = cut(_profiles(spark, folder))
    groups = alike_groups(rows, similarity_clusters(rows, LEAST_MARKERS), LEAST_MARKERS)
    return groups.select(F.col("id").alias("profile_id"), F.col("first").alias("cluster_first"))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical profiles of each cluster of at least two."""
    rows = cut(_profiles(spark, folder))
    return typical_members(cut(similarity_clusters(rows, LEAST_MARKERS))).where("size > 1").select("size", "members")


def p4_broad(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical profiles of 64 broader clusters, into which Lloyd's steps gather the groups."""
    rows = cut(_profiles(spark, folder))
    return typical_members(cut(similarity_clusters(rows, LEAST_MARKERS, k=64))).select("cluster", "size", "members")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(read(spark, folder, "documents"), read(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Mails with at least 12 consecutive words of an item, unchanged."""
    return _leaks(spark, folder).where("edits = 0").select("doc_id", "item_id")


def p7_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Mails with a passage of at least 12 words of an item in which one character was changed, and none unchanged."""
    return _leaks(spark, folder).where("edits > 0")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """In how many mails each item leaked."""
    return leak_report(p7_found(spark, folder), read(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the mails that are in several, or whose label does not name theirs."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return label_cases(docs, cut(mail_languages(docs)))


def p9_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of every mail with its language and confidence."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    return mail_stretches(docs, fit(docs))


QUERIES = {f.__name__: f for f in (p4_found, p4_clusters, p4_broad, p7_found, p7_edited, p7_items, p9_found, p9_stretches, p1_found, p1_pairs, p2_found, p2_percentiles, p2_days, p3_found, p3_split, p3_shares, p6_found, p6_report, p6_sample, p8_found, p8_shares, p8_mix, p8_mix_by_length)}

_PAIRS = f"""WITH {CELL}, inc AS (SELECT DISTINCT section_id, floor(xu / 50) AS tx, floor(yu / 50) AS ty, typ FROM cell WHERE tt AND xu IS NOT NULL AND section_id IS NOT NULL),
total AS (SELECT section_id, count(*) AS n_tiles FROM (SELECT DISTINCT section_id, tx, ty FROM inc) GROUP BY 1),
single AS (SELECT section_id, typ, count(*) AS n FROM inc GROUP BY 1, 2),
pair AS (SELECT a.section_id, a.typ AS type_a, b.typ AS type_b, count(*) AS n_ab FROM inc a JOIN inc b ON a.section_id = b.section_id AND a.tx = b.tx AND a.ty = b.ty AND a.typ < b.typ GROUP BY 1, 2, 3),
counted AS (SELECT p.section_id, type_a, type_b, n_ab, a.n AS n_a, b.n AS n_b, n_tiles FROM pair p JOIN total t ON t.section_id = p.section_id JOIN single a ON a.section_id = p.section_id AND a.typ = type_a JOIN single b ON b.section_id = p.section_id AND b.typ = type_b)"""
_DIST = f"WITH {CELL}, dist AS (SELECT section_id, typ AS cell_type, dist_to_tumour_um AS d, cume_dist() OVER (PARTITION BY section_id, typ ORDER BY dist_to_tumour_um) AS q, count(*) OVER (PARTITION BY section_id, typ) AS n FROM cell WHERE NOT tum AND dist_to_tumour_um >= 0 AND dist_to_tumour_um < 90000 AND NOT isnan(dist_to_tumour_um))"
_ASK = f"""WITH {ATLAS}, line AS (SELECT target_id, line_no, {sql_fold('cell_type_major')} AS f1, {sql_fold('tissue')} AS f2, {sql_fold('platform')} AS f3, greatest(round(share * draw_rows), min_rows)::BIGINT AS ask FROM sample_targets),
got AS (SELECT target_id, line_no, ask, count(DISTINCT obs_id) AS n FROM line LEFT JOIN atlas ON (f1 IS NULL OR f1 = {sql_fold('cell_type_major')}) AND (f2 IS NULL OR f2 = {sql_fold('tissue')}) AND (f3 IS NULL OR f3 = {sql_fold('platform')}) GROUP BY 1, 2, 3)"""
_ID = lambda c: f"upper(trim(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')))"

_PROFILE = f"""WITH prof AS (SELECT profile_id, {sql_fold("regexp_extract(regexp_replace(niche, '^\\s*[Nn]\\d+\\s*:', ''), '^(.*?)\\d+(?:\\.\\d+)?\\s*%', 1)")} AS lead, unnest(markers) AS m FROM sub_profiles),
mark AS (SELECT DISTINCT profile_id, lead, upper(trim(m)) AS m FROM prof WHERE lead <> ''),
link AS (SELECT a.profile_id AS p, b.profile_id AS q FROM mark a JOIN mark b ON a.m = b.m AND a.lead = b.lead WHERE a.m <> '' GROUP BY 1, 2 HAVING count(*) >= 7)"""

_UNIT = lambda *c: f"((('0x' || substr(md5(concat_ws('|', {', '.join(c)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
_GRID = "exp(round(ln(dist_to_tumour_um) / ln(1 + 0.02::DOUBLE)) * ln(1 + 0.02::DOUBLE))"
_GDIST = _DIST.replace("dist_to_tumour_um AS d,", f"CASE WHEN dist_to_tumour_um <= 1e-12 THEN 0 ELSE {_GRID} END AS d,").replace("ORDER BY dist_to_tumour_um", f"ORDER BY CASE WHEN dist_to_tumour_um <= 1e-12 THEN 0 ELSE {_GRID} END")

SQL = {
    "p2_days": f"{_GDIST} SELECT section_id, cell_type, max(n) AS n_values, round(min(d) FILTER (WHERE q >= 0.5), 6) AS p50, round(min(d) FILTER (WHERE q >= 0.95), 6) AS p95 FROM dist GROUP BY 1, 2",
    "p6_sample": f"""{_ASK}, pair AS (SELECT target_id, line_no, ask, obs_id, {_UNIT('obs_id')} AS u, {_UNIT('target_id', 'line_no')} AS s FROM line JOIN atlas ON (f1 IS NULL OR f1 = {sql_fold('cell_type_major')}) AND (f2 IS NULL OR f2 = {sql_fold('tissue')}) AND (f3 IS NULL OR f3 = {sql_fold('platform')})),
placed AS (SELECT *, row_number() OVER (PARTITION BY target_id, line_no ORDER BY u - s + CASE WHEN u < s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, obs_id) AS k FROM pair)
SELECT target_id, line_no, obs_id FROM placed WHERE k <= ask""",
    "p8_mix_by_length": f"""WITH doc AS (SELECT doc_id, {sql_fold('source')} AS source, coalesce(ceil(length(text) / 4), 0)::BIGINT AS n FROM documents WHERE source IS NOT NULL),
sup AS (SELECT source, sum(n)::BIGINT AS supply FROM doc GROUP BY 1),
line AS (SELECT m.mix_id, s.source, s.supply, m.weight * m.total_tokens AS need, m.max_repeats, least(floor(m.weight * m.total_tokens / s.supply), m.max_repeats)::BIGINT AS epochs FROM mix_targets m JOIN sup s ON s.source = {sql_fold('m.source')} WHERE s.supply > 0),
rest AS (SELECT *, CASE WHEN epochs < max_repeats THEN need - epochs * supply ELSE 0 END AS rest FROM line),
keyed AS (SELECT r.mix_id, d.source, d.doc_id, rest, sum(n) OVER (PARTITION BY r.mix_id, d.source ORDER BY -ln({_UNIT("'0'", 'r.mix_id', 'd.doc_id')}), d.doc_id) AS upto FROM rest r JOIN doc d ON d.source = r.source WHERE rest > 0),
every AS (SELECT mix_id, source, doc_id, 1 AS copies FROM keyed WHERE upto <= rest UNION ALL SELECT mix_id, r.source, doc_id, epochs FROM rest r JOIN doc d ON d.source = r.source WHERE epochs > 0)
SELECT mix_id, source, doc_id, sum(copies)::BIGINT AS copies FROM every GROUP BY 1, 2, 3""",
    "p4_found": f"{_PROFILE} SELECT p AS profile_id, min(q) AS cluster_first FROM link GROUP BY 1 HAVING count(*) > 1",
    "p1_found": f"{_PAIRS} SELECT section_id, type_a, type_b FROM counted WHERE n_ab >= 8 AND n_ab * n_tiles >= 2 * n_a * n_b",
    "p1_pairs": f"{_PAIRS} SELECT section_id, type_a, type_b, n_ab, n_a, n_b, n_tiles, round(n_ab::DOUBLE * n_tiles / (n_a::DOUBLE * n_b), 6) AS lift FROM counted",
    "p2_found": f"{_DIST} SELECT section_id, cell_type FROM dist GROUP BY 1, 2 HAVING max(n) >= 50 AND min(d) FILTER (WHERE q >= 0.95) >= 6 * min(d) FILTER (WHERE q >= 0.5)",
    "p2_percentiles": f"{_DIST} SELECT section_id, cell_type, max(n) AS n_values, min(d) FILTER (WHERE q >= 0.5) AS p50, min(d) FILTER (WHERE q >= 0.9) AS p90, min(d) FILTER (WHERE q >= 0.95) AS p95, min(d) FILTER (WHERE q >= 0.99) AS p99 FROM dist GROUP BY 1, 2",
    "p3_found": f"""WITH RECURSIVE {ATLAS}, own AS (SELECT DISTINCT {_ID('donor_id')} AS d, {_ID('specimen_id')} AS s FROM atlas WHERE donor_id IS NOT NULL),
tie AS (SELECT a.d AS a, b.d AS b FROM own a JOIN own b ON a.s = b.s AND regexp_full_match(a.s, 'SP[0-9]{{9}}') UNION SELECT {_ID('donor_a')}, {_ID('donor_b')} FROM donor_links WHERE {sql_fold('relation')} IN ('same person', 'merged') AND withdrawn_at IS NULL UNION SELECT {_ID('donor_b')}, {_ID('donor_a')} FROM donor_links WHERE {sql_fold('relation')} IN ('same person', 'merged') AND withdrawn_at IS NULL),
reach AS (SELECT DISTINCT d AS a, d AS b FROM own UNION SELECT r.a, t.b FROM reach r JOIN tie t ON r.b = t.a)
SELECT DISTINCT a AS donor_a, b AS donor_b FROM reach WHERE a < b AND b IN (SELECT d FROM own)""",
    "p6_found": f"{_ASK} SELECT target_id, line_no FROM got WHERE n < ask",
    "p6_report": f"{_ASK} SELECT target_id, line_no, ask, n AS n_available, least(n, ask) AS n_drawn FROM got",
    "p8_found": f"""WITH supply AS (SELECT {sql_fold('source')} AS source, sum(length(text)) / 4.0 AS tokens FROM documents GROUP BY 1)
SELECT mix_id, {sql_fold('m.source')} AS source FROM mix_targets m LEFT JOIN supply s ON s.source = {sql_fold('m.source')} WHERE weight * total_tokens > max_repeats * coalesce(tokens, 0)""",
}
