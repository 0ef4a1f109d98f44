"""Pieces of SQL that the oracles share."""


def fold(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


_SCALE = f"CASE WHEN {fold('coord_unit')} = 'mm' THEN 1000.0::DOUBLE WHEN {fold('coord_unit')} = 'px' THEN px_um WHEN coord_unit IS NULL OR {fold('coord_unit')} IN ('um', 'µm', 'μm') THEN 1.0::DOUBLE END"

#: cell: current rows of cells with typ, lin, tum, tt (from type_labels) and xu, yu in micrometres.
CELL = f"""cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM cells WHERE cell_id IS NOT NULL) WHERE rn = 1),
placed AS (SELECT cur.*, coalesce(a.cell_type, b.cell_type) AS typ, coalesce(a.lineage, b.lineage) AS lin, coalesce(a.is_tumour, b.is_tumour) AS tum, coalesce(a.in_time_types, b.in_time_types) AS tt, x * ({_SCALE}) AS xr, y * ({_SCALE}) AS yr
  FROM cur LEFT JOIN type_labels a ON a.raw_label = {fold('cur.time_type')} LEFT JOIN type_labels b ON b.raw_label = {fold('cur.cell_type')} LEFT JOIN sections s ON s.section_id = cur.section_id),
cell AS (SELECT *, CASE WHEN isfinite(xr) AND isfinite(yr) THEN xr END AS xu, CASE WHEN isfinite(xr) AND isfinite(yr) THEN yr END AS yu FROM placed)"""

#: atlas: current rows of atlas_obs.
ATLAS = "atlas AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM atlas_obs WHERE obs_id IS NOT NULL) WHERE rn = 1)"


def normal_tail(z: str) -> str:
    """P(N > z): half minus the series of positive terms exp(-z^2 / 2) / sqrt(2 pi) * sum z^(2n+1) / (1 * 3 * ... * (2n+1))."""
    series = f"list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(greatest(abs({z}), 1e-300)) - ({z}) ** 2 / 2 - (lgamma(2.0 * n + 2) - n * ln(2) - lgamma(n + 1.0)))))"
    return f"CASE WHEN ({z}) IS NULL THEN NULL WHEN abs({z}) > 12 THEN CASE WHEN ({z}) > 0 THEN 0 ELSE 1 END ELSE 0.5 - sign({z}) * {series} / sqrt(2 * pi()) END"


def chi2_tail(x: str, k: str) -> str:
    half = f"greatest({x} / 2, 1e-300)"
    even = f"coalesce(list_sum(list_transform(range(0, ({k}) // 2), lambda i: exp(i * ln({half}) - {half} - lgamma(i + 1.0)))), 0)"
    odd = f"coalesce(list_sum(list_transform(range(0, ({k}) // 2), lambda i: exp((i + 0.5) * ln({half}) - {half} - lgamma(i + 1.5)))), 0)"
    root = f"sqrt({x})"
    return f"CASE WHEN ({k}) % 2 = 0 THEN {even} ELSE {odd} + 2 * ({normal_tail(root)}) END"


def t_two_sided(t: str, k: str) -> str:
    a = f"atan(abs({t}) / sqrt({k}))"
    odd = f"(2 / pi()) * ({a} + sin({a}) * coalesce(list_sum(list_transform(range(0, (({k})::BIGINT - 1) // 2), lambda j: exp(2 * j * ln(2) + 2 * lgamma(j + 1.0) - lgamma(2.0 * j + 2)) * cos({a}) ** (2 * j + 1))), 0))"
    even = f"sin({a}) * list_sum(list_transform(range(0, ({k})::BIGINT // 2), lambda j: exp(lgamma(2.0 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1.0)) * cos({a}) ** (2 * j)))"
    return f"greatest(0, 1 - CASE WHEN ({k})::BIGINT % 2 = 1 THEN {odd} ELSE {even} END)"


def fdr(table: str, p: str = "p", by: str = "", into: str = "q") -> str:
    """A query that adds the step-up false discovery rate to a table with p values that are not null."""
    part = f"PARTITION BY {by} " if by else ""
    raw = f"SELECT *, {p} * count(*) OVER ({part}) / count(*) OVER ({part}ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS raw_ FROM {table}"
    return f"SELECT * EXCLUDE (raw_), least(1, min(raw_) OVER ({part}ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) AS {into} FROM ({raw})"
