"""A sample that matches target category proportions, with minimums and a report of what could not be met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import fold, uniform
from cellgrove.plans import cut, few, kept, ranked


def _folded(fields: list[str]):
    return [F.when(fold(f) != "", fold(f)).alias(f) for f in fields]


def asked_lines(targets: DataFrame, fields: list[str]) -> DataFrame:
    """target_id, line_no, the folded fields (null = any value), mask (bit i: field i counts), ask.

    A line asks for round(share * draw_rows) rows, halves up, but at least min_rows; nulls count as 0.
    """
    ask = F.greatest(F.round(F.coalesce("share", F.lit(0.0)) * F.coalesce("draw_rows", F.lit(0))), F.coalesce("min_rows", F.lit(0))).cast("bigint")
    mask = sum((F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    return targets.select("target_id", "line_no", *_folded(fields), ask.alias("ask")).withColumn("mask", mask)


def _masks(lines: DataFrame) -> list[int]:
    """The sets of fields that some line uses: at most 2 to the power of the number of fields."""
    return sorted(r[0] for r in lines.select("mask").distinct().collect())


def _by_mask(rows: DataFrame, masks: list[int], fields: list[str], more: list[str]) -> DataFrame:
    """Each row once for every mask whose fields it has, with those fields as one array key and the columns in more.

    Folded values are never empty, so an empty string can stand for a field that the mask leaves open.
    """
    uses = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    out = rows.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    for i, f in enumerate(fields):
        out = out.where(~uses(i) | F.col(f).isNotNull())
    return out.select("mask", F.array(*[F.when(uses(i), F.col(f)).otherwise(F.lit("")) for i, f in enumerate(fields)]).alias("kind"), *more)


def available(rows: DataFrame, lines: DataFrame, fields: list[str]) -> DataFrame:
    """lines with n_available, the rows that match all non-null fields of the line (rows: folded fields).

    Rows are counted once by all fields; those few counts are summed for each set of fields that some line uses, and
    joined by equality. A row with a null field matches only lines that leave that field open.
    """
    masks = _masks(lines)
    if not masks:
        return lines.withColumn("n_available", F.lit(0).cast("bigint"))
    kinds = rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))
    sums = _by_mask(kinds, masks, fields, ["n"]).groupBy("mask", "kind").agg(F.sum("n").alias("n_available"))
    keyed = lines.withColumn("kind", F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    return keyed.join(sums, ["mask", "kind"], "left").drop("kind").withColumn("n_available", F.coalesce("n_available", F.lit(0)))


#: Stretches of (0, 1) by which rows and lines meet: a line meets only rows whose number it may accept, and the rows of
#: one category are spread over as many keys.
STRETCHES = 256


def _matches(rows: DataFrame, lines: DataFrame, fields: list[str], key: str) -> DataFrame:
    """target_id, line_no, ask, key, v: the rows that each line accepts; v is below the line's `accept`.

    Every row has one uniform number u and every line one start, both from an md5; v is how far u lies beyond the start,
    going round from 1 to 0. For a line v is uniform and independent from row to row, and the accepted rows are those
    of a few stretches of u: row and line are joined by category and stretch, so no more pairs arise than are accepted.
    """
    masks = _masks(lines)
    stretch = lambda c: F.floor(c * STRETCHES).cast("int")
    side = _by_mask(rows.withColumn("u", uniform(F.col(key))), masks, fields, [F.col(key).alias("_key"), "u", stretch(F.col("u")).alias("at")])
    start = uniform("target_id", "line_no")
    wanted = lines.select("target_id", "line_no", "ask", "mask", "accept", F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields]).alias("kind"), start.alias("start"))
    places = F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.least("accept", F.lit(1.0))))
    wanted = wanted.withColumn("at", F.explode(F.array_distinct(F.transform(places, lambda i: i % STRETCHES))))
    v = F.col("u") - F.col("start") + F.when(F.col("u") < F.col("start"), 1.0).otherwise(0.0)
    both = side.join(few(wanted), ["mask", "kind", "at"]).withColumn("v", v)
    return both.where(F.col("v") < F.col("accept")).select("target_id", "line_no", "ask", F.col("_key").alias(key), "v")


def sample_to_targets(rows: DataFrame, targets: DataFrame, fields: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every target: rows drawn without replacement for each of its lines.

    rows: one per key, with the fields. targets: target_id, line_no, the fields, share, min_rows, draw_rows. Values
    are folded on both sides; an empty one is null. Rows without a key are left out, lines without target_id or line_no
    too. Each row is accepted for a line with the probability ask / available, raised by six standard deviations and
    independently from row to row; where chance still left too few, the line is drawn again with everything accepted.
    Then the accepted rows are ranked by their random numbers (key decides ties) and the first `ask` are the sample.
    Different lines use the same numbers from different starts: each line's sample is as random as if it were alone.
    sample: target_id, line_no, key. report: target_id, line_no, ask, n_available, n_drawn, deficit; a line whose
    deficit is above 0 could not be met, and all that there is was drawn for it.
    """
    rows = kept(rows.where(F.col(key).isNotNull()).select(key, *_folded(fields)))
    lines = asked_lines(targets, fields).where("target_id is not null and line_no is not null")
    lines = cut(available(rows, lines, fields))
    p = F.col("ask") / F.col("n_available")
    slack = (6 * F.sqrt(F.col("ask").cast("double")) + 6) / F.col("n_available")
    lines = lines.withColumn("accept", F.when(F.col("n_available") > 0, F.least(F.lit(1.0), p + slack)).otherwise(F.lit(0.0)))
    first = cut(_matches(rows, lines.where("ask > 0 and n_available > 0"), fields, key))
    got = first.groupBy("target_id", "line_no").agg(F.count(F.lit(1)).alias("n_first"))
    short = cut(lines.join(got, ["target_id", "line_no"], "left").where(F.coalesce("n_first", F.lit(0)) < F.least("ask", "n_available")).drop("n_first").withColumn("accept", F.lit(2.0)))
    if short.limit(1).count():
        again = _matches(rows, short, fields, key)
        first = first.join(short.select("target_id", "line_no"), ["target_id", "line_no"], "left_anti").unionByName(again)
    place = ranked(first, ["target_id", "line_no"], ["v", key])
    sample = cut(place.where(F.col("rank") <= F.col("ask")).select("target_id", "line_no", key))
    drawn = sample.groupBy("target_id", "line_no").agg(F.count(F.lit(1)).alias("n_drawn"))
    report = lines.join(drawn, ["target_id", "line_no"], "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0)))
    report = report.select("target_id", "line_no", *fields, "ask", "n_available", "n_drawn", (F.col("ask") - F.col("n_drawn")).alias("deficit"))
    return sample, report
