"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import fold, uniform
from cellgrove.operators.components import min_label_components
from cellgrove.plans import cut, kept, running_total

def key_of(c) -> F.Column:
    """A donor or specimen id: trimmed, upper case; null where nothing is left."""
    c = F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def donors(atlas: DataFrame) -> DataFrame:
    """record, specimen: the distinct donor ids (trimmed, upper case) of the rows with their specimen barcodes.

    A barcode is SP and nine digits; anything else is none (null). Rows without a donor id are left out.
    """
    spec = key_of(F.col("specimen_id"))
    return atlas.select(key_of(F.col("donor_id")).alias("record"), F.when(spec.rlike("^SP[0-9]{9}$"), spec).alias("specimen")).where("record is not null").distinct()


def donor_entities(people: DataFrame, links: DataFrame) -> DataFrame:
    """record (donor id), entity: what ties donor ids to one person. people: as donors gives them.

    A specimen barcode is an entity of each donor it occurs with; so is a report with the folded relation "same person"
    or "merged" that is not withdrawn, of its two ids. Donors without any have none.
    """
    bars = people.where("specimen is not null").select("record", F.concat(F.lit("S|"), "specimen").alias("entity"))
    a, b = key_of(F.col("donor_a")), key_of(F.col("donor_b"))
    valid = links.where(fold("relation").isin("same person", "merged") & F.col("withdrawn_at").isNull()).select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    pair = F.concat_ws("|", F.lit("L"), F.least("a", "b"), F.greatest("a", "b"))
    reports = valid.select(F.explode(F.array("a", "b")).alias("record"), pair.alias("entity"))
    return bars.unionByName(reports)


def same_person_pairs(atlas: DataFrame, links: DataFrame) -> DataFrame:
    """donor_a < donor_b: ids with rows in atlas that one chain of barcodes and reports ties together.

    Ids without rows carry chains but are not returned. Null ids, barcodes and relations tie nothing. The atlas is read
    once, for its distinct donors and barcodes. A person with k ids has k (k - 1) / 2 pairs, which is the asked result.
    """
    there = cut(donors(atlas))
    people = kept(min_label_components(donor_entities(there, links)))
    mine = people.join(there.select("record").distinct(), "record", "left_semi")
    a, b = mine.select(F.col("record").alias("donor_a"), "label"), mine.select(F.col("record").alias("donor_b"), "label")
    return a.join(b, "label").where("donor_a < donor_b").select("donor_a", "donor_b")


#: The descent ends when a round lowers the deviation by less than this share.
SETTLED = 0.03


def _by_home(units: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """unit, split: units of each home stratum in hash order, dealt by the running total of their rows."""
    run = running_total(units.withColumn("u", uniform(F.lit(seed), "unit")), ["home"], ["u", "unit"], "n_rows", "upto")
    every = units.groupBy(F.col("home").alias("_h")).agg(F.sum("n_rows").alias("all_rows"))
    at = (F.col("upto") - F.col("n_rows") / 2) / F.col("all_rows")
    edge, split = 0.0, None
    for s, share in shares.items():
        edge += share
        split = F.when(at <= edge, s) if split is None else split.when(at <= edge, s)
    return run.join(every, F.col("home") == F.col("_h")).select("unit", split.otherwise(F.lit(list(shares)[-1])).alias("split"))


def split_shares(n: DataFrame, placed: DataFrame, shares: dict[str, float]) -> DataFrame:
    """stratum, split, n_rows, share, target_share for every stratum and split. n: unit, stratum, n; placed: unit, split."""
    have = n.join(placed, "unit").groupBy("stratum", "split").agg(F.sum("n").alias("n_rows"))
    names = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(float(v)).alias("target_share")) for s, v in shares.items()])).alias("s")
    grid = n.groupBy("stratum").agg(F.sum("n").alias("total")).select("stratum", "total", names).select("stratum", "total", "s.*")
    full = grid.join(have, ["stratum", "split"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return full.select("stratum", "split", "total", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"), "target_share")


def _deviation(table: DataFrame) -> float:
    aim = F.col("target_share") * F.col("total")
    return table.agg(F.sum((F.col("n_rows") - aim) * (F.col("n_rows") - aim) / aim)).first()[0] or 0.0


def _moves(n: DataFrame, units: DataFrame, placed: DataFrame, table: DataFrame) -> DataFrame:
    """unit, goal, change: the units whose move to another split lowers the deviation over all their strata, best first
    and no more of them between two splits in a home stratum than half of the surplus there and the shortage here."""
    aim = F.col("target_share") * F.col("total")
    t = table.select("stratum", "split", (F.col("n_rows") - aim).alias("gap"), aim.alias("aim"))
    here = t.select("stratum", "split", F.col("gap").alias("g0"), F.col("aim").alias("a0"))
    there = t.select("stratum", F.col("split").alias("goal"), F.col("gap").alias("g1"), F.col("aim").alias("a1"))
    # ((g0 - n)^2 - g0^2) / a0 + ((g1 + n)^2 - g1^2) / a1, summed over the strata of the unit
    change = (F.col("n") - 2 * F.col("g0")) * F.col("n") / F.col("a0") + (F.col("n") + 2 * F.col("g1")) * F.col("n") / F.col("a1")
    each = n.join(placed, "unit").join(here, ["stratum", "split"]).join(there, "stratum").where("split <> goal")
    gain = each.groupBy("unit", "split", "goal").agg(F.sum(change).alias("change")).where("change < 0")
    best = gain.groupBy("unit", "split").agg(F.min(F.struct("change", "goal")).alias("b")).select("unit", "split", "b.change", "b.goal").join(units, "unit")
    room = here.select("stratum", "split", "g0").join(there.select("stratum", "goal", "g1"), "stratum")
    room = room.select(F.col("stratum").alias("home"), "split", "goal", (F.lit(0.5) * F.least(F.greatest("g0", F.lit(0.0)), F.greatest(-F.col("g1"), F.lit(0.0)))).alias("room"))
    per_row = F.col("change") / F.col("n_rows")
    queue = running_total(best.withColumn("per_row", per_row), ["home", "split", "goal"], ["per_row", "unit"], "n_rows", "upto")
    return queue.join(room, ["home", "split", "goal"]).where(F.col("upto") - F.col("n_rows") <= F.col("room")).select("unit", "goal", "change")


def grouped_split(rows: DataFrame, unit: str, stratum: str, shares: dict[str, float], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(placed, reached): one split per unit (component of related records), near the given shares within every stratum.

    rows: one per record, with its unit and its stratum (a null stratum is one of its own; rows without a unit are
    left out). shares: name to proportion; they are scaled to 1. The deviation is the sum over strata and splits of
    (rows - target)^2 / target. Units of any size are treated alike: first they are dealt, within the stratum that they
    weigh most in, in hash order by the running total of their rows; then rounds move units whose move lowers the
    deviation, counted over all their strata, until a round lowers it by less than SETTLED. A round that does not lower
    it is taken back; one that lowers it by less is followed by rounds of fewer moves, at last of the best one alone.
    placed: unit, split, n_rows. reached: stratum, split, total, n_rows, share, target_share.
    """
    whole = sum(shares.values())
    shares = {k: v / whole for k, v in shares.items() if v > 0}
    n = cut(rows.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit"), F.coalesce(F.col(stratum), F.lit("(none)")).alias("stratum")).agg(F.count(F.lit(1)).alias("n")))
    totals = n.groupBy("stratum").agg(F.sum("n").alias("total"))
    home = F.max_by("stratum", F.struct((F.col("n") / F.col("total")).alias("w"), "stratum"))
    units = cut(n.join(totals, "stratum").groupBy("unit").agg(home.alias("home"), F.sum("n").alias("n_rows")))
    placed = cut(_by_home(units, shares, seed))
    table = kept(split_shares(n, placed, shares))
    now, most = _deviation(table), None
    while now > 0 and len(shares) > 1:
        moves = _moves(n, units, placed, table)
        moves = moves.orderBy("change", "unit").limit(most) if most else moves
        after = cut(placed.join(moves.select("unit", "goal"), "unit", "left").select("unit", F.coalesce("goal", "split").alias("split"), F.col("goal").isNotNull().alias("moved")))
        tried = after.where("moved").count()
        if not tried:
            break
        reached = kept(split_shares(n, after.drop("moved"), shares))
        then = _deviation(reached)
        settled = then > now * (1 - SETTLED)
        if then < now:
            placed, table, now = after.drop("moved"), reached, then
        if settled:
            if tried == 1:
                break
            most = max(1, tried // 8)  # moves of one round do not know of each other: fewer at a time
    return placed.join(units.select("unit", "n_rows"), "unit"), table


__all__ = ["donor_entities", "donors", "grouped_split", "key_of", "same_person_pairs", "split_shares"]
