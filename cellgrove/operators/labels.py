"""Applying label tables to cells, with the guards that stop a wrong table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_coarse(cells: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """cells with cell_type and lineage of their cluster. table: <key>, cell_type, lineage; repeated rows are one.

    A cluster of the cells without a row in the table is a ValueError that names it. A null cluster keeps null labels.
    """
    table = table.dropDuplicates([key])
    missing = cells.where(F.col(key).isNotNull()).select(key).distinct().join(table, key, "left_anti").orderBy(key).limit(5).collect()
    if missing:
        raise ValueError(f"clusters without a label: {', '.join(str(r[0]) for r in missing)}")
    return cells.drop("cell_type", "lineage").join(table.select(key, "cell_type", "lineage"), key, "left")


def guard_markers(ranked: DataFrame, guards: DataFrame, top: int = 10) -> None:
    """Raises a ValueError unless each guard marker is among the first `top` markers of its group.

    ranked: grp, gene, rank; guards: grp, gene.
    """
    lost = guards.join(ranked.where(F.col("rank") <= top), ["grp", "gene"], "left_anti").orderBy("grp", "gene").limit(5).collect()
    if lost:
        raise ValueError("guard markers not among the first: " + ", ".join(f"{r.grp}/{r.gene}" for r in lost))


def merge_labels(cells: DataFrame, fine: DataFrame, overrides: DataFrame, subset: str = "Myeloid") -> DataFrame:
    """cells (id, cell_type, lineage, conf) with the fine labels (id, fine_type, fine_conf, from_subset) over them.

    The fine type and confidence hold where there are any. lineage: the subset's name for cells of the subset that was
    labelled again, else the override of the new type (overrides: cell_type, lineage), else the coarse one.
    """
    o = overrides.select(F.col("cell_type").alias("_t"), F.col("lineage").alias("_l")).dropDuplicates(["_t"])
    m = cells.join(fine, "id", "left").withColumn("_new", F.coalesce("fine_type", "cell_type"))
    m = m.join(o, F.col("_new") == F.col("_t"), "left")
    line = F.when(F.coalesce("from_subset", F.lit(False)), F.lit(subset)).otherwise(F.coalesce("_l", "lineage"))
    return m.select("id", F.col("_new").alias("cell_type"), line.alias("lineage"), F.coalesce("fine_conf", "conf").alias("conf"))


def listed_or_other(c: Column, types: list[str]) -> Column:
    """The type if it is listed, else other; also for null."""
    return F.when(c.isin(types), c).otherwise(F.lit("other"))


def clean_t_helper(rates: DataFrame) -> DataFrame:
    """Adds clean and regulatory to rates of whole percents (cd4, t, cd8a, foxp3, f1..f5): CD4 at least 30, T at least
    60, CD8A below 20, no foreign rate of 25 or more; FOXP3 at least 25. A null rate counts as 0."""
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    worst = F.greatest(*[v(f"f{i}") for i in range(1, 6)])
    return rates.withColumns({"clean": (v("cd4") >= 30) & (v("t") >= 60) & (v("cd8a") < 20) & (worst < 25), "regulatory": v("foxp3") >= 25})


def head_and_tail(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows with the smallest and the n with the largest value, each once; ties by key."""
    a, b = df.orderBy(by, key).limit(n), df.orderBy(F.col(by).desc(), key).limit(n)
    return a.union(b).dropDuplicates([key])


def best_of(df: DataFrame, group: list[str], value: Column, pick: list[str]) -> DataFrame:
    """The row of each group with the largest value, ties to the smallest of pick (compared in order)."""
    w = Window.partitionBy(*group).orderBy(value.desc(), *pick)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def verdicts(figures: DataFrame, rules: list[tuple[str, str, float, str, str]]) -> DataFrame:
    """question, figure, verdict from a one-row table: for each rule (question, column, threshold, if reached, if not).

    A null figure is "not scored"."""
    rows = [F.struct(F.lit(q).alias("question"), F.col(c).cast("double").alias("figure"), F.when(F.col(c).isNull(), "not scored").when(F.col(c) >= t, yes).otherwise(no).alias("verdict")) for q, c, t, yes, no in rules]
    return figures.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
