"""Roles of templates in an answer to a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least scores and most templates of the roles beside the primary one.
SUPPORTING, STYLE = (18, 3), (14, 2)


def compose(scored: DataFrame, key: str) -> DataFrame:
    """(key, target, role, place) of templates scored (key, target, score, primary_score, roles, assigned, negative_for).

    Of templates above 0, the primary is the best by primary_score of those that can be, else the best by score. Those that share a
    negative_for with it are rejected; of the rest the best by score are supporting and style, in numbers and from scores that are
    fixed. Ties go by target. A key's rows meet in one task: they are as many as there are templates.
    """
    order = (F.desc("score"), F.col("target"))
    can = F.array_contains("roles", "primary")
    best = Window.partitionBy(key).orderBy(F.desc(can), F.when(can, -F.col("primary_score")), *order)
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = scored.filter("score > 0").select("*", F.first("target").over(whole).alias("_primary"), F.first("negative_for").over(whole).alias("_against"))
    other = F.col("target") != F.col("_primary")
    clash = other & F.coalesce(F.arrays_overlap("negative_for", "_against"), F.lit(False))
    fit = marked.withColumn("_clash", clash).withColumn("_other", other)
    helps = F.col("_other") & ~F.col("_clash")
    supports = helps & (F.col("score") >= SUPPORTING[0]) & (F.array_contains("roles", "supporting") | (F.col("assigned") == "supporting"))
    styles = helps & (F.col("score") >= STYLE[0]) & F.array_contains("roles", "style")
    roles = F.filter(F.array(F.when(~F.col("_other"), "primary"), F.when(F.col("_clash"), "rejected"), F.when(supports, "supporting"), F.when(styles, "style")), lambda r: r.isNotNull())
    placed = fit.select(key, "target", "score", F.explode(roles).alias("role")).withColumn("place", F.row_number().over(Window.partitionBy(key, "role").orderBy(*order)))
    kept = (F.col("role") != "supporting") | (F.col("place") <= SUPPORTING[1])
    return placed.filter(kept & ((F.col("role") != "style") | (F.col("place") <= STYLE[1]))).select(key, "target", "role", "place")
