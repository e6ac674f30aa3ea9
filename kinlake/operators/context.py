"""Rank, gap and competition windows over candidate pairs (i, j, src, scores)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, key: Sequence[str], scores: Sequence[str], tie: str, prefix: str) -> DataFrame:
    whole = Window.partitionBy(*key)
    out = df
    for s in scores:
        out = out.withColumn(f"{prefix}rk_{s}", F.row_number().over(whole.orderBy(F.desc(s), tie)).cast("bigint"))
        out = out.withColumn(f"{prefix}gap_{s}", F.round(F.max(s).over(whole) - F.col(s), 6))
    return out


def context(pairs: DataFrame, scores: Sequence[str] = ("cc", "cm", "ca")) -> DataFrame:
    """Per anchor: rk_ and gap_ to the best of each score, n_cand, and rk_cm_src within the source. One shuffle by i."""
    out = _ranked(pairs, ["i"], scores, "j", "").withColumn("n_cand", F.count("*").over(Window.partitionBy("i")))
    return out.withColumn("rk_cm_src", F.row_number().over(Window.partitionBy("i", "src").orderBy(F.desc("cm"), "j")).cast("bigint"))


def reverse_context(pairs: DataFrame, scores: Sequence[str] = ("cc", "cm", "ca")) -> DataFrame:
    """Per target: rev_rk_, rev_gap_ and rev_n. One shuffle by j."""
    return _ranked(pairs, ["j"], scores, "i", "rev_").withColumn("rev_n", F.count("*").over(Window.partitionBy("j")))


def context_ties(pairs: DataFrame) -> DataFrame:
    """Ranks that ties share. Pairs that have rk_cm (`nearest.ranked`) keep it and are shuffled by the target alone."""
    own = F.col("rk_cm") if "rk_cm" in pairs.columns else F.rank().over(Window.partitionBy("i").orderBy(F.desc("cm")))
    return pairs.select("i", "j", own.cast("bigint").alias("rk_cm"), F.rank().over(Window.partitionBy("j").orderBy(F.desc("cm"))).cast("bigint").alias("rev_rk_cm"))


def blended_context(pairs: DataFrame) -> DataFrame:
    """Context of the blend 0.6 cn + 0.4 ca, with cn the name score cc."""
    p = pairs.withColumn("sim", F.round(0.6 * F.col("cc") + 0.4 * F.col("ca"), 6))
    i, j, s = Window.partitionBy("i"), Window.partitionBy("j"), Window.partitionBy("i", "src")
    rn = lambda w, c, t: F.row_number().over(w.orderBy(F.desc(c), t)).cast("bigint")
    return p.select(
        "i", "j", "sim", rn(i, "sim", "j").alias("r_sim"), rn(i, "cc", "j").alias("r_cn"), F.max("sim").over(i).alias("max_sim"),
        F.round(F.max("sim").over(i) - F.col("sim"), 6).alias("gap_sim"), F.count("*").over(i).alias("n_c"), rn(s, "sim", "j").alias("r_sim_src"), F.count("*").over(s).alias("n_c_src"),
        rn(j, "sim", "i").alias("rev_r"), F.count("*").over(j).alias("rev_n"), F.round(F.max("sim").over(j) - F.col("sim"), 6).alias("rev_gap"),
    )


def _other(key: str, tie: str) -> tuple[Column, Column, Column]:
    """(row number, best, second best or 0) over a key, by p."""
    w = Window.partitionBy(key).orderBy(F.desc("p"), tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.row_number().over(w), F.first("p").over(whole), F.coalesce(F.nth_value("p", 2).over(whole), F.lit(0.0))


def group_stats(pairs: DataFrame) -> DataFrame:
    """Of each anchor's probabilities: rank, gap to the best, sum, how many above one half, the best other, size, and rank and size
    within the source."""
    rn, best, second = _other("i", "j")
    i, s = Window.partitionBy("i"), Window.partitionBy("i", "src")
    return pairs.select(
        "i", "j", rn.cast("bigint").alias("rk"), F.round(best - F.col("p"), 6).alias("gap"), F.round(F.sum("p").over(i), 6).alias("total"),
        F.sum((F.col("p") > 0.5).cast("bigint")).over(i).alias("n_half"), F.when(rn == 1, second).otherwise(best).alias("other"), F.count("*").over(i).alias("n"),
        F.row_number().over(s.orderBy(F.desc("p"), "j")).cast("bigint").alias("rk_src"), F.count("*").over(s).alias("n_src"),
    )


def competition(pairs: DataFrame) -> DataFrame:
    """Of each target's claims: the best other, rank, sum of the others, number, and margin over the best other."""
    rn, best, second = _other("j", "i")
    j = Window.partitionBy("j")
    other = F.when(rn == 1, second).otherwise(best)
    return pairs.select(
        "i", "j", "p", other.alias("other"), rn.cast("bigint").alias("rank"), F.round(F.sum("p").over(j) - F.col("p"), 6).alias("sumo"), F.count("*").over(j).alias("n"), F.round(F.col("p") - other, 6).alias("margin"),
    )


def exclusivity(pairs: DataFrame) -> DataFrame:
    """p for a target's strongest claim, and at most 1 - best for the others."""
    rn, best, _ = _other("j", "i")
    return pairs.select("i", "j", F.when(rn == 1, F.col("p")).otherwise(F.round(F.least("p", 1.0 - best), 6)).alias("p"))


def exclusivity_symmetric(pairs: DataFrame) -> DataFrame:
    """At most 1 - the best other claim, for the strongest too."""
    rn, best, second = _other("j", "i")
    return pairs.select("i", "j", F.round(F.least("p", 1.0 - F.when(rn == 1, second).otherwise(best)), 6).alias("p"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """p where it is its target's best (ties all), else 0."""
    return pairs.select("i", "j", F.when(F.col("p") >= F.max("p").over(Window.partitionBy("j")), F.col("p")).otherwise(0.0).alias("p"))
