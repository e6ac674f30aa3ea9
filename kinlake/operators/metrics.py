"""Blocking recall, entity and macro F0.5, sweeps, error reports, result validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlake.sources.scratch import materialise


def f05(tp: Column, predicted: Column, actual: Column) -> Column:
    """1 if both sets are empty, 0 without a hit, else 1.25 P R / (0.25 P + R) = 1.25 tp / (predicted + 0.25 actual)."""
    return F.when((predicted == 0) & (actual == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (predicted + 0.25 * actual))


def entity_f05(predicted: DataFrame, truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """(i, n_pred, n_true, tp, f05) of every anchor. Pairs and truth meet in one grouped count; no join of pairs."""
    marks = predicted.select("i", "j", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(truth.select("i", "j", F.lit(0).alias("a"), F.lit(1).alias("b")))
    pairs = marks.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = pairs.groupBy("i").agg(F.sum("a").alias("n_pred"), F.sum("b").alias("n_true"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    out = anchors.select("i").join(n, "i", "left").na.fill(0, ["n_pred", "n_true", "tp"])
    return out.withColumn("f05", F.round(f05(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6))


def macro_f05(predicted: DataFrame, truth: DataFrame, anchors: DataFrame) -> DataFrame:
    return entity_f05(predicted, truth, anchors).agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.count("*").alias("entities"))


def recall(candidates: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of true pairs among the candidates, in all or by columns of `truth`. The true pairs are written first, so that their size is known: where
    they are few, candidates that are none of them are dropped where they lie, and only hits are shuffled."""
    truth = materialise(truth, "truth")
    found = candidates.select("i", "j").join(truth.select("i", "j"), ["i", "j"], "left_semi").distinct()
    hit = truth.join(found.withColumn("hit", F.lit(1)), ["i", "j"], "left")
    return hit.groupBy(*(by or [])).agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def threshold_sweep(pairs: DataFrame, truth: DataFrame, anchors: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, macro_f05) of each threshold. A pair is shuffled once, with how many thresholds it reaches; an anchor's pairs are counted by that number,
    and the sweep reads these counts."""
    levels = sorted(float(t) for t in thresholds)
    t = truth.select("i", "j", F.lit(1).alias("y")).distinct()
    n_true = t.groupBy("i").agg(F.count("*").alias("n_true"))
    level = sum(((F.col("p") >= x).cast("int") for x in levels), F.lit(0))
    scored = pairs.select("i", "j", level.alias("level")).filter("level > 0").join(t, ["i", "j"], "left").groupBy("i", "level").agg(F.count("*").alias("n"), F.count("y").alias("tp"))
    counts = scored.groupBy("i").agg(F.collect_list(F.struct("level", "n", "tp")).alias("c"))
    out = anchors.select("i").join(counts, "i", "left").join(n_true, "i", "left").na.fill(0, ["n_true"])
    out = out.select("c", "n_true", F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("k", "threshold"))
    above = lambda x: F.coalesce(F.aggregate("c", F.lit(0).cast("bigint"), lambda s, v: s + F.when(v["level"] > F.col("k"), v[x]).otherwise(0)), F.lit(0))
    return out.groupBy("threshold").agg(F.round(F.avg(f05(above("tp"), above("n"), F.col("n_true"))), 6).alias("macro_f05"))


def error_category(n_pred: Column, n_true: Column, tp: Column, reachable: Column) -> Column:
    return (
        F.when((n_true == 0) & (n_pred > 0), "singleton_false_merge").when((n_true > 0) & (reachable == 0), "match_not_in_candidates")
        .when((n_true > 0) & (n_pred == 0), "predicted_empty_but_reachable").when((n_true > 0) & (tp == 0), "only_wrong_picks")
        .when((n_true > 0) & ((tp < n_true) | (tp < n_pred)), "partial_set").otherwise("correct")
    )


def error_rows(predicted: DataFrame, truth: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every anchor with its scores, how many true pairs its candidates hold, and the error category."""
    e = entity_f05(predicted, truth, anchors)
    reach = truth.join(candidates.select("i", "j").distinct(), ["i", "j"]).groupBy("i").agg(F.count("*").alias("reachable"))
    e = e.join(reach, "i", "left").na.fill(0, ["reachable"])
    return e.withColumn("category", error_category(F.col("n_pred"), F.col("n_true"), F.col("tp"), F.col("reachable")))


def error_report(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("entities"), F.round(F.sum(1.0 - F.col("f05")), 6).alias("lost"), F.round(F.avg("f05"), 6).alias("mean_f05"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The one row of a sweep with the greatest F0.5, the least threshold among equals."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def error_examples(rows: DataFrame, per_category: int = 25) -> DataFrame:
    """Up to per_category anchors of each error, chosen by hash."""
    w = Window.partitionBy("category").orderBy(F.xxhash64("i"), "i")
    return rows.filter("category <> 'correct'").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= per_category).drop("rk")


def error_dump(examples: DataFrame, scored: DataFrame, selected: DataFrame, truth: DataFrame, least: float = 0.2) -> DataFrame:
    """(category, i, kind, j, p, is_true, selected) of the example anchors: their candidates ('cand') that are true, selected or above
    `least`, and their true targets that are no candidates ('MISSED_TRUE', without p)."""
    mine = F.broadcast(examples.select("i", "category"))  # per_category rows a category
    t = truth.select("i", "j", F.lit(1).alias("is_true")).distinct()
    s = selected.select("i", "j", F.lit(1).alias("selected")).distinct()
    cands = scored.select("i", "j", "p").join(mine, "i").join(t, ["i", "j"], "left").join(s, ["i", "j"], "left").na.fill(0, ["is_true", "selected"])
    cands = cands.filter((F.col("is_true") == 1) | (F.col("selected") == 1) | (F.col("p") > least)).select("category", "i", F.lit("cand").alias("kind"), "j", "p", "is_true", "selected")
    missed = t.join(mine, "i").join(scored.select("i", "j"), ["i", "j"], "left_anti")
    return cands.unionByName(missed.select("category", "i", F.lit("MISSED_TRUE").alias("kind"), "j", F.lit(None).cast("double").alias("p"), "is_true", F.lit(0).alias("selected")))


def matched(truth: DataFrame) -> DataFrame:
    """How many links, distinct anchors and distinct targets there are."""
    return truth.agg(F.count("*").alias("links"), F.countDistinct("i").alias("anchors"), F.countDistinct("j").alias("targets"))


def kept_quantile(scores: DataFrame, score: str, keep: float) -> DataFrame:
    """One row: the score at ascending position floor((1 - keep) * n), no interpolation. Scores are from 0 to 1. Three rounds narrow the
    place down to one of 1,024 bins each, by grouped counts; the last groups equal scores of a bin some 1e-9 wide."""
    spark, low, width, skip = scores.sparkSession, 0.0, 1.0, 0
    column = scores.select(F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0)).alias("v")).filter("v IS NOT NULL")
    n = column.count()
    at = int((1.0 - keep) * n + 1e-9) + 1
    if not n or at > n:
        return spark.createDataFrame([(None,)], "threshold double")
    for _ in range(3):
        bin_ = F.least(F.floor((F.col("v") - F.lit(low)) * F.lit(1024.0 / width)), F.lit(1023))
        counts = sorted((r["b"], r["n"]) for r in column.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect())
        for b, c in counts:
            if skip + c >= at:
                break
            skip += c
        column = column.filter(bin_ == b)
        low, width = low + b * width / 1024, width / 1024
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return column.groupBy("v").agg(F.count("*").alias("n")).withColumn("upto", upto).filter(F.col("upto") >= at - skip).agg(F.min("v").alias("threshold"))


def validate(lists: DataFrame, anchors: DataFrame, targets: DataFrame, key: str = "source1_entity_id", items: str = "matched_entity_ids") -> DataFrame:
    """(rule, offenders): duplicate rows, duplicates in a list, anchor ids in a list, ids with a wrong prefix, unknown ids, missing and
    extra rows. Zero offenders everywhere means a valid table."""
    ids = F.filter(F.transform(F.split(items, ","), lambda x: F.trim(x)), lambda x: x != "")
    each = lists.select(F.col(key).alias("i"), ids.alias("ids")).select("i", "ids", F.explode("ids").alias("j"))
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("offenders"))
    known = targets.select(F.col("j"))
    parts = [
        count(lists.groupBy(key).count().filter("count > 1"), "duplicate_row"),
        count(lists.filter(F.size(ids) > F.size(F.array_distinct(ids))), "duplicate_id"),
        count(each.filter(F.col("j").startswith("S1-")), "anchor_in_list"),
        count(each.filter(~F.col("j").rlike("^S[123]-")), "wrong_prefix"),
        count(each.join(known, "j", "left_anti"), "unknown_id"),
        count(anchors.select("i").join(lists.select(F.col(key).alias("i")), "i", "left_anti"), "missing_row"),
        count(lists.select(F.col(key).alias("i")).join(anchors.select("i"), "i", "left_anti"), "extra_row"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
