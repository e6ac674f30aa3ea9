"""The whole linkage: candidates, second hop, context, pruner, three stacked stages, calibration, decision, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.functions import text as T
from kinlake.operators import context, decide, features, kernel, learn, metrics, models, vectors
from kinlake.plans import candidates as plan
from kinlake.sources.scratch import materialise

_COMPETITION = ["other", "rank", "sumo", "n", "margin"]
_GROUP = ["rk", "gap", "total", "n_half", "g_other", "g_n", "rk_src", "n_src"]
_BASE = ["cc", "cm", "ca", "nat1", "nat2", "rev_rk_cm", "rev_gap_cm", "fwd", "n_jw", "n_tset", "a_tset", "n_idf_min", "a_wcont", "a_widf"]


def complete(records: DataFrame) -> DataFrame:
    """`records` with what the plan reads: full (the name, by default), nat and dom (0)."""
    for c, value in (("full", F.col("name")), ("nat", F.lit(0.0)), ("dom", F.lit(0))):
        if c not in records.columns:
            records = records.withColumn(c, value)
    return records.select("id", "src", "country", "name", "full", "addr", "nat", "dom")


def with_maps(records: DataFrame, truth: DataFrame, least: int) -> DataFrame:
    """`records` with name_map and addr_map: words made one that stand for each other in linked pairs."""
    out = records
    for column in ("name", "addr"):
        words = lambda key, k: records.select(F.col("id").alias(key), F.array_distinct(T.words(F.col(column))).alias(k))  # noqa: B023, E731
        linked = truth.select("i", "j").join(words("i", "a"), "i").join(words("j", "b"), "j")
        out = kernel.rewrite(out, column, learn.equivalences(linked, least), f"{column}_map")
    return out


def score(records: DataFrame, truth: DataFrame, c: plan.Config = plan.DEFAULT, report: dict | None = None, folder: str | None = None) -> DataFrame:
    """Pairs with p, the calibrated probability of being linked. Stages see each other's scores of other anchors' models only, and competition
    sees every claim, as no anchor is left out before. Calibration is fitted on the anchors of fold 0 of 7. `report` and `folder` get the
    models' facts and the models, see models.cross_fit."""
    records = materialise(complete(records), "records")
    pairs = plan.expanded(records, c)
    pairs = context.reverse_context(context.context(pairs))
    about = lambda key, k: records.select(F.col("id").alias(key), F.col("country").alias(f"c{k}"), F.col("nat").alias(f"nat{k}"), F.col("dom").alias(f"dom{k}"))
    pairs = pairs.join(about("i", 1), "i").join(about("j", 2), "j").withColumn("same_cty", (F.col("c1") == F.col("c2")).cast("int")).drop("c1", "c2")
    labels = truth.select("i", "j", F.lit(1).alias("y")).distinct()
    pairs = materialise(pairs.join(labels, ["i", "j"], "left").na.fill(0, ["y"]), "pairs")

    cheap = [x for x in pairs.columns if x not in ("i", "j", "p", "y")]
    pruned = models.cross_fit(pairs, "y", cheap, "p0", 2, 3, 5, c.seed, report, folder)
    pruned = materialise(pruned.drop("p"), "pruner")
    threshold = metrics.kept_quantile(pruned.filter("y = 1"), "p0", c.prune_keep).first()["threshold"] or 0.0
    kept = decide.prune(pruned.withColumnRenamed("p0", "p"), threshold, c.prune_max)
    kept = pruned.join(kept.select("i", "j"), ["i", "j"], "left_semi")

    mapped = materialise(with_maps(records, truth, c.map_min_count), "mapped")
    idf = [materialise(vectors.idf_weights(records.withColumn("t", T.words(F.col(x))), "t"), f"{x}-idf") for x in ("name", "addr")]
    heavy = materialise(kernel.with_weights(records, *idf), "weighted")
    rich = kernel.set_features(kernel.gather(kept, heavy, *kernel.WEIGHTS))
    rich = kernel.mapped_features(kernel.string_features(rich), mapped)
    rich = materialise(rich.select(*kept.columns, *kernel.SETS, *kernel.MAPPED, *kernel.STRINGS), "features")
    first = [x for x in rich.columns if x not in ("i", "j", "y", "p0")]
    one = materialise(models.cross_fit(rich, "y", first, "p1", c.folds, seed=c.seed, report=report, folder=folder), "stage-1")

    def claims(df: DataFrame, p: str) -> DataFrame:
        got = context.competition(df.select("i", "j", F.col(p).alias("p"))).drop("p")
        group = context.group_stats(df.select("i", "j", "src", F.col(p).alias("p"))).withColumnRenamed("other", "g_other").withColumnRenamed("n", "g_n")
        out = df.join(got, ["i", "j"]).join(group, ["i", "j"]).withColumn("lg", decide.logit(F.col(p)))
        near = features.reference_coherence(df.select("i", "j", F.col(p).alias("p")), records)
        return out.join(near.drop("ref"), ["i", "j"])

    extra = [*_COMPETITION, *_GROUP, "lg", "p_ref", "ref_sim", "ref_ratio", "ref_addr"]
    two = claims(one, "p1")
    second = ["p1", *extra, *_BASE]
    two = materialise(models.cross_fit(two, "y", second, "p2", c.folds, seed=c.seed + 1, report=report, folder=folder).drop(*extra), "stage-2")
    coherent = features.set_coherence(two.select("i", "j", F.col("p2").alias("p")), records).withColumnsRenamed({x: f"s_{x}" for x in ("name", "addr", "num", "both")})
    three = claims(two, "p2").join(coherent, ["i", "j"])
    third = ["p1", "p2", *extra, *_BASE, "n_conf", "s_name", "s_addr", "s_num", "s_both", "p_conf"]
    three = materialise(models.cross_fit(three, "y", third, "p3", c.folds, seed=c.seed + 2, report=report, folder=folder), "stage-3")
    return models.calibrate(three, "p3", "y", "p", models.fold("i", 7, c.seed) == 0).select("i", "j", "src", "y", "p0", "p1", "p2", "p3", "p")


def choose(scored: DataFrame, truth: DataFrame, anchors: DataFrame, seed: int = 42) -> tuple[DataFrame, dict]:
    """The pairs chosen by the best variant on the anchors of folds 1 to 6 of 7, and its facts."""
    held = anchors.filter(models.fold("i", 7, seed) != 0).select("i")
    mine = scored.select("i", "j", "p").join(held, "i", "left_semi")
    best = decide.best_variant(decide.variant_search(mine, truth.join(held, "i", "left_semi"), held)).first()
    facts = {"exclusive": 0, "gamma": 1.0, "macro_f05": 0.0} if best is None else best.asDict()
    pairs = context.exclusivity(scored.select("i", "j", "p")) if facts["exclusive"] else scored.select("i", "j", "p")
    return decide.expected_f05_exact(pairs.withColumn("p", F.pow("p", F.lit(float(facts["gamma"]))))), facts


def link(records: DataFrame, truth: DataFrame, c: plan.Config = plan.DEFAULT, report: dict | None = None, folder: str | None = None) -> DataFrame:
    """(i, matched_entity_ids) of every anchor. `report` gets the models' facts, the variant and the recall of the candidates."""
    scored = materialise(score(records, truth, c, report, folder), "scored")
    anchors = records.filter("src = 0").select(F.col("id").alias("i"))
    chosen, facts = choose(scored, truth, anchors, c.seed)
    if report is not None:
        report |= facts | metrics.recall(scored, truth).first().asDict()
    return decide.result_lists(chosen, anchors)


