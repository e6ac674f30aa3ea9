"""From scored pairs to sets of matches: thresholds, top-K picks, expected-F0.5 selection, result lists."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def result_lists(pairs: DataFrame, anchors: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per anchor: its ids, sorted and comma-joined; an empty string without any."""
    lists = pairs.groupBy("i").agg(F.array_join(F.array_sort(F.collect_set(F.col("j").cast("string"))), ",").alias(column))
    return anchors.select("i").join(lists, "i", "left").na.fill("", [column])


def limit_list(lists: DataFrame, column: str, k: int) -> DataFrame:
    """The first k ids of each comma list, in their order."""
    return lists.withColumn(column, F.array_join(F.slice(F.split(column, ","), 1, k), ","))


def threshold_top_k(pairs: DataFrame, thresholds: Mapping[str, float], default: float, k: int) -> DataFrame:
    """Pairs (i, j, country, score) at their country's threshold or above, the k best of each anchor."""
    t = F.coalesce(*[F.when(F.col("country") == c, F.lit(v)) for c, v in thresholds.items()], F.lit(default))
    w = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return pairs.filter(F.col("score") >= t).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select("i", "j", "score")


def per_source_top_k(pairs: DataFrame, per_source: int = 3, total: int = 5) -> DataFrame:
    """The best per_source of each source with a positive score, first source first, cut to `total`."""
    w = Window.partitionBy("i", "src").orderBy(F.desc("score"), "j")
    top = pairs.filter("score > 0").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= per_source)
    place = Window.partitionBy("i").orderBy("src", "rk")
    return top.withColumn("place", F.row_number().over(place).cast("bigint")).filter(F.col("place") <= total).select("i", "j", "place")


def expected_f05_ratio(pairs: DataFrame, keys: tuple[str, ...] = ("i",)) -> DataFrame:
    """(i, j): each anchor's prefix, by p, with the greatest ratio of expectations 1.25 S_k / (k + 0.25 S), where S_k sums the
    prefix and S all; none if that is below the chance that nothing is true. `keys` may hold more columns than i."""
    w = Window.partitionBy(*keys).orderBy(F.desc("p"), "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    i = Window.partitionBy(*keys)
    p = F.least(F.col("p"), F.lit(1.0))
    s = pairs.filter("p >= 0.02").select(*keys, "j", "p", F.count("*").over(w).alias("k"), F.sum(p).over(w).alias("sk"), F.sum(p).over(i).alias("s"), F.sum(F.log(F.greatest(1.0 - p, F.lit(1e-12)))).over(i).alias("none"))
    s = s.withColumn("f", F.round(1.25 * F.col("sk") / (F.col("k") + 0.25 * F.col("s")), 9))
    s = s.withColumn("best", F.max("f").over(i)).withColumn("cut", F.min(F.when(F.col("f") == F.col("best"), F.col("k"))).over(i))
    return s.filter((F.col("k") <= F.col("cut")) & (F.col("best") > F.exp("none"))).select(*keys, "j")


def variants(pairs: DataFrame, gammas: tuple[float, ...] = (0.85, 1.0, 1.2, 1.5)) -> DataFrame:
    """(exclusive, gamma, i, j, p): the pairs in every variant of a decision, p ** gamma with and without exclusivity, from one pass
    over their windows."""
    from kinlake.operators import context

    both = pairs.select("i", "j", "p").join(context.exclusivity(pairs).withColumnRenamed("p", "pe"), ["i", "j"])
    grid = F.array(*[F.struct(F.lit(e).alias("exclusive"), F.lit(float(g)).alias("gamma")) for e in (0, 1) for g in gammas])
    each = both.select("i", "j", "p", "pe", F.explode(grid).alias("v")).select("v.*", "i", "j", F.pow(F.when(F.col("v.exclusive") == 1, F.col("pe")).otherwise(F.col("p")), F.col("v.gamma")).alias("p"))
    return each


def variant_search(pairs: DataFrame, truth: DataFrame, anchors: DataFrame, gammas: tuple[float, ...] = (0.85, 1.0, 1.2, 1.5)) -> DataFrame:
    """(exclusive, gamma, macro_f05) of every variant's choice by the ratio of expectations; the greatest one, first in the order of
    (exclusive, gamma), is the one to take (`best_variant`)."""
    from kinlake.operators import metrics

    chosen = expected_f05_ratio(variants(pairs, gammas), ("exclusive", "gamma", "i"))
    t = truth.select("i", "j", F.lit(1).alias("y")).distinct()
    counts = chosen.join(t, ["i", "j"], "left").groupBy("exclusive", "gamma", "i").agg(F.count("*").alias("n_pred"), F.count("y").alias("tp"))
    grid = F.array(*[F.struct(F.lit(e).alias("exclusive"), F.lit(float(g)).alias("gamma")) for e in (0, 1) for g in gammas])
    every = anchors.select("i", F.explode(grid).alias("v")).select("i", "v.*").join(t.groupBy("i").agg(F.count("*").alias("n_true")), "i", "left")
    out = every.join(counts, ["exclusive", "gamma", "i"], "left").na.fill(0, ["n_pred", "tp", "n_true"])
    return out.groupBy("exclusive", "gamma").agg(F.round(F.avg(metrics.f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("macro_f05"))


def best_variant(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("macro_f05"), "exclusive", "gamma").limit(1)


def expected_f05_drawn(pairs: DataFrame, alpha: float = 1.0, draws: int = 400, seed: int = 42, floor: float = 0.02, least: float = 0.005) -> DataFrame:
    """(i, j): each anchor's best prefix by the mean F0.5 over `draws` outcomes of p ** alpha. The uniform draws are one table, the same for
    every anchor, so that the result depends on nothing but the anchor's own probabilities."""
    rows = pairs.filter(F.col("p") >= least).groupBy("i").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("m"), "j"))).alias("c"))
    rows = rows.select("i", F.col("c.j").alias("j"), F.transform("c", lambda x: -x["m"]).alias("p"))

    def take(p: np.ndarray, u: np.ndarray) -> int:
        y = u[:, : len(p)] < p**alpha
        total, tp, k = y.sum(1, keepdims=True), np.cumsum(y, 1), np.arange(1, len(p) + 1)
        f = np.where(tp > 0, 1.25 * tp / np.maximum(1.25 * tp + 0.25 * (total - tp) + (k - tp), 1e-12), 0.0).mean(0)
        best = int(np.argmax(f))
        return best + 1 if f[best] > (total == 0).mean() else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = np.empty((draws, 0))
        for pdf in batches:
            while u.shape[1] < max(map(len, pdf["p"]), default=0):  # column k is the same however many there are
                u = np.hstack([u, np.random.default_rng([seed, u.shape[1]]).random((draws, 1))])
            n = [0 if p[0] < floor else take(np.asarray(p), u) for p in pdf["p"]]
            yield pd.DataFrame({"i": pdf["i"], "j": [list(j[:k]) for j, k in zip(pdf["j"], n, strict=True)]})

    return rows.mapInPandas(run, "i bigint, j array<bigint>").select("i", F.explode("j").alias("j"))


def _binomial(p: np.ndarray) -> np.ndarray:
    """Distribution of the number of successes of independent trials."""
    d = np.ones(1)
    for x in p:
        d = np.convolve(d, [1 - x, x])
    return d


def best_prefix(p: np.ndarray) -> int:
    """How many of the descending probabilities to take for the greatest expected F0.5, exactly; 0 if an empty answer is better."""
    p = np.clip(p, 0.0, 1.0)
    best, at = float(np.prod(1 - p)), 0
    for k in range(1, len(p) + 1):
        t, u = _binomial(p[:k]), _binomial(p[k:])
        tt, uu = np.arange(len(t))[:, None], np.arange(len(u))[None, :]
        f = 1.25 * tt / (1.25 * tt + 0.25 * uu + (k - tt))
        e = float((t[:, None] * u[None, :] * f).sum())
        if e > best + 1e-12:
            best, at = e, k
    return at


def expected_f05_exact(pairs: DataFrame, floor: float = 0.02, top: float = 0.15) -> DataFrame:
    """(i, j): each anchor's best prefix. An anchor's candidates are few after pruning; each group is one small array in a row, so
    batches hold many anchors."""
    rows = pairs.filter(F.col("p") >= floor).groupBy("i").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("m"), "j"))).alias("c"))
    rows = rows.select("i", F.col("c.j").alias("j"), F.transform("c", lambda x: -x["m"]).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [0 if p[0] < top else (int(p[0] > 0.5) if len(p) == 1 else best_prefix(np.asarray(p))) for p in pdf["p"]]
            yield pd.DataFrame({"i": pdf["i"], "j": [list(j[:k]) for j, k in zip(pdf["j"], n, strict=True)]})

    return rows.mapInPandas(run, "i bigint, j array<bigint>").select("i", F.explode("j").alias("j"))


def weighted_score(name: Column, addr: Column, contain: Column, same_country: Column, length: Column) -> Column:
    """Linear blend of set features; what fuzzy ratios weigh elsewhere goes to the name."""
    return 0.55 * name + 0.30 * addr + 0.10 * contain + 0.03 * same_country + 0.02 * length


def prune(pairs: DataFrame, threshold: float, k: int = 15) -> DataFrame:
    """Pairs with p >= threshold among the k best of each anchor."""
    w = Window.partitionBy("i").orderBy(F.desc("p"), "j")
    return pairs.withColumn("rk", F.row_number().over(w)).filter((F.col("p") >= threshold) & (F.col("rk") <= k)).select("i", "j", "p")


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))
