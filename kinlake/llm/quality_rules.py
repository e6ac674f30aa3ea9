"""Quality rules with thresholds learnt per language and source.

Each measure's distribution is kept as a DDSketch (Masson, Rim, Lee 2019): counts of logarithmic buckets, with
a relative error of `ALPHA`. Sketches are plain grouped counts, so they merge by addition, in any order, with
the same result: documents into (language, source), these into languages, these into one. Each level's sketch is
then merged with its parent's, scaled to the weight of `PRIOR` documents: a group of any size has fences of its own,
which go from its language's to its own documents' as it grows. A fence is an upper quantile of the group, or lies
`reach` interquartile ranges beyond the quartile if that is farther: a measure that most documents don't show at
all has no spread, and its quantile decides. Verdicts join the fences back to the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlake.llm.common import documents, materialise
from kinlake.llm.textstats import text_stats, with_text_stats

ALPHA = 0.002
#: Documents that a parent's sketch counts as in its children's.
PRIOR = 100.0
#: Measure -> (upper quantile, reach, whether low values are rejected too, below the lower quartile by the same reach).
MEASURES = {"symbols_per_word": (0.95, 3.0, False), "dup_line_share": (0.995, 3.0, False), "repeat_word_share": (0.995, 3.0, False), "mean_word_length": (0.75, 2.0, True)}
#: Groups whose fences are broadcast; beyond, the engine joins by shuffle and splits skewed keys.
BROADCAST_GROUPS = 100_000

_GAMMA = (1 + ALPHA) / (1 - ALPHA)
_TINY = 1e-6


def measures(prefix: str = "") -> dict[str, Column]:
    """The measures, from the text statistics in columns named with `prefix`."""
    n = lambda c: F.col(f"{prefix}{c}")
    share = lambda a, b: F.when(n(b) > 0, n(a) / n(b).cast("double")).otherwise(0.0)
    return {
        "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"), "mean_word_length": share("word_chars", "n_words"),
    }


def bucket(x: Column) -> Column:
    """The DDSketch bucket of a value of at least 0; all below 1e-6 share the bucket -2^31."""
    return F.when(x < _TINY, F.lit(-(1 << 31))).otherwise(F.ceil(F.log(F.greatest(x, F.lit(_TINY))) / math.log(_GAMMA)).cast("int"))


def value(b: Column) -> Column:
    return F.when(b == -(1 << 31), 0.0).otherwise(2.0 * F.pow(F.lit(_GAMMA), b.cast("double")) / (_GAMMA + 1.0))


def sketches(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket, count: the groups' mergeable sketches."""
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(c).alias("bucket")) for m, c in measures().items()])
    return stats.select(*keys, F.inline(rows)).groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("count"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: sums of counts."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("count").alias("count"))


def shrunk(sketch: DataFrame, keys: list[str], parent: DataFrame, on: list[str], prior: float = PRIOR) -> DataFrame:
    """The sketches of groups `keys` with their parents' added, each scaled to `prior` documents; null keys are groups too."""
    total = Window.partitionBy(*on, "measure")
    scaled = parent.withColumn("count", F.col("count") * F.lit(prior) / F.sum("count").over(total))
    groups = sketch.select(*keys).distinct()
    renamed = scaled.select(*[F.col(c).alias(f"_{c}") for c in on], "measure", "bucket", "count")
    same = [groups[c].eqNullSafe(renamed[f"_{c}"]) for c in on]
    every = groups.join(renamed, same, "inner") if same else groups.crossJoin(renamed)  # all groups have the one parent
    own = sketch.select(*keys, "measure", "bucket", F.col("count").cast("double").alias("count"))
    return merge(own.unionByName(every.select(*keys, "measure", "bucket", "count")), keys)


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: high_<measure>, and low_<measure>. A window holds one group's buckets: some 4,000 at most, however
    many documents."""
    w = Window.partitionBy(*keys, "measure").orderBy("bucket")
    total = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sketch.withColumn("_upto", upto).withColumn("_total", total)
    of = lambda i: F.coalesce(*[F.when(F.col("measure") == m, F.lit(v[i])) for m, v in MEASURES.items()])
    at = lambda q: value(F.min(F.when(F.col("_upto") >= q * F.col("_total"), F.col("bucket"))))
    q = ranked.groupBy(*keys, "measure").agg(at(F.lit(0.25)).alias("q25"), at(F.lit(0.75)).alias("q75"), at(of(0)).alias("upper"))
    spread = of(1) * (F.col("q75") - F.col("q25"))
    rows = q.select(*keys, "measure", (F.col("q25") - spread).alias("low"), F.greatest("upper", F.col("q75") + spread).alias("high"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}")
    return rows.groupBy(*keys).agg(*[pick(m, s) for m, (_, _, low) in MEASURES.items() for s in (("low", "high") if low else ("high",))])


def base_failed(prefix: str = "") -> Column:
    """Too few words, or too many in repeated 5-word windows: these go whatever the group."""
    words = F.col(f"{prefix}n_words")
    return (words < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * words)


def beyond(prefix: str = "") -> Column:
    """The names of the fences (high_<measure>, low_<measure>) that a row lies beyond; null fences are none. A sketch knows values to
    ALPHA of themselves: beyond a fence is what lies in a bucket beyond it."""
    seen = {m: value(bucket(c)) for m, c in measures(prefix).items()}
    named = [F.when(x > F.col(f"high_{m}"), F.lit(f"high_{m}")) for m, x in seen.items()]
    named += [F.when(seen[m] < F.col(f"low_{m}"), F.lit(f"low_{m}")) for m, (_, _, low) in MEASURES.items() if low]
    return F.array_compact(F.array(*named))


def fenced(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` with the fences of their lang and source, nulls where a group has none."""
    few = limits.count() <= BROADCAST_GROUPS
    limits = limits.withColumnRenamed("lang", "_fence_lang").withColumnRenamed("source", "_fence_source")
    return rows.join(F.broadcast(limits) if few else limits, rows["lang"].eqNullSafe(limits["_fence_lang"]) & rows["source"].eqNullSafe(limits["_fence_source"]), "left")


def thresholds(stats: DataFrame, prior: float = PRIOR) -> DataFrame:
    """lang, source and the fences of every such group in `stats`, learnt from its documents that are not `base_failed`; a
    group without any has none. Null languages and sources are groups like any other."""
    fine = materialise(sketches(stats.filter(~base_failed()), ["lang", "source"]), "sketches")
    langs = merge(fine, ["lang"])
    langs = materialise(shrunk(langs, ["lang"], merge(langs, []), [], prior), "language-sketches")
    return fences(shrunk(fine, ["lang", "source"], langs, ["lang"], prior), ["lang", "source"])


def judge(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, and `failed`, the names of the fences that a row lies beyond.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept: not base_failed and
    inside every fence of its (lang, source). Each row comes back once, repeated rows too, with equal verdicts; null and
    empty texts have no words and fail; an empty table gives no rows; other columns are not read.
    """
    stats = materialise(text_stats(docs, "lang", "source"), "text-stats")
    limits = materialise(thresholds(stats, prior), "thresholds")
    return fenced(stats, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.size(beyond()) == 0)).alias("kept"), beyond().alias("failed"),
    )


def keep(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all its columns. The fences are learnt in a first pass over the texts and applied in a
    second one, row by row: texts are neither shuffled nor joined to verdicts."""
    limits = materialise(thresholds(materialise(text_stats(docs, "lang", "source"), "text-stats"), prior), "thresholds")
    stats = "_stat_"
    names = [c for c in limits.columns if c not in ("lang", "source")]
    taken = {c: f"_input_{c}" for c in docs.columns if c in names}
    rows = fenced(with_text_stats(docs.withColumnsRenamed(taken), stats), limits)
    kept = rows.filter(~base_failed(stats) & (F.size(beyond(stats)) == 0))
    return kept.select(*[F.col(taken.get(c, c)).alias(c) for c in docs.columns])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict; see `judge`."""
    return judge(documents(spark, sf_dir)).withColumn("failed", F.concat_ws(",", "failed"))
