"""TF-IDF postings in long form: one row per record, channel and feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def postings(records: DataFrame, features: str, max_df: float, cap_floor: int = 50, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """(country, id, src, feature, w): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each record's vector of unit length.

    n and df count a country's records of all sources. Features with df < 2 or df > max(cap_floor, max_df * n) are dropped
    before any join, which bounds the work that frequent features make.
    """
    keys = list(keys)
    tf = records.select(*keys, "id", "src", F.explode(features).alias("feature")).groupBy(*keys, "id", "src", "feature").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*keys, "feature").agg(F.count("*").alias("df")).filter("df >= 2")
    n = records.groupBy(*keys).agg(F.count("*").alias("n"))
    idf = df.join(F.broadcast(n), keys).filter(F.col("df") <= F.greatest(F.lit(float(cap_floor)), F.lit(max_df) * F.col("n")))
    idf = idf.select(*keys, "feature", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = tf.join(idf, [*keys, "feature"]).select(*keys, "id", "src", "feature", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "id")))
    return raw.select(*keys, "id", "src", "feature", (F.col("w") / norm).alias("w"))


def idf_weights(records: DataFrame, tokens: str) -> DataFrame:
    """(token, df, idf = ln(n / df)) over records' distinct tokens."""
    n = records.agg(F.count("*").alias("n"))
    df = records.select("id", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def cosine(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """(i, j, src, score) of every pair that shares a feature: an equi-join on the feature and a sum with map-side partials."""
    a = left.select(*keys, F.col("id").alias("i"), "feature", F.col("w").alias("wa"))
    b = right.select(*keys, F.col("id").alias("j"), F.col("src"), "feature", F.col("w").alias("wb"))
    return a.join(b, [*keys, "feature"]).groupBy("i", "j", "src").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("score"))


def country_groups(records: DataFrame) -> DataFrame:
    """Records with the group that they are compared in as `country`: their own, and for targets without one, every country that anchors
    have. Anchors without a country are a group with the targets without one."""
    known = records.filter("src = 0").select("country").distinct().agg(F.collect_set("country").alias("_all"))  # countries are few
    blank = records.filter("src > 0 AND country = ''").crossJoin(F.broadcast(known)).withColumn("country", F.explode("_all")).drop("_all")
    return records.filter("NOT (src > 0 AND country = '')").unionByName(blank)


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, out: str) -> DataFrame:
    """`pairs` (i, j) with their cosine as `out`, 0 without a shared feature: the features of the pairs' records only meet pair by pair."""
    a = left.select(F.col("id").alias("i"), "country", "feature", F.col("w").alias("wa"))
    b = right.select(F.col("id").alias("j"), "country", "feature", F.col("w").alias("wb"))
    found = pairs.select("i", "j").join(a, "i").join(b, ["j", "country", "feature"]).groupBy("i", "j", "country").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    found = found.groupBy("i", "j").agg(F.round(F.max("s"), 6).alias(out))
    return pairs.join(found, ["i", "j"], "left").na.fill(0.0, [out])


def combined(name_scores: DataFrame, addr_scores: DataFrame, name_posts: DataFrame, addr_posts: DataFrame, weight: float = 0.8) -> DataFrame:
    """Scores in the joint space of [name, weight * addr] from the two channels: (c_n + weight^2 c_a) / (z_i z_j), where
    z^2 = [name vector not empty] + weight^2 [address vector not empty]. No third index is needed."""
    has = lambda p, c: p.select("id").distinct().withColumn(c, F.lit(1.0))
    z = has(name_posts, "hn").join(has(addr_posts, "ha"), "id", "full").na.fill(0.0)
    z = z.select("id", F.sqrt(F.col("hn") + weight * weight * F.col("ha")).alias("z"))
    both = name_scores.withColumnRenamed("score", "cn").join(addr_scores.withColumnRenamed("score", "ca"), ["i", "j", "src"], "full").na.fill(0.0, ["cn", "ca"])
    zi, zj = z.select(F.col("id").alias("i"), F.col("z").alias("zi")), z.select(F.col("id").alias("j"), F.col("z").alias("zj"))
    return both.join(zi, "i").join(zj, "j").select("i", "j", "src", F.round((F.col("cn") + weight * weight * F.col("ca")) / (F.col("zi") * F.col("zj")), 6).alias("score"))
