"""Dictionaries mined from linked pairs: transliterations, vocabulary, word equivalences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mine_transliterations(pairs: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """(token, plain, n): pairs (native, latin) of equally many words are aligned by position; a native word's most frequent partner
    stays if seen `least` times and in `share` of its places."""
    a, b = F.split("native", " "), F.split("latin", " ")
    same = pairs.filter(F.col("native").rlike("[^\\x00-\\x7F]") & ~F.col("latin").rlike("[^\\x00-\\x7F]") & (F.size(a) == F.size(b)))
    aligned = same.select(F.explode(F.arrays_zip(a.alias("t"), b.alias("p"))).alias("z")).select(F.col("z.t").alias("token"), F.col("z.p").alias("plain"))
    n = aligned.groupBy("token", "plain").agg(F.count("*").alias("n"))
    w = Window.partitionBy("token")
    best = n.withColumn("all", F.sum("n").over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.desc("n"), "plain")))
    return best.filter((F.col("rk") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select("token", "plain", "n")


def vocabulary(tokens: DataFrame, least: int = 20, length: int = 3) -> DataFrame:
    """(token, log_n) of words of `length` letters or more, no numbers, seen `least` times."""
    n = tokens.filter((F.length("token") >= length) & ~F.col("token").rlike("^[0-9]+$")).groupBy("token").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= least).select("token", F.round(F.log("n"), 6).alias("log_n"))


def alike(u: Column, v: Column) -> Column:
    """Whether one word may stand for the other by its letters: few edits, or the shorter an abbreviation, its letters in order in the
    longer after the same first one."""
    short, long = F.when(F.length(u) <= F.length(v), u).otherwise(v), F.when(F.length(u) <= F.length(v), v).otherwise(u)
    within = F.regexp_replace(short, "(.)", "$1.*")
    near = F.levenshtein(u, v) <= 0.3 * F.greatest(F.length(u), F.length(v))
    return near | ((F.length(short) >= 2) & (F.substring(short, 1, 1) == F.substring(long, 1, 1)) & F.regexp_like(long, F.concat(F.lit("^"), within, F.lit("$"))))


def substitutions(pairs: DataFrame, filtered: bool = False) -> DataFrame:
    """(u, v, n): unordered words that stand for each other in pairs (a, b: arrays of words) whose sets differ by one word on each side;
    `filtered` keeps those that are `alike`."""
    x, y = F.array_except("a", "b"), F.array_except("b", "a")
    one = pairs.select(x.alias("x"), y.alias("y")).filter("size(x) = 1 AND size(y) = 1").select(F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"))
    one = one.filter(~F.col("x").rlike("^[0-9]+$") & ~F.col("y").rlike("^[0-9]+$"))
    one = one.filter(alike(F.col("x"), F.col("y"))) if filtered else one
    return one.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).groupBy("u", "v").agg(F.count("*").alias("n"))


def equivalences(pairs: DataFrame, least: int = 15, most: int = 8, limit: int = 100_000) -> DataFrame:
    """(token, plain): words of pairs (a, b) and the representative of their cluster. Substitutions seen `least` times go to the driver; more
    than `limit` of them raise an error, as such a `least` is too small for the data."""
    found = substitutions(pairs, True).filter(F.col("n") >= least).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} substitutions seen {least} times: raise `least`")
    table = clusters([(r["u"], r["v"], r["n"]) for r in found], least, most)
    return pairs.sparkSession.createDataFrame(sorted(table.items()), "token string, plain string")


def clusters(counted: Iterable[tuple[str, str, int]], least: int = 15, most: int = 8) -> dict[str, str]:
    """word -> representative (the cluster's smallest word): union-find over substitutions in descending count, while count >= least and
    the merged cluster has at most `most` words. The input is the bounded list of frequent substitutions."""
    parent: dict[str, str] = {}
    size: dict[str, int] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        size.setdefault(x, 1)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v, n in sorted(counted, key=lambda r: (-r[2], r[0], r[1])):
        a, b = find(u), find(v)
        if n >= least and a != b and size[a] + size[b] <= most:
            lo, hi = min(a, b), max(a, b)
            parent[hi], size[lo] = lo, size[a] + size[b]
    return {x: find(x) for x in parent if find(x) != x}
