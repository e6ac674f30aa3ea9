"""Weighted linear scorers of gathered pairs (name, addr, country of both; see kernel.gather)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.functions import fuzzy
from kinlake.functions import text as T
from kinlake.operators.kernel import containment, jaccard, spread

#: Weights of the set scorer: names' and addresses' Jaccard, names' similarity, containment, country, length.
SET_WEIGHTS = {"name_jaccard": 0.40, "addr_jaccard": 0.30, "name_sim": 0.15, "containment": 0.10, "country_match": 0.03, "length_ratio": 0.02}


def _words(column: str, k: int) -> Column:
    return F.array_distinct(T.words(F.col(f"{column}{k}")))


def _same(column: str, known: bool = True) -> Column:
    same = F.col(f"{column}1") == F.col(f"{column}2")
    return F.coalesce((same & (F.col(f"{column}1") != "")) if known else same, F.lit(False)).cast("double")


def ratios(pairs: DataFrame, column: str, prefix: str) -> DataFrame:
    """Add <prefix>_ratio, _partial and _tsort of a column's two strings, from 0 to 1; 0 where one is empty."""
    fs = (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio)
    names = [f"{prefix}_ratio", f"{prefix}_partial", f"{prefix}_tsort"]

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[f(x, y) / 100 if x and y else 0.0 for f in fs] for x, y in zip(a, b, strict=True)], columns=names, dtype="float64")

    made = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))
    return spread(pairs).withColumn("_r", made(f"{column}1", f"{column}2")).select("*", "_r.*").drop("_r")


def set_score(pairs: DataFrame) -> DataFrame:
    """(i, j, score) by SET_WEIGHTS; the names' similarity is 1 less the edit distance over the longer name."""
    t, u = [_words("name", k) for k in (1, 2)], [_words("addr", k) for k in (1, 2)]
    l1, l2 = F.length("name1"), F.length("name2")
    whole = F.greatest(l1, l2)
    value = {
        "name_jaccard": jaccard(*t), "addr_jaccard": jaccard(*u), "name_sim": F.when(whole > 0, 1.0 - F.levenshtein("name1", "name2") / F.greatest(whole, F.lit(1))).otherwise(0.0),
        "containment": containment(*t), "country_match": _same("country"), "length_ratio": F.when(whole > 0, F.least(l1, l2) / F.greatest(whole, F.lit(1))).otherwise(0.0),
    }
    return pairs.select("i", "j", sum(w * value[k] for k, w in SET_WEIGHTS.items()).alias("score"))


def name_score(pairs: DataFrame) -> DataFrame:
    """(i, j, score) by names and country: 0.2 Jaccard, 0.1 of the anchor's words contained, 0.25 ratio, 0.2 partial, 0.1 sorted ratio, 0.1 for
    the country and 0.1 more with a text score of 0.3 or more. Pairs with an empty name have no score."""
    p = ratios(pairs.filter("name1 <> '' AND name2 <> ''"), "name", "n")
    t, u = _words("name", 1), _words("name", 2)
    part = F.size(F.array_intersect(t, u)) / F.greatest(F.size(t), F.lit(1))
    text = 0.20 * jaccard(t, u) + 0.10 * part + 0.25 * F.col("n_ratio") + 0.20 * F.col("n_partial") + 0.10 * F.col("n_tsort")
    cty = _same("country")
    return p.select("i", "j", (text + 0.10 * cty + F.when((cty > 0) & (text >= 0.3), 0.10).otherwise(0.0)).alias("score"))


def pair_score(pairs: DataFrame) -> DataFrame:
    """(i, j, score) by names, addresses, city, phone (its last seven digits) and postal code, with a bonus of 0.1 or 0.05 for the country
    with a text score of 0.4 or 0.2. Parts that one side lacks count nothing."""
    p = ratios(ratios(pairs, "name", "n"), "addr", "a")
    t, u = [_words("name", k) for k in (1, 2)], [_words("addr", k) for k in (1, 2)]
    text = (
        0.10 * jaccard(*t) + 0.05 * containment(*t) + 0.15 * F.col("n_ratio") + 0.10 * F.col("n_partial") + 0.05 * F.col("n_tsort")
        + 0.05 * jaccard(*u) + 0.05 * F.col("a_ratio") + 0.05 * F.col("a_partial")
    )
    cty = _same("country")
    place = 0.10 * cty + 0.10 * _same("city") + 0.10 * _same("phone") + 0.05 * _same("postal") + 0.10 * containment(*u)
    bonus = F.when((cty > 0) & (text >= 0.4), 0.10).when((cty > 0) & (text >= 0.2), 0.05).otherwise(0.0)
    return p.select("i", "j", (text + place + bonus).alias("score"))
