"""All features of a candidate pair: set and IDF overlaps in the JVM, string ratios in one Arrow pass.

Records have id, name (the core name), full (the whole name), addr and country; features of addresses are -1 where one is missing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.functions import fuzzy
from kinlake.functions import text as T

#: Features that `kernel` adds, apart from those of maps and strings.
SETS = (
    "n_exact", "n_jac", "n_idf_jac", "n_idf_min", "n_first", "n_acro", "n_len1", "n_len2", "n_ntok1", "n_ntok2", "n_digits", "a_missing",
    "a_idf_jac", "a_idf_min", "a_postal", "a_num_jac", "a_name_in", "a_wjac", "a_wcont", "a_widf", "a_num_conflict",
)
MAPPED = ("n_jac_map", "n_tset_map", "a_jac_map")
STRINGS = ("n_ratio", "n_partial", "n_tsort", "n_tset", "n_jw", "nf_ratio", "a_tset", "a_ratio", "a_partial")


def gather(pairs: DataFrame, records: DataFrame, *more: str) -> DataFrame:
    """Pairs with both records' name, full, addr and `more`, numbered 1 for i and 2 for j."""
    out = pairs
    for key, k in (("i", 1), ("j", 2)):
        out = out.join(records.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}{k}") for c in ("name", "full", "addr", *more)]), key)
    return out


def _share(both: Column, whole: Column) -> Column:
    return F.when(whole > 0, both / F.greatest(whole, F.lit(1))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats."""
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def weighted(records: DataFrame, words: Column, idf: DataFrame, default: Column, out: str) -> DataFrame:
    """Add <out>, the distinct words with their weights as texts 'word weight', and <out>_sum, the weights' sum. Words that `idf` (token,
    idf) lacks weigh `default`. Words meet their weights once per record, not per pair; no dictionary is copied to the executors."""
    each = records.select("id", F.explode(F.array_distinct(words)).alias("token")).join(idf.select("token", "idf"), "token", "left")
    each = each.select("id", "token", F.coalesce("idf", default).alias("w"))
    made = each.groupBy("id").agg(F.collect_list(F.concat_ws(" ", "token", F.col("w").cast("string"))).alias(out), F.sum("w").alias(f"{out}_sum"))
    return records.join(made, "id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).na.fill(0.0, [f"{out}_sum"])


def idf_shares(w: str) -> tuple[Column, Column]:
    """Of gathered columns w1, w2 and their sums: weights of shared words over those of all, and over the lighter side's; 0 where either is
    empty. A word has one weight, so that equal texts are equal words, and sets of texts intersect by hash."""
    both = F.aggregate(F.array_intersect(f"{w}1", f"{w}2"), F.lit(0.0), lambda total, t: total + F.substring_index(t, " ", -1).cast("double"))
    a, b = F.col(f"{w}_sum1"), F.col(f"{w}_sum2")
    part = lambda whole: F.when((F.size(f"{w}1") > 0) & (F.size(f"{w}2") > 0) & (whole > 0), both / F.greatest(whole, F.lit(1e-300))).otherwise(0.0)
    return part(a + b - both), part(F.least(a, b))


def spread(pairs: DataFrame) -> DataFrame:
    """`pairs` in a stated number of partitions: narrow rows that cost much must not be put together."""
    spark = pairs.sparkSession
    return pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "i", "j")


def with_weights(records: DataFrame, name_idf: DataFrame, addr_idf: DataFrame) -> DataFrame:
    """`records` with what `set_features` needs of weights; a word that they lack weighs ln n, with n the number of records."""
    default = F.log(F.lit(float(max(records.count(), 1))))
    long = F.filter(T.words(F.col("addr")), lambda x: ~x.rlike("^[0-9]+$") & (F.length(x) >= 3))
    out = weighted(records, T.words(F.col("name")), name_idf, default, "nw")
    return weighted(weighted(out, T.words(F.col("addr")), addr_idf, default, "aw"), long, addr_idf, default, "ww")


#: Columns of `with_weights` to gather.
WEIGHTS = ("nw", "nw_sum", "aw", "aw_sum", "ww", "ww_sum")


def set_features(pairs: DataFrame) -> DataFrame:
    """SETS of pairs gathered with WEIGHTS."""
    p = spread(pairs)
    for k in (1, 2):
        p = p.withColumn(f"l{k}", T.words(F.col(f"name{k}"))).withColumn(f"t{k}", F.array_distinct(f"l{k}")).withColumn(f"u{k}", F.array_distinct(T.words(F.col(f"addr{k}"))))
        p = p.withColumn(f"d{k}", F.filter(f"u{k}", lambda x: x.rlike("^[0-9]+$"))).withColumn(f"w{k}", F.filter(f"u{k}", lambda x: ~x.rlike("^[0-9]+$") & (F.length(x) >= 3)))
    size, lit = (lambda c: F.size(F.col(c))), F.lit
    names, addrs = (size("t1") > 0) & (size("t2") > 0), (size("u1") > 0) & (size("u2") > 0)
    numbers, words = (size("d1") > 0) & (size("d2") > 0), (size("w1") > 0) & (size("w2") > 0)
    digits = [F.array_sort(F.filter(f"t{k}", lambda x: x.rlike("^[0-9]+$"))) for k in (1, 2)]
    postal = [F.filter(f"u{k}", lambda x: x.rlike("^[0-9]{5,6}$")) for k in (1, 2)]
    letters = lambda a, b: F.array_join(F.transform(a, lambda x: F.substring(x, 1, 1)), "") == F.get(b, lit(0))
    acro = lambda a, b: (F.size(a) >= 2) & (F.size(b) == 1) & (F.length(F.get(b, lit(0))) >= 2)
    on = lambda ok, x, otherwise=0.0: F.when(ok, x).otherwise(lit(otherwise))
    l1, l2 = F.col("l1"), F.col("l2")
    p = p.select(
        "*", on(names, (F.col("name1") == F.col("name2")).cast("double")).alias("n_exact"), on(names, jaccard(F.col("t1"), F.col("t2"))).alias("n_jac"),
        on(names, (F.get(l1, lit(0)) == F.get(l2, lit(0))).cast("double")).alias("n_first"),
        on(names, F.when(acro(l1, l2), letters(l1, l2).cast("double")).when(acro(l2, l1), letters(l2, l1).cast("double")).otherwise(0.0)).alias("n_acro"),
        *[F.length(f"name{k}").cast("double").alias(f"n_len{k}") for k in (1, 2)], *[F.size(f"l{k}").cast("double").alias(f"n_ntok{k}") for k in (1, 2)],
        F.when((F.size(digits[0]) == 0) & (F.size(digits[1]) == 0), -1.0).otherwise((digits[0] == digits[1]).cast("double")).alias("n_digits"),
        F.when(addrs, 0.0).when((size("u1") == 0) & (size("u2") == 0), 2.0).otherwise(1.0).alias("a_missing"),
        on(addrs & (F.size(postal[0]) > 0) & (F.size(postal[1]) > 0), F.arrays_overlap(*postal).cast("double"), -1.0).alias("a_postal"),
        on(addrs & numbers, jaccard(F.col("d1"), F.col("d2")), -1.0).alias("a_num_jac"),
        on(addrs, F.when((size("t1") > 0) & (size("t2") > 0), (F.size(F.array_except("t1", "u2")) == 0).cast("double")).otherwise(0.0), -1.0).alias("a_name_in"),
        on(addrs & words, jaccard(F.col("w1"), F.col("w2")), -1.0).alias("a_wjac"), on(addrs & words, containment(F.col("w1"), F.col("w2")), -1.0).alias("a_wcont"),
        on(addrs, (numbers & ~F.arrays_overlap("d1", "d2")).cast("double"), -1.0).alias("a_num_conflict"),
    )
    jac, least = idf_shares("nw")
    p = p.withColumn("n_idf_jac", jac).withColumn("n_idf_min", least)
    jac, least = idf_shares("aw")
    p = p.withColumn("a_idf_jac", on(addrs, jac, -1.0)).withColumn("a_idf_min", on(addrs, least, -1.0)).withColumn("a_widf", on(addrs & words, idf_shares("ww")[1], -1.0))
    return p.drop("l1", "l2", "t1", "t2", "u1", "u2", "d1", "d2", "w1", "w2", *[f"{c}{k}" for c in WEIGHTS for k in (1, 2)])


def rewrite(records: DataFrame, column: str, table: DataFrame, out: str, key: str = "token", value: str = "plain") -> DataFrame:
    """Add `out`: the words of `column` with those that `table` (key, value) knows replaced, in order. Only rows with such a word are
    taken apart; a table of any size is joined, not collected."""
    rows = records.withColumn(out, F.col(column))
    words = records.select("id", F.posexplode(T.words(F.col(column))).alias("pos", key)).join(table.select(key, value).dropDuplicates([key]), key, "left")
    words = words.withColumn("hit", F.col(value).isNotNull().cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(value, key).alias("w")))), lambda x: x["w"]), " ")
    new = words.groupBy("id").agg(joined.alias("_new"), F.max("hit").alias("_hit")).filter("_hit = 1").select("id", "_new")
    return rows.join(new, "id", "left").withColumn(out, F.coalesce("_new", out)).drop("_new")


def mapped_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """MAPPED: Jaccard of the words of name_map and addr_map, the records' names and addresses with equivalent words made one, and the names'
    token set ratio."""
    out = pairs
    for key, k in (("i", 1), ("j", 2)):
        out = out.join(records.select(F.col("id").alias(key), *[F.array_distinct(T.words(F.col(c))).alias(f"_{c}{k}") for c in ("name_map", "addr_map")]), key)
    both = lambda c: (F.size(f"_{c}1") > 0) & (F.size(f"_{c}2") > 0)
    j = lambda c: jaccard(F.col(f"_{c}1"), F.col(f"_{c}2"))
    sets = [F.array_join(f"_name_map{k}", " ") for k in (1, 2)]
    out = spread(out).withColumn("_t", fuzzy.pairwise("token_set_ratio")(*sets))  # 0 where one is empty
    out = out.withColumn("n_tset_map", F.col("_t")).drop("_t")
    out = out.withColumn("n_jac_map", F.when(both("name_map"), j("name_map")).otherwise(0.0)).withColumn("a_jac_map", F.when(both("addr_map"), j("addr_map")).otherwise(-1.0))
    return out.drop(*[f"_{c}{k}" for c in ("name_map", "addr_map") for k in (1, 2)])


def string_features(pairs: DataFrame) -> DataFrame:
    """STRINGS of gathered pairs: names' ratios are 0 and addresses' -1 where one is empty."""
    def run(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
        names = (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.jaro_winkler)
        addrs = (fuzzy.token_set_ratio, fuzzy.ratio, fuzzy.partial_ratio)
        rows = [
            [*([f(p, q) for f in names] if p and q else [0.0] * 5), fuzzy.ratio(r, s) if p and q else 0.0, *([f(m, n) for f in addrs] if m and n else [-1.0] * 3)]
            for p, q, r, s, m, n in zip(a, b, x, y, u, v, strict=True)
        ]
        return pd.DataFrame(rows, columns=list(STRINGS), dtype="float64")

    made = F.pandas_udf(run, ", ".join(f"{c} double" for c in STRINGS))
    return spread(pairs).withColumn("_s", made("name1", "name2", "full1", "full2", "addr1", "addr2")).select("*", "_s.*").drop("_s")


#: Features of the suffix normaliser's records: those of the JVM, and those of strings.
SUFFIX_SETS = ("pc_eq", "pc_conf", "pc_missing", "hn_eq", "hn_conf", "exact_core", "first_eq", "acro", "ntok_a", "ntok_b", "len_ratio", "alen_a", "alen_b", "src3")
SUFFIX_STRINGS = ("jw", "ratio", "partial", "tsort", "tset", "tset_full", "ratio_compact", "a_tset", "a_tsort", "a_partial")


def suffix_features(pairs: DataFrame) -> DataFrame:
    """SUFFIX_SETS of pairs gathered with postal, house and src."""
    p = pairs
    for k in (1, 2):
        p = p.withColumn(f"_d{k}", T.name_derived(F.col(f"name{k}")))
    d = lambda k, f: F.col(f"_d{k}")[f]
    has = lambda c: (F.col(f"{c}1") != "") & (F.col(f"{c}2") != "")
    same = lambda c: F.col(f"{c}1") == F.col(f"{c}2")
    number = lambda x: x.cast("double")
    l1, l2 = F.length("name1"), F.length("name2")
    return p.select(
        "*", number(has("postal") & same("postal")).alias("pc_eq"), number(has("postal") & ~same("postal")).alias("pc_conf"), number(~has("postal")).alias("pc_missing"),
        number(has("house") & same("house")).alias("hn_eq"), number(has("house") & ~same("house")).alias("hn_conf"), number(same("name") & (F.col("name1") != "")).alias("exact_core"),
        number((d(1, "first") == d(2, "first")) & (d(1, "first") != "")).alias("first_eq"),
        number(((d(1, "acro") == d(2, "compact")) & (d(1, "acro") != "")) | ((d(1, "compact") == d(2, "acro")) & (d(2, "acro") != ""))).alias("acro"),
        number(d(1, "ntok")).alias("ntok_a"), number(d(2, "ntok")).alias("ntok_b"), (F.least(l1, l2) / F.greatest(l1, l2, F.lit(1))).alias("len_ratio"),
        number(F.length("addr1")).alias("alen_a"), number(F.length("addr2")).alias("alen_b"), number(F.col("src2") == 2).alias("src3"),
    ).drop("_d1", "_d2")


def suffix_strings(pairs: DataFrame) -> DataFrame:
    """SUFFIX_STRINGS of gathered pairs, from 0 to 1; two empty strings are alike."""
    def run(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
        part = lambda f, p, q: f(p, q) / 100
        rows = [
            [fuzzy.jaro_winkler(p, q), *[part(f, p, q) for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio)], part(fuzzy.token_set_ratio, r, s),
             part(fuzzy.ratio, p.replace(" ", ""), q.replace(" ", "")), *[part(f, m, n) for f in (fuzzy.token_set_ratio, fuzzy.token_sort_ratio, fuzzy.partial_ratio)]]
            for p, q, r, s, m, n in zip(a, b, x, y, u, v, strict=True)
        ]
        return pd.DataFrame(rows, columns=list(SUFFIX_STRINGS), dtype="float64")

    made = F.pandas_udf(run, ", ".join(f"{c} double" for c in SUFFIX_STRINGS))
    return spread(pairs).withColumn("_s", made("name1", "name2", "full1", "full2", "addr1", "addr2")).select("*", "_s.*").drop("_s")


def basic_features(pairs: DataFrame) -> DataFrame:
    """The first version's features of gathered pairs (country too): token and letter-triple Jaccard, length ratio, edit similarity, a
    shared sound among the first three words (Soundex), countries."""
    t = [F.array_distinct(T.words(F.col(f"name{k}"))) for k in (1, 2)]
    u = [F.array_distinct(T.words(F.col(f"addr{k}"))) for k in (1, 2)]
    g = [T.char_ngrams(F.replace(f"name{k}", F.lit(" "), F.lit("")), 3) for k in (1, 2)]
    sound = [F.transform(F.filter(F.slice(T.words(F.col(f"name{k}")), 1, 3), lambda w: F.length(w) > 2), F.soundex) for k in (1, 2)]
    l1, l2 = F.length("name1"), F.length("name2")
    near = lambda c: 1.0 - F.levenshtein(f"{c}1", f"{c}2") / F.greatest(F.length(f"{c}1"), F.length(f"{c}2"), F.lit(1))
    return pairs.select(
        "*", jaccard(*t).alias("name_jaccard"), jaccard(*g).alias("name_ngram3_jaccard"), (F.least(l1, l2) / F.greatest(l1, l2, F.lit(1))).alias("name_len_ratio"), jaccard(*u).alias("addr_jaccard"),
        near("name").alias("name_edit"), F.coalesce(F.arrays_overlap(*sound), F.lit(False)).cast("int").alias("name_phonetic_match"), (F.col("country1") == F.col("country2")).cast("int").alias("country_match"),
    )
