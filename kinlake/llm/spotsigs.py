"""SpotSigs fingerprints (Theobald, Siddharth, Paepcke 2008).

A signature is a common word (the anchor) with the chain of the `CHAIN` content words after it; a text's
fingerprint is the set of its signatures' 64-bit hashes. A text without any anchor, of another language, say, has a
chain from each of its words. Sets are partitioned by length so that only neighbouring
partitions can hold pairs at a threshold; within these, pairs meet at their rarest signatures and Jaccard
similarity is computed only if the lengths allow it. All of it runs on JVM operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlake.llm.common import bucket_of, documents, long_array, materialise, shuffle_partitions

#: Common words of English, German, Spanish and French.
ANCHORS = (
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its "
    "more no not of on one or our out she so some such than that the their them then there these they this to up was we were what when which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im ist ja kein man mit nach nicht noch nur oder schon sein sich sie sind so um und uns unter vom von vor war was wenn wer werden wie wir zu zum zur über "
    "al algo ante como con contra cuando de del desde donde el ella ellos en entre era es esta este ha hasta la las le lo los me mi muy más ni nos o para pero por porque que se según si sin sobre su sus también te tiene todo un una uno y ya yo "
    "au aux avec c ce ces cette comme d dans de des donc du elle en est et eux il ils j je l la le les leur lui ma mais même mes moi n ne nos notre nous ont ou par pas plus pour qu que qui s sa sans se ses son sont sur ta te tes toi ton tu un une vos votre vous y à été être"
).split()
CHAIN = 2
#: Near-duplicates: least Jaccard similarity of the signature sets.
THRESHOLD = 0.8


def with_signatures(df: DataFrame, text: str = "text", out: str = "sigs") -> DataFrame:
    """Add `out`, the sorted array<bigint> of distinct signature hashes of a text column. Null and empty texts have none; in a
    text with words but no spot every word begins a chain."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    # Anchors end with \x01, content words with a space: split at spaces, each item is a content word with the anchors
    # before it, and its chain is the content words from there on. Steps are columns, so that none is evaluated anew
    # for each element of the next.
    tagged = F.transform("_words", lambda w: F.concat(w, F.when(w.isin(ANCHORS), F.lit("\x01")).otherwise(F.lit(" "))))
    after = lambda k: F.substring_index(F.coalesce(F.get("_items", k), F.lit("")), "\x01", -1)

    def spots(item: Column, k: Column) -> Column:
        chain = F.concat_ws(" ", *[after(k + i) for i in range(CHAIN)])
        parts = F.split(item, "\x01")
        return F.transform(F.filter(parts, lambda _, i: i < F.size(parts) - 1), lambda a: F.xxhash64(a, chain))

    none = F.array().cast("array<bigint>")
    found = F.flatten(F.transform("_items", lambda item, k: F.when(F.instr(item, "\x01") > 0, spots(item, k)).otherwise(none)))
    staged = df.withColumn("_words", words).withColumn("_items", F.split(F.array_join(tagged, ""), " ")).withColumn("_spots", found)
    chains = F.transform("_words", lambda _, k: F.xxhash64(F.array_join(F.slice("_words", k + 1, CHAIN + 1), " ")))
    sigs = F.when(F.size("_spots") > 0, F.col("_spots")).when(F.array_join("_words", "") == "", none).otherwise(chains)
    return staged.withColumn(out, F.array_sort(F.array_distinct(sigs))).drop("_words", "_items", "_spots")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike (1), one is not (0)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / F.greatest(every, F.lit(1.0)))


def pruned_jaccard(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Jaccard similarity, or null where the sets' lengths alone keep it below the threshold."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(small >= large * threshold, jaccard(a, b))


def length_partition(sigs: Column, threshold: float = THRESHOLD) -> Column:
    """Lengths grow by 1 / threshold from one partition to the next, so that pairs at the threshold lie in the same
    partition or in neighbouring ones."""
    n = F.size(sigs).cast("double")
    return F.when(n > 0, F.floor(F.log(n) / math.log(1 / threshold) + 1e-9)).otherwise(-1).cast("int")


def encode(sigs: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits per signature, in the order of the set."""
    return F.lower(F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 16, "0")), ""))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): pairs of distinct fingerprints, each named by its smallest doc_id, with Jaccard similarity of at
    least `threshold`. Documents of equal fingerprints are one class (see `classes`), never pairs.

    Prefix filtering: with signatures ordered from rare to frequent, a pair at the threshold shares one of the first
    n - ceil(threshold n) + 1 of each, so that frequent signatures, however hot, index next to nothing.
    """
    # Written first: a filter on the sets would be pushed into the lambdas that make them.
    sets = materialise(materialise(classes(docs), "spots").groupBy("sigs").agg(F.min("doc_id").alias("node")).filter("size(sigs) > 0"), "spot-classes")
    rarity = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    n = F.size("sigs")
    ranked = sets.select("node", n.alias("n"), F.explode("sigs").alias("sig")).join(rarity, "sig")
    w = Window.partitionBy("node").orderBy("df", "sig")
    prefix = ranked.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    prefix = prefix.filter("df > 1").withColumn("part", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)).select("node", "n", "sig", "part")
    probe = prefix.select(F.col("node").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    meet = prefix.withColumnRenamed("node", "a").join(probe, ["sig", "part"])
    lengths = (F.col("n") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("n") * threshold)
    pairs = meet.filter(lengths & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (sets.select(F.col("node").alias(x), F.col("sigs").alias(f"s{x}")) for x in "ab")
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", pruned_jaccard(F.col("sa"), F.col("sb"), threshold).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, sigs of every row, repeated rows and null ids too; null and empty texts have no signatures; an empty table gives no rows."""
    return with_signatures(docs.select(F.col("doc_id").cast("bigint"), "text")).select("doc_id", "sigs")


_FIRST = -(1 << 63)


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None, between: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows with struct `next`: the `columns` of the row after it by (doc_id, text), after the last the first's. `between` may add columns
    behind the shuffle, which then are not part of it.

    Quantiles of doc_id, values that occur, cut the rows into buckets in one shuffle. The first row of each bucket
    comes along to the bucket before, as a guest at its end, so that no row looks beyond its bucket. Null ids come
    first. Rows that share an id follow each other by text, in one bucket, as ids are taken to be nearly distinct; equal rows in
    any order. A table of one row is followed by itself; an empty one gives no rows.
    """
    spark = docs.sparkSession
    n = buckets or 4 * shuffle_partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST))
    ends = docs.agg(F.min(key).alias("lo"), F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("q")).first()
    splits = sorted({ends["lo"], *(ends["q"] or [])} - {None}) or [_FIRST]
    at = bucket_of(F.col("_key"), splits) - 1
    keyed = docs.withColumn("_key", key).withColumn("_own", at)
    guest = F.when(F.col("_key") == F.element_at(long_array(splits), F.col("_own") + 1), F.pmod(F.col("_own") - 1, F.lit(len(splits))))
    dealt = keyed.withColumn("_in", F.explode(F.array_compact(F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("g")), F.when(guest.isNotNull(), F.struct(guest.alias("b"), F.lit(1).alias("g")))))))
    dealt = dealt.select("*", F.col("_in.b").alias("_b"), F.col("_in.g").alias("_g")).drop("_in", "_own")
    w = Window.partitionBy("_b").orderBy("_g", "_key", "text")
    return between(dealt.repartition("_b")).withColumn("next", F.lead(F.struct(*columns)).over(w)).filter("_g = 0").drop("_b", "_g", "_key")


def op2_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness; see `jaccard` and `length_partition`."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, ["text", "sigs"], between=with_signatures)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.expr("substring(next.text, 1, cast(length(text) div 4 as int))"))
    docs = with_signatures(docs.withColumn("edited", edited), "edited", "edited_sigs")
    return docs.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("sigs")).alias("fingerprint"), encode(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
        F.size("sigs").alias("n_signatures"), length_partition(F.col("sigs")).alias("length_partition"),
    )
