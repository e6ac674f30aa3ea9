"""Candidate pairs: overlap joins, exact keys, top-K in both directions, second hop, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlake.functions import text as T
from kinlake.operators import nearest


def top_k(pairs: DataFrame, by: Sequence[str], k: int, score: str = "score", ties: Sequence[str] = ("i", "j")) -> DataFrame:
    """The k best rows per `by`, ties by id. Spark prunes with a group limit before and after the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return pairs.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def overlap(left: DataFrame, right: DataFrame, features: str) -> DataFrame:
    """(i, j, src, shared): pairs that share a feature and how many they share (left repeats count). Features without a partner
    fall out of the join; counting has map-side partials."""
    a = left.select(F.col("id").alias("i"), F.explode(features).alias("f"))
    b = right.select(F.col("id").alias("j"), "src", F.explode(F.array_distinct(features)).alias("f"))
    return a.join(b, "f").groupBy("i", "j", "src").agg(F.count("*").alias("shared"))


def capped(records: DataFrame, features: str, cap: int) -> DataFrame:
    """Records' features in posting lists cut to the `cap` smallest ids each; one array column `features` per record."""
    w = Window.partitionBy("f").orderBy("id")
    posts = records.select("id", "src", F.explode(F.array_distinct(features)).alias("f")).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= cap)
    return posts.groupBy("id", "src").agg(F.collect_list("f").alias("features"))


def exact_keys(left: DataFrame, right: DataFrame, key_cap: int = 50) -> DataFrame:
    """Distinct (i, j) that share a key: k1 the core name, k2 the name without spaces, k3 its sorted tokens, k4 first token and postal
    code. Keys of more than key_cap targets are skipped."""
    def keys(d: DataFrame) -> DataFrame:
        t = T.words(F.col("name"))
        compact, first = F.replace("name", F.lit(" "), F.lit("")), F.get(t, F.lit(0))
        made = F.array(
            F.when(F.length("name") >= 3, F.concat(F.lit("k1:"), "name")),
            F.when(F.length(compact) >= 4, F.concat(F.lit("k2:"), compact)),
            F.when(F.size(t) >= 2, F.concat(F.lit("k3:"), F.array_join(F.array_sort(t), " "))),
            F.when((F.length(first) >= 3) & (F.col("postal") != ""), F.concat(F.lit("k4:"), first, F.lit("|"), "postal")),
        )
        return d.select("id", F.explode(F.array_compact(made)).alias("key"))

    b = keys(right).distinct()
    rare = b.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") <= key_cap).select("key")
    b = b.join(rare, "key").withColumnRenamed("id", "j")
    return keys(left).withColumnRenamed("id", "i").join(b, "key").select("i", "j").distinct()


def union_channels(channels: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """(i, j, fwd): distinct pairs of all channels; fwd is 1 if a forward one found the pair."""
    out = None
    for df, fwd in channels:
        part = df.select("i", "j", F.lit(fwd).alias("fwd"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("i", "j").agg(F.max("fwd").alias("fwd"))


def cap_candidates(pairs: DataFrame, max_cand: int = 40, rev_cap: int = 20) -> DataFrame:
    """Forward pairs of overall rank <= max_cand, and reverse-only pairs of rank <= rev_cap among themselves. The best of each kind come first, by a
    group limit before the shuffle; as they hold the max_cand best of all, overall ranks up to that stay what they are."""
    order = [F.desc("score"), "j"]
    w, r = Window.partitionBy("i").orderBy(*order), Window.partitionBy("i", "fwd").orderBy(*order)
    ranked = pairs.withColumn("rrk", F.row_number().over(r)).filter(F.col("rrk") <= max(max_cand, rev_cap)).withColumn("rk", F.row_number().over(w))
    return ranked.filter(((F.col("fwd") == 1) & (F.col("rk") <= max_cand)) | ((F.col("fwd") == 0) & (F.col("rrk") <= rev_cap))).drop("rk", "rrk")


def blended(pairs: DataFrame) -> DataFrame:
    """Pairs (i, j, cn, ca) with a `score`: the greater of cn and 0.6 cn + 0.4 ca."""
    return pairs.withColumn("score", F.round(F.greatest(F.col("cn"), 0.6 * F.col("cn") + 0.4 * F.col("ca")), 6))


def cap_blended(pairs: DataFrame, most: int = 25, whole: bool = False) -> DataFrame:
    """The `most` best pairs of an anchor by `blended`. `whole`: pairs are as `nearest` returns them, an anchor's in one partition, and aren't shuffled."""
    scored = blended(pairs)
    return nearest.best_of(scored, "i", "score", "j", most) if whole else top_k(scored, ["i"], most).drop("rk")


def second_hop(pairs: DataFrame, target_scores: DataFrame, countries: DataFrame, anchors: int = 2, least: float = 0.3, k: int = 5, cap: int = 10) -> DataFrame:
    """New (i, j, score): the k nearest targets of each anchor's best candidates, where not candidates yet and of its country.

    pairs: i, j, score. target_scores: i, j, score among targets. countries: id, country. A new pair's score is the best
    product of its two steps."""
    best = top_k(pairs.filter(F.col("score") >= least), ["i"], anchors).select("i", F.col("j").alias("a"), F.col("score").alias("s1"))
    near = top_k(target_scores.filter("i <> j"), ["i"], k).select(F.col("i").alias("a"), F.col("j"), F.col("score").alias("s2"))
    hop = best.join(near, "a").groupBy("i", "j").agg(F.round(F.max(F.col("s1") * F.col("s2")), 6).alias("score"))
    ci, cj = (countries.select(F.col("id").alias(x), F.col("country").alias(f"c{x}")) for x in "ij")
    hop = hop.join(ci, "i").join(cj, "j").filter("ci = cj OR cj = ''").select("i", "j", "score")
    return top_k(hop.join(pairs.select("i", "j"), ["i", "j"], "left_anti"), ["i"], cap).select("i", "j", "score")


def embedding_top_k(left: DataFrame, right: DataFrame, k: int = 100, least: float = 0.5, block: int = 512, chunk: int = 50_000) -> DataFrame:
    """(i, j, score): exact cosine top-K of left.embedding against right.embedding (columns id, embedding).

    The left vectors are written to the shared folder, a row a block of about `block`. Each task of the one scan of the right side holds
    `chunk` vectors at a time, reads the blocks one after the other, and keeps k targets a query for each product; a second top-K merges.
    Neither side is gathered or copied to the driver."""
    import numpy as np
    import pandas as pd

    from kinlake.sources import scratch

    spark = left.sparkSession
    blocks = max(1, -(-left.count() // block))
    path = scratch.new_folder(spark, "query-blocks")
    pack = left.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("id", "embedding")).alias("q"))
    pack.select("q.id", "q.embedding").write.parquet(path)

    def unit(vectors) -> np.ndarray:
        m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def queries():
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        fs, folder = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
        for batch in ds.dataset(folder, filesystem=fs, format="parquet").to_batches(batch_size=1):
            for ids, vectors in zip(batch["id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
                yield np.array(ids), unit(vectors)

    def meet(ids: list, vectors: list):
        jj, m = np.concatenate(ids), unit([v for x in vectors for v in x])
        for ii, q in queries():
            s = np.round(q @ m.T, 6)
            keep = min(k, s.shape[1])
            order = np.lexsort((np.broadcast_to(jj, s.shape), -s), axis=1)[:, :keep]
            score = np.take_along_axis(s, order, 1)
            ok = score.ravel() > least
            yield pd.DataFrame({"i": np.repeat(ii, keep)[ok], "j": jj[order.ravel()][ok], "score": score.ravel()[ok]})

    def run(batches):
        ids, vectors, held = [], [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            ids.append(pdf["id"].to_numpy())
            vectors.append(pdf["embedding"].tolist())
            held += len(pdf)
            if held >= chunk:
                yield from meet(ids, vectors)
                ids, vectors, held = [], [], 0
        if held:
            yield from meet(ids, vectors)

    return top_k(right.select("id", "embedding").mapInPandas(run, "i bigint, j bigint, score double"), ["i"], k).select("i", "j", "score")
