"""Blocking as one plan: three score channels, top-K both ways, union, scores of every channel for every pair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.functions import text as T
from kinlake.operators import blocking, nearest, vectors
from kinlake.sources import scratch
from kinlake.sources.scratch import materialise


@dataclass(frozen=True)
class Config:
    k_char: int = 10
    k_comb: int = 12
    k_addr: int = 6
    k_rev: int = 3
    max_cand: int = 40
    rev_cap: int = 20
    addr_weight: float = 0.8
    char_max_df: float = 0.05
    word_max_df: float = 0.02
    df_floor: int = 50
    prune_keep: float = 0.998
    prune_max: int = 15
    folds: int = 3
    hop_anchors: int = 2
    hop_k: int = 5
    hop_cap: int = 10
    hop_min: float = 0.3
    seed: int = 42
    map_min_count: int = 15


DEFAULT = Config()


def posts(records: DataFrame, channel: str, c: Config = DEFAULT) -> DataFrame:
    features, df = {"char": (T.word_char_ngrams(F.col("name")), c.char_max_df), "word": (T.words(F.col("name")), c.word_max_df), "addr": (T.words(F.col("addr")), c.word_max_df)}[channel]
    return vectors.postings(records.withColumn("_f", features), "_f", df, c.df_floor)


def units(records: DataFrame, c: Config = DEFAULT, channels: tuple[str, ...] = ("char", "word", "addr")) -> nearest.Units:
    """The records' vectors in the channels, laid out for `forward` and `reverse`."""
    made = {"char": (T.word_char_ngrams(F.col("name")), c.char_max_df), "word": (T.words(F.col("name")), c.word_max_df), "addr": (T.words(F.col("addr")), c.word_max_df)}
    return nearest.lay_out(records, [nearest.Channel(x, *made[x], c.df_floor) for x in channels], F.col("country"))


def forward(u: nearest.Units, lists: list[tuple[str, int]], c: Config = DEFAULT, merged: bool = False, back: str | None = None, only: str | None = None) -> DataFrame:
    """The best targets of each anchor and source, by (score, k); the score "joint" is that of `combined`: i, j, src, score, s_<score>. `merged`
    gives each pair once, without score; `back` and `only` as in `nearest`."""
    joint = nearest.Joint("word", "addr", c.addr_weight) if any(x == "joint" for x, _ in lists) else None
    return nearest.nearest(u, lists, joint=joint, merged=merged, back=back, only=only).withColumnsRenamed({"l": "i", "r": "j", "rsrc": "src"}).drop("lsrc")


def reverse(u: nearest.Units, lists: list[tuple[str, int]], c: Config = DEFAULT, merged: bool = False) -> DataFrame:
    """The best anchors of each target: i, j, src, score, s_<score>; `merged` as in `forward`."""
    joint = nearest.Joint("word", "addr", c.addr_weight) if any(x == "joint" for x, _ in lists) else None
    return nearest.nearest(u, lists, "targets", "anchors", False, joint, merged).withColumnsRenamed({"l": "j", "lsrc": "src", "r": "i"}).drop("rsrc")


def scores(records: DataFrame, c: Config = DEFAULT, post: dict[str, DataFrame] | None = None, channels: tuple[str, ...] = ("char", "word", "addr")) -> dict[str, DataFrame]:
    """char, addr and comb scores of every anchor-target pair that shares a kept feature: scored once, used in both directions. `post` may
    hold the postings; `channels` are those that the caller reads."""
    found, post = {}, dict(post or {})
    for channel in channels:
        if channel not in post:  # written once: each is read three times or more
            post[channel] = materialise(posts(records, channel, c), f"{channel}-postings")
        found[channel] = vectors.cosine(post[channel].filter("src = 0"), post[channel].filter("src > 0"))
    if "word" not in channels:
        return found
    found["comb"] = vectors.combined(found["word"], found["addr"], post["word"], post["addr"], c.addr_weight)
    return found


def expanded(records: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Candidates within the caps of an anchor, and those of the second hop, with the scores of all channels: i, j, src, fwd, hop, cc, cm, ca
    and p = cm. Targets without a country meet the anchors of every country."""
    grouped = materialise(vectors.country_groups(records.select("id", "src", "country", "name", "addr")), "grouped")
    post = {x: materialise(posts(grouped, x, c), f"{x}-postings") for x in ("char", "word", "addr")}
    best = F.greatest("cc", "cm", "ca")
    near = materialise(blocking.cap_candidates(candidates(grouped, c, post).withColumn("score", best), c.max_cand, c.rev_cap), "near")
    hop = second_hop(near, records, post, c)
    return near.drop("score").withColumn("hop", F.lit(0)).unionByName(hop.withColumn("hop", F.lit(1)))


def second_hop(near: DataFrame, records: DataFrame, post: dict[str, DataFrame], c: Config = DEFAULT) -> DataFrame:
    """New pairs, scored in all channels: each anchor's best candidates lead to the targets nearest to them, in the joint space and in the
    addresses', that are of the anchor's country or of none; the hop_cap best of an anchor."""
    first = blocking.top_k(near.filter(F.col("score") >= c.hop_min), ["i"], c.hop_anchors).select("i", F.col("j").alias("a"))
    first = materialise(first, "hop-anchors")
    targets = {x: p.filter("src > 0") for x, p in post.items()}
    mine = {x: p.join(first.select(F.col("a").alias("id")).distinct(), "id", "left_semi") for x, p in targets.items()}
    found = {x: vectors.cosine(mine[x], targets[x]).filter("i <> j").groupBy("i", "j", "src").agg(F.max("score").alias("score")) for x in ("word", "addr")}
    joint = vectors.combined(found["word"], found["addr"], targets["word"], targets["addr"], c.addr_weight)
    lists = [blocking.top_k(s, ["i"], c.hop_k).select(F.col("i").alias("a"), "j") for s in (joint, found["addr"])]
    fresh = first.join(lists[0].unionByName(lists[1]).distinct(), "a").select("i", "j").distinct().join(near.select("i", "j"), ["i", "j"], "left_anti")
    ci, cj = records.select(F.col("id").alias("i"), F.col("country").alias("ci")), records.select(F.col("id").alias("j"), F.col("country").alias("cj"), "src")
    fresh = materialise(fresh.join(ci, "i").join(cj, "j").filter("ci = cj OR cj = ''").select("i", "j", "src"), "hop-pairs")
    scored = rescore(fresh, post, c).withColumn("score", F.greatest("cm", "ca"))
    return blocking.top_k(scored, ["i"], c.hop_cap).select("i", "j", "src", F.lit(0).alias("fwd"), "cc", "cm", "ca", F.col("cm").alias("p"))


def rescore(pairs: DataFrame, post: dict[str, DataFrame], c: Config = DEFAULT) -> DataFrame:
    """`pairs` (i, j, src) with cc, cm and ca, each computed for these pairs alone."""
    out = pairs
    for x, name in (("char", "cc"), ("word", "_cn"), ("addr", "ca")):
        out = vectors.pair_scores(out, post[x].filter("src = 0"), post[x].filter("src > 0"), name)
    for key in "ij":
        for x, name in (("word", "hn"), ("addr", "ha")):
            out = out.join(post[x].select(F.col("id").alias(key)).distinct().withColumn(f"{name}{key}", F.lit(1.0)), key, "left")
    w2 = c.addr_weight**2
    z = lambda key: F.sqrt(F.coalesce(f"hn{key}", F.lit(0.0)) + w2 * F.coalesce(f"ha{key}", F.lit(0.0)))
    cm = F.when((z("i") > 0) & (z("j") > 0), F.round((F.col("_cn") + w2 * F.col("ca")) / (z("i") * z("j")), 6)).otherwise(0.0)
    return out.withColumn("cm", cm).select(*pairs.columns, "cc", "cm", "ca")


def millionths(score: str) -> Column:
    """A candidate's score, which has six digits, as a whole number; over 1e6 it is the score again."""
    return F.rint(F.col(score) * 1e6).cast("int")


def candidates(records: DataFrame, c: Config = DEFAULT, post: dict[str, DataFrame] | None = None, links: DataFrame | None = None, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """i, j, src, fwd, cc, cm, ca, and p = cm. Without `post`, every pair is scored inside the tasks that rank it: the reverse lists, few pairs a target, are
    dealt by the anchors' units, and the task that has all forward lists of its anchors makes each pair once and adds the reverse pairs that are new. No
    forward pair is shuffled, and vectors and shuffle files go as soon as the pairs are written. `links`: pairs i, j with the anchor's country; of the
    candidates, those that are links alone are written. `shape`: makes of the candidates, which lie in partitions of whole anchors, what is written instead."""
    if post is None:
        spark = records.sparkSession
        with scratch.shuffles_dropped(spark):
            u = units(records, c)
            joint = nearest.Joint("word", "addr", c.addr_weight)
            back = materialise(nearest.nearest(u, [("joint", c.k_rev)], "targets", "anchors", False, joint, True), "reverse")
            gone = [u.path, *u.vocabularies, nearest.deal(back, u)]
            for path in {x.rpartition("/")[0] for x in back.inputFiles()}:
                scratch.remove(path)
            if links is not None:
                unit = nearest.unit_of(u.groups or [("", 0, 0, 1)], F.col("country"), F.lit(0), F.col("i").cast("bigint"))
                gone.append(nearest.deal(links.select(F.col("i").alias("l"), F.col("j").alias("r"), unit.alias("runit")).filter("runit IS NOT NULL"), u))
            found = forward(u, [("char", c.k_char), ("joint", c.k_comb), ("addr", c.k_addr)], c, True, gone[-1 - (links is not None)], None if links is None else gone[-1])
            found = found.select("i", "j", "src", "fwd", F.col("s_char").alias("cc"), F.col("s_joint").alias("cm"), F.col("s_addr").alias("ca"))
            found = materialise(found if shape is None else shape(found), "forward")
        for path in gone:
            scratch.remove(path)
        return found.withColumn("p", F.col("cm")) if shape is None else found
    s = scores(records, c, post)
    # Each top-K has a limited window of its own; only what they keep meets the other channels' scores, which lie dealt by the same keys.
    lists = [(blocking.top_k(s["char"], ["i", "src"], c.k_char), 1), (blocking.top_k(s["comb"], ["i", "src"], c.k_comb), 1), (blocking.top_k(s["addr"], ["i", "src"], c.k_addr), 1), (blocking.top_k(s["comb"], ["j"], c.k_rev), 0)]
    out = None
    for df, fwd in lists:
        part = df.select("i", "j", "src", F.lit(fwd).alias("fwd"))
        out = part if out is None else out.unionByName(part)
    out = out.groupBy("i", "j", "src").agg(F.max("fwd").alias("fwd"))
    for channel, name in (("char", "cc"), ("comb", "cm"), ("addr", "ca")):
        out = out.join(s[channel].select("i", "j", "src", F.col("score").alias(name)), ["i", "j", "src"], "left").na.fill(0.0, [name])
    return out.withColumn("p", F.col("cm"))
