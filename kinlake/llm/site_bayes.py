"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model, fitted on a bounded sample of labelled rows, gives each document's own log odds. Hosts and
paths add what their other documents say, the document itself left out: their expected good documents are binomial
evidence, shrunk with a beta prior towards the level above (path to host, host to the whole), so that a site with few
documents stays near its parent. The prior's strength comes from the spread of the sites' rates beyond sampling
noise (method of moments); without such a spread sites say nothing. The parent counts as one document at least. A
document's posterior log odds are its own plus its path's shift from the global rate, times a trust between 0 and 1 that
the labelled sample gives the shifts: where sites tell nothing of quality, they decide nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlake.llm.common import documents, materialise
from kinlake.llm.textstats import text_stats, with_text_stats

#: Labelled rows for the fit: those of the smallest hashes of doc_id.
SAMPLE = 20_000
#: Documents are rejected below this posterior probability of being good.
CUT = 0.5
#: Sites whose posteriors are broadcast; beyond, the engine joins by shuffle and splits skewed keys.
BROADCAST_SITES = 100_000

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "digits", "stops", "few_words")


def features(prefix: str = "") -> list[Column]:
    """Document evidence, each about 0 to 3, from the text statistics in columns named with `prefix`."""
    n = lambda c: F.col(f"{prefix}{c}")
    words, one = F.greatest(n("n_words"), F.lit(1)).cast("double"), F.lit(1.0)
    return [
        F.log1p(n("n_words")) / 3, F.least(n("word_chars") / words / 5, F.lit(4.0)), F.least(n("n_symbols") / words * 5, F.lit(3.0)),
        F.least(n("n_dup_lines") / F.greatest(n("n_lines"), F.lit(1)) * 3, F.lit(3.0)), F.least(n("n_repeat_words") / words * 3, F.lit(3.0)),
        n("n_distinct_words") / words, F.least(n("n_digits") / words, F.lit(3.0)), F.least(n("n_stops") / words * 10, F.lit(3.0)),
        F.greatest(one - words / 20, F.lit(0.0)),
    ]


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton steps); the last one is the intercept. Without both classes, the
    weights are zero and the intercept tells the smoothed rate."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(set(y.tolist())) < 2:
        return w
    ridge = np.full(len(w), l2 * len(y))
    ridge[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(ridge + 1e-9), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(sites: DataFrame, prior: Column) -> float:
    """How many documents the prior with mean `prior` counts as, for `sites` (good, n): m(1-m)/v - 1, where v is the weighted
    variance of the rates less its part from sampling; one at least, infinity if v is not above zero."""
    rate = F.col("good") / F.col("n")
    m = prior
    moments = sites.agg(F.sum(F.col("n") * (rate - m) * (rate - m)).alias("a"), F.sum(m * (1 - m)).alias("b"), F.sum("n").alias("n"), F.avg(m * (1 - m)).alias("c")).first()
    if not moments["n"] or moments["a"] <= moments["b"]:
        return float("inf")
    return max(moments["c"] * moments["n"] / (moments["a"] - moments["b"]) - 1, 1.0)


def shrunk(good: Column, n: Column, prior: Column, k: float) -> Column:
    """The posterior rate of `good` in `n` documents."""
    return prior if k == float("inf") else (good + k * prior) / (n + k)


def trust(own: np.ndarray, shift: np.ndarray, y: np.ndarray) -> float:
    """The factor in [0, 1] of the sites' shifts that makes the labels most likely, given the documents' own log odds. The
    likelihood is concave in it."""
    gain = lambda f: float(np.sum((y - 1 / (1 + np.exp(-np.clip(own + f * shift, -30, 30)))) * shift))
    if not len(y) or gain(0.0) <= 0:
        return 0.0
    if gain(1.0) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(40):
        low, high = ((low + high) / 2, high) if gain((low + high) / 2) > 0 else (low, (low + high) / 2)
    return low


def sites_of(docs: DataFrame, host: Column | None = None, path: Column | None = None) -> tuple[Column, Column]:
    """Host and path as strings, '?' for nulls; by default the source, and the source with the language."""
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("?"))
    path = F.coalesce((F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))) if path is None else path).cast("string"), F.lit("?"))
    return host, path


@dataclass(frozen=True)
class Posterior:
    """What `learn` finds: the model's weights, the global rate, the priors' strengths, the trust in sites, and the sites (host, path,
    host_good, host_n, good, n)."""

    weights: np.ndarray
    base: float
    k_host: float
    k_path: float
    trust: float
    sites: DataFrame

    def own(self, x: list[Column]) -> Column:
        """A document's own log odds."""
        logit = sum((c * float(w) for c, w in zip(x, self.weights[:-1], strict=True)), F.lit(float(self.weights[-1])))
        return F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))

    def join(self, rows: DataFrame, host: str, path: str) -> DataFrame:
        """`rows` with their sites' sums, as columns named _site_..."""
        few = self.sites.count() <= BROADCAST_SITES
        s = self.sites.select(*[F.col(c).alias(f"_site_{c}") for c in self.sites.columns])
        return rows.join(F.broadcast(s) if few else s, (rows[host] == s["_site_host"]) & (rows[path] == s["_site_path"]))

    def rates(self, p: Column) -> tuple[Column, Column]:
        """The host's and the path's rates without the row itself, whose own probability is p."""
        host = shrunk(F.col("_site_host_good") - p, F.col("_site_host_n") - 1, F.lit(self.base), self.k_host)
        return host, shrunk(F.col("_site_good") - p, F.col("_site_n") - 1, host, self.k_path)

    def shift(self, path_rate: Column) -> Column:
        return _logit(F.greatest(F.least(path_rate, F.lit(1 - 1e-6)), F.lit(1e-6))) - float(np.log(self.base / (1 - self.base)))

    def probability(self, own: Column, path_rate: Column) -> Column:
        return 1 / (1 + F.exp(-(own + self.trust * self.shift(path_rate))))


def learn(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Posterior:
    """The posterior's parameters from a table of doc_id, host, path and x (`features`) of every row, and the labels."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    few = table.join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    rows = few.groupBy("doc_id").agg(F.min(F.struct("x", "host", "path", "quality")).alias("r")).select("r.*").collect()
    rows = sorted(rows)  # the same order, and sums, at every run
    w = fit(np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in rows], dtype=float))

    first = Posterior(w, 0.5, float("inf"), float("inf"), 0.0, table)
    p = 1 / (1 + F.exp(-first.own([F.element_at("x", i + 1) for i in range(len(FEATURES))])))
    # Sums per path first, with partial sums in every task: a host with a third of the rows is as small as any.
    sites = materialise(table.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count("*").alias("n")), "sites")
    hosts = materialise(sites.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")), "hosts")
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    base = min(max(total["good"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    k_host = strength(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n")), F.lit(base))
    sites = materialise(sites.join(hosts, "host"), "site-sums")
    k_path = strength(sites, shrunk(F.col("host_good"), F.col("host_n"), F.lit(base), k_host))
    found = Posterior(w, base, k_host, k_path, 0.0, sites)
    if not rows or (k_host == float("inf") and k_path == float("inf")):
        return found
    spark = table.sparkSession
    labelled = spark.createDataFrame([(r["x"], r["host"], r["path"], r["quality"]) for r in rows], "x array<double>, host string, path string, quality int")
    own = found.own([F.element_at("x", i + 1) for i in range(len(FEATURES))])
    rate = found.rates(1 / (1 + F.exp(-F.col("own"))))[1]
    seen = found.join(labelled.withColumn("own", own), "host", "path").select("own", found.shift(rate).alias("shift"), "quality")
    a = np.array(sorted(tuple(r) for r in seen.collect()), dtype=float).reshape(-1, 3)
    return replace(found, trust=trust(*a.T))


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, own_probability, host_rate, path_rate, probability and kept for each row of `docs`.

    labels: doc_id, quality (0 or 1; rows with a null are skipped; of several for a doc_id the least counts). host and path
    are columns of `docs`, see `sites_of`. Nulls in them are sites of their own ('?'). The rates are those of the site's other
    rows. A null text counts as empty. Without labels every document's own probability is 0.5, and at 0.5 it is kept.
    Repeated rows come back as often as they are there; an empty table gives no rows.
    """
    host, path = sites_of(docs, host, path)
    rows = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    table = materialise(text_stats(rows, "host", "path").select("doc_id", "host", "path", F.array(*features()).alias("x")), "evidence")
    found = learn(table, labels, sample)
    own = table.select("doc_id", "host", "path", found.own([F.element_at("x", i + 1) for i in range(len(FEATURES))]).alias("own"))
    p = 1 / (1 + F.exp(-F.col("own")))
    host_rate, path_rate = found.rates(p)
    probability = found.probability(F.col("own"), path_rate)
    return found.join(own, "host", "path").select("doc_id", "host", "path", p.alias("own_probability"), host_rate.alias("host_rate"), path_rate.alias("path_rate"), probability.alias("probability"), (probability >= CUT).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that `score` keeps, with all its columns. What is learnt in a first pass over the texts is applied in a second
    one, row by row: texts are neither shuffled nor joined to verdicts."""
    host, path = sites_of(docs, host, path)
    rows = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    found = learn(materialise(text_stats(rows, "host", "path").select("doc_id", "host", "path", F.array(*features()).alias("x")), "evidence"), labels, sample)
    every = with_text_stats(docs.withColumns({"_site_of": host, "_path_of": path}), "_stat_")
    every = found.join(every.withColumn("_own", found.own(features("_stat_"))), "_site_of", "_path_of")
    rate = found.rates(1 / (1 + F.exp(-F.col("_own"))))[1]
    return every.filter(found.probability(F.col("_own"), rate) >= CUT).select(*[F.col(c) for c in docs.columns])


def op10_site_bayes(spark, sf_dir: str) -> DataFrame:
    """Every document's probability of being good, and verdict; see `score`."""
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
