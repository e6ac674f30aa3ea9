"""Top lists of sparse vectors, against SQL and against the join of postings, and without any shuffle of pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlake import catalogue
from kinlake.operators import blocking, context, metrics, nearest, vectors
from kinlake.plans import candidates as plan
from kinlake.sources import scratch, views

DATA = "/root/testdata/sf0.001"
#: Queries that must not join postings into a table of pairs.
STREAMED = "candidate_cache best_threshold blocking_recall blocking_recall_by_country cap_candidates cap_blended context_rank_ties competition_features component_match block_cosine_addr block_token_topk block_cosine_comb block_cosine_v12_comb block_prerank block_reverse_addr block_reverse_topk block_token second_hop union_channels block_ngram block_ngram2 block_ngram_capped block_ngram_topk_distinct block_ngram_topk".split()

#: Queries over the candidates: the pairs' scores are not shuffled to make these.
UNSHUFFLED = "best_threshold blocking_recall blocking_recall_by_country cap_candidates cap_blended context_rank_ties competition_features component_match".split()


@pytest.mark.parametrize("name", STREAMED)
def test_no_pairs_are_shuffled(spark, monkeypatch, name):
    """The query gives its SQL's rows although nothing may join postings; several units a side."""
    def refuse(*a, **b):
        raise AssertionError("pairs in a shuffle")

    for module, f in ((vectors, "cosine"), (blocking, "overlap")):
        monkeypatch.setattr(module, f, refuse)
    monkeypatch.setattr(nearest, "UNIT", 7)
    got = catalogue.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_nearest_equals_the_join_of_postings(spark, monkeypatch):
    """Small steps on every side, ties, texts without features, a record against itself."""
    for k, v in (("UNIT", 5), ("WIDE", 2), ("ROWS", 3), ("PRODUCTS", 4)):
        monkeypatch.setattr(nearest, k, v)
    text = ["a b", "a b", "a b c", "c d", "", "d d a", "b c d", "e", "a e", "c c c"]
    rows = [(n, n % 3, text[n % 10], ["X", "Y"][n % 7 == 0]) for n in range(60)]
    r = spark.createDataFrame(rows, "id bigint, src int, name string, country string")
    words = F.filter(F.split("name", " "), lambda w: w != "")
    p = vectors.postings(r.withColumn("_f", words), "_f", 0.9)
    u = nearest.lay_out(r, [nearest.Channel("word", words, 0.9)], F.col("country"))
    for left, right, keep in (("anchors", "targets", "src = 0"), ("targets", "targets", "src > 0")):
        s = vectors.cosine(p.filter(keep), p.filter("src > 0")).filter("i <> j")
        want = blocking.top_k(s, ["i", "src"], 3).select("i", "j", "src", "score").collect()
        got = nearest.nearest(u, [("word", 3)], left, right).select("l", "r", "rsrc", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_candidates_equal_the_joined_ones(spark):
    e = views.entities(spark, DATA)
    post = {x: plan.posts(e, x) for x in ("char", "word", "addr")}
    want, got = plan.candidates(e, post=post), plan.candidates(e)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_features_are_packed():
    """Repeats, rows without any, unknown features, large steps: what is read back is what was written, in few bytes."""
    import pyarrow as pa

    keys = np.arange(0, 600_000, 2)
    rows = [[4, 4, 4, 0, 1], [], None, [599_998, 0, 20_000], [3], list(range(0, 2_000, 2))]
    packed = nearest._pack(pa.array(rows, pa.list_(pa.int64())), keys)
    f, tf, ends = nearest._unpack(packed)
    got = [list(zip(f[a:b].tolist(), tf[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
    assert got == [[(0, 1), (2, 3)], [], [], [(0, 1), (10_000, 1), (299_999, 1)], [], [(k, 1) for k in range(1_000)]]
    assert packed.nbytes < 2 * 1_100
    assert [len(x) for x in nearest._unpack(packed.slice(1, 2))] == [0, 0, 3] and nearest._unpack(packed.slice(3, 1))[0].tolist() == [0, 10_000, 299_999]


@pytest.mark.parametrize("name", UNSHUFFLED)
def test_scored_pairs_leave_their_tasks_without_a_shuffle(spark, monkeypatch, name):
    """The forward candidates are written by the tasks that score them; only ids are shuffled to tell which reverse ones are new."""
    plans, write = {}, plan.materialise

    def watched(df, table):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, table)

    monkeypatch.setattr(plan, "materialise", watched)
    catalogue.QUERIES[name](spark, DATA)
    assert "MapInArrow" in plans["forward"] and "Exchange" not in plans["forward"]
    assert all("s_char" not in x and "cc" not in x for x in plans["reverse"].split("\n") if "parquet" in x)


def test_sweep_counts_a_pair_once(spark):
    """However many thresholds a pair reaches, it is one row; equal to counting threshold by threshold."""
    p = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.35), (2, 12, 0.2), (2, 13, 0.5), (3, 14, None), (5, 10, 0.31)], "i bigint, j bigint, p double")
    t = spark.createDataFrame([(1, 10), (2, 12), (4, 15), (5, 10)], "i bigint, j bigint")
    a = spark.range(1, 7).withColumnRenamed("id", "i")
    grid = [0.3, 0.31, 0.5, 0.95]
    sweep = metrics.threshold_sweep(p, t, a, grid)
    want = {x: metrics.macro_f05(p.filter(F.col("p") >= x), t, a).first()["macro_f05"] for x in grid}
    assert {r["threshold"]: r["macro_f05"] for r in sweep.collect()} == want
    plan_text = sweep._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.index("Generate") < plan_text.index("Join")  # the thresholds multiply anchors' counts, above all joins of pairs


#: Queries over the candidates: of what makes these nothing stays behind, and no forward pair is shuffled, not even its ids.
TIDY = "blocking_recall blocking_recall_by_country cap_candidates cap_blended context_rank_ties competition_features component_match".split()


@pytest.mark.parametrize("name", TIDY)
def test_candidates_shuffle_no_forward_pair_and_clear_up(spark, monkeypatch, name):
    import os

    key, plans, dropped, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", {}, [], plan.materialise
    base = f"{scratch.shared_dir(spark)}/kinlake".removeprefix("file://")
    before, setting = set(os.listdir(base)) if os.path.isdir(base) else set(), spark.conf.get(key, "false")

    def watched(df, table):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        dropped.append(spark.conf.get(key))
        return write(df, table)

    monkeypatch.setattr(plan, "materialise", watched)
    catalogue.QUERIES[name](spark, DATA)
    assert all("Exchange" not in plans[x] for x in ("forward", "reverse"))
    assert dropped == ["true", "true"] and spark.conf.get(key, "false") == setting
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before}
    assert "forward" in left and not left & {"vectors", "char-vocabulary", "word-vocabulary", "addr-vocabulary", "dealt"}


@pytest.mark.parametrize("by", [None, ["country"]])
def test_recall_drops_other_candidates_before_the_shuffle(spark, by):
    """Repeated candidates and links, links without ids; only hits pass an exchange."""
    c = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 5), (None, 7), (8, 9)], "i bigint, j bigint")
    t = spark.createDataFrame([(1, 2, "X"), (1, 2, "X"), (4, 5, "Y"), (4, 6, "Y"), (None, 7, "Y")], "i bigint, j bigint, country string")
    got = metrics.recall(c, t, by)
    assert sorted(map(tuple, got.collect())) == ([("X", 2, 2, 1.0), ("Y", 3, 1, 0.333333)] if by else [(5, 3, 0.6)])
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in text and "BroadcastHashJoin" in text


def test_caps_limit_groups_before_the_shuffle(spark):
    """Equal to ranking all pairs, with ties and either cap the greater."""
    rng = np.random.default_rng(5)
    rows = [(int(i), int(j), int(rng.integers(0, 2)), int(rng.integers(0, 8)) / 8) for i in range(6) for j in rng.permutation(40)[: 5 + 7 * i]]
    p = spark.createDataFrame(rows, "i bigint, j bigint, fwd int, score double")
    for most, rev in ((10, 3), (2, 6), (5, 5)):
        want = []
        for i in range(6):
            mine = sorted((r for r in rows if r[0] == i), key=lambda r: (-r[3], r[1]))
            back = [r for r in mine if r[2] == 0]
            want += [r for r in mine[:most] if r[2] == 1] + back[:rev]
        got = blocking.cap_candidates(p, most, rev)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_postal_codes_meet_candidates_without_a_shuffle(spark):
    text = catalogue.QUERIES["component_match"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(i" not in text and "Exchange hashpartitioning(j" not in text


@pytest.mark.parametrize("held", [1, 2_000_000])
def test_frequencies_equal_a_grouped_count(spark, monkeypatch, held):
    """Repeats, empty and missing features, two groups, sums on the way; of words the shuffle holds nothing."""
    monkeypatch.setattr(nearest, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(g, n, None if k == 5 else [f"w{x}" for x in rng.integers(0, 40, k % 5 * 3)]) for g, n in (("X", 70), ("Y", 30)) for k in range(n)]
    r = spark.createDataFrame(rows, "_g string, n bigint, f array<string>")
    got = nearest._frequencies(r, F.col("f"))
    want = r.select("n", "_g", F.explode(F.array_distinct("f")).alias("x")).groupBy("n", F.xxhash64("_g", "x").alias("h")).agg(F.count("*").alias("df")).filter("df > 1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.index("Exchange") < text.rindex("MapInArrow") and "HashAggregate" not in text


def test_hashes_are_squeezed_and_two_features_of_one_hash_are_told():
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2))
    df, check = np.where(rng.random(len(h)) < 0.1, 300, 1), rng.integers(0, 128, len(h)).astype(np.uint8)
    data = nearest._squeeze(h, df, check)
    assert all((a == b).all() for a, b in zip(nearest._expand(data, len(h)), (h, df, check))) and len(data) < 9 * len(h)
    one = lambda k: (np.array([7], np.uint64), np.array([1]), np.array([k]))
    assert [x.tolist() for x in nearest._added([one(3), one(3)])] == [[7], [2], [3]]
    with pytest.raises(RuntimeError, match="two features"):
        nearest._added([one(3), one(4)])


def test_vectors_are_dealt_in_parts(spark, monkeypatch):
    """The same vectors whatever the number of parts; every part is a write of its own, filtered before features are made."""
    import os

    monkeypatch.setattr(nearest, "UNIT", 7)
    e, read = views.entities(spark, DATA), {}
    for part in (1, 1_000):
        monkeypatch.setattr(nearest, "PART", part)
        u = plan.units(e)
        read[part] = sorted(map(tuple, spark.read.parquet(u.path).collect()))
        writes = {x.split("-")[-1].split(".")[0] for _, _, names in os.walk(u.path.removeprefix("file://")) for x in names if x.endswith(".parquet")}
        assert read[part] and len(writes) == (nearest.PARTS if part == 1 else 1)
    assert read[1] == read[1_000] and len(read[1]) == e.filter("src IS NOT NULL AND country IS NOT NULL").count()


def _forward(spark, monkeypatch, name):
    """What the query's tasks write, and the query."""
    kept, write = {}, plan.materialise

    def watched(df, table):
        kept[table] = write(df, table)
        return kept[table]

    monkeypatch.setattr(plan, "materialise", watched)
    monkeypatch.setattr(nearest, "UNIT", 7)
    got = catalogue.QUERIES[name](spark, DATA)
    return kept["forward"], got


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]


def test_rank_ties_shuffle_pairs_once(spark, monkeypatch):
    """The anchors' ranks come from the tasks that have all their pairs; of the scores one is written, as a whole number."""
    forward, got = _forward(spark, monkeypatch, "context_rank_ties")
    assert dict(forward.dtypes) == {"i": "bigint", "j": "bigint", "cm": "int", "rk_cm": "int"}
    assert len(_exchanges(got)) == 1 and "hashpartitioning(j" in _exchanges(got)[0]


def test_ranks_in_tasks_are_those_of_a_window(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), int(j), int(rng.integers(0, 6))) for i in range(9) for j in range(5 * i)]
    p = spark.createDataFrame(rows, "i bigint, j bigint, cm int")
    want = context.context_ties(p)
    assert sorted(map(tuple, context.context_ties(nearest.ranked(p.repartition(3, "i"), "i", "cm", "rk_cm")).collect())) == sorted(map(tuple, want.collect()))


def test_competition_shuffles_whole_numbers_once(spark, monkeypatch):
    """Three columns are written and shuffled; their scores are the same doubles afterwards."""
    forward, got = _forward(spark, monkeypatch, "competition_features")
    assert dict(forward.dtypes) == {"i": "bigint", "j": "bigint", "m": "int"}
    assert len(_exchanges(got)) == 1 and "hashpartitioning(j" in _exchanges(got)[0]
    s = spark.range(1_000_001).select((F.col("id") / 1e6).alias("p")).withColumn("m", plan.millionths("p"))
    assert s.filter("m / 1e6 <> p").count() == 0


def test_recall_by_country_writes_links_alone(spark, monkeypatch):
    """Candidates that are no links end in their tasks, however many links there are."""
    forward, got = _forward(spark, monkeypatch, "blocking_recall_by_country")
    assert 0 < forward.count() == sum(r["n_found"] for r in got.collect())


def test_cap_blended_caps_inside_the_tasks(spark, monkeypatch):
    forward, got = _forward(spark, monkeypatch, "cap_blended")
    assert forward.count() == got.count() and forward.groupBy("i").count().agg(F.max("count")).first()[0] == 8
    assert not _exchanges(got)


def test_the_best_of_a_key_are_those_of_a_window(spark):
    """Ties, keys with fewer rows than places, no rows."""
    rng = np.random.default_rng(6)
    rows = [(int(i), int(j), int(rng.integers(0, 5)) / 4) for i in range(6) for j in rng.permutation(30)[: 7 * i]]
    p = spark.createDataFrame(rows, "i bigint, j bigint, score double").repartition(2, "i")
    for k in (1, 8):
        assert sorted(map(tuple, nearest.best_of(p, "i", "score", "j", k).collect())) == sorted(map(tuple, blocking.top_k(p, ["i"], k).select("i", "j", "score").collect()))
    assert nearest.best_of(p.filter("i > 9"), "i", "score", "j", 2).count() == 0


def test_lists_hold_every_shared_bit_once():
    """Copies on both sides, full, empty and odd rows; few rows and many; lists are no longer than LIST."""
    rng = np.random.default_rng(8)
    for n, width in ((1, 64), (7, 128), (40, 1024), (64, 4096)):
        table = rng.random((n, width)) < rng.random((n, 1))
        table[:, : width // 2] = table[:, rng.integers(0, 1 + width // 64, width // 2)]
        table[0], table[n // 2, :] = True, n > 1
        kinds = np.repeat(np.arange(n), rng.integers(1, 4, n))
        got = []
        for left, many, right, m in nearest._rectangles(np.packbits(table, axis=1, bitorder="little").view(np.uint64), kinds):
            assert len(many) == len(m) and m.max(initial=0) <= nearest.LIST
            a, b = np.cumsum(many) - many, np.cumsum(m) - m
            got += [(int(x), int(y)) for k in range(len(m)) for x in left[a[k] : a[k] + many[k]] for y in right[b[k] : b[k] + m[k]]]
        assert sorted(got) == list(zip(*(x.tolist() for x in np.nonzero(table[kinds])), strict=True))


def test_sharing_in_small_steps(spark, monkeypatch):
    """Kinds in several steps, features that only one side has, records without any, equal ones."""
    for k, v in (("UNIT", 30), ("WIDE", 2), ("BLOCK", 8), ("MAPS", 1), ("LIST", 8), ("LEVELS", ((8, 8),)), ("COMMON", 1)):
        monkeypatch.setattr(nearest, k, v)
    rng = np.random.default_rng(9)
    rows = [(n, n % 3, [] if n % 11 == 0 else [f"w{x}" for x in sorted(set(rng.integers(0, 25, 1 + n % 4).tolist()))] + ["anchors"] * (n % 3 == 0)) for n in range(300)]
    r = spark.createDataFrame(rows, "id bigint, src int, f array<string>")
    want = [(a, b) for a, s, f in rows if s == 0 for b, t, g in rows if t and set(f) & set(g)]
    assert sorted(map(tuple, nearest.sharing(nearest.lay_out(r, [nearest.Channel("f", F.col("f"))])).collect())) == want


#: Queries that return all pairs that share a feature, and bytes a pair; in the order of the records block_ngram took 0.95, block_ngram2 0.53.
ALL_PAIRS = [("block_ngram", 0.7), ("block_ngram2", 0.4)]


@pytest.mark.parametrize("name, most", ALL_PAIRS)
def test_all_pairs_take_few_bytes_a_pair(spark, tmp_path, name, most):
    """Tasks give lists, which become pairs, each once, as they are written."""
    got = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate explode") < text.index("MapInArrow")
    got.write.parquet(f"{tmp_path}/out")
    pairs = spark.read.parquet(f"{tmp_path}/out")
    assert pairs.count() == pairs.distinct().count() > 100_000
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < most * pairs.count()
