"""Linkage operators: worked examples, properties, and side-by-side runs with DuckDB."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlake import queries as Q
from kinlake.functions import fuzzy
from kinlake.functions import text as T
from kinlake.operators import blocking, context, decide, learn, metrics
from kinlake.sources import views

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("E.U.R.L. Dupont", "eurl dupont"), ("ch0ice scho1arship", "choice scholarship"), ("2nd 2th 007 000", "2 2 7 0"), ("NULL A&B n/a", "a and b"), ("", ""), (None, "")],
)
def test_clean(spark, raw, want):
    assert one(spark, T.clean_tokens(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "raw, full, core",
    [("Acme Robotics Corp.", "acme robotics corporation", "acme robotics"), ("Starbucks Starbucks Coffee", "starbucks coffee", "starbucks coffee"), ("Private Limited", "private limited", "private limited")],
)
def test_norm_name(spark, raw, full, core):
    r = one(spark, T.norm_name(F.lit(raw)))
    assert (r["n_full"], r["n_core"]) == (full, core)


@pytest.mark.parametrize(
    "raw, want",
    [("123 Main St, NY", "123 main street ny"), ("500 Pine St, Suite 12B", "500 pine street"), ("Apt 4, 12 Rd", "apartment 4 12 road"), ("10 Broadway, New York", "10 broadway ny"), ("unit unit 5 Hill Ave", "5 hill avenue")],
)
def test_norm_address(spark, raw, want):
    assert one(spark, T.norm_address(F.lit(raw))) == want


def test_parts(spark):
    r = one(spark, T.postal_house(F.lit("12B Main St 12345-6789")))
    assert (r["postal"], r["house"]) == ("12345", "12b")
    assert one(spark, T.norm_name_suffix(F.lit("The Acme Co. Ltd"))) == "acme"
    r = one(spark, T.parse_address(F.lit("12 Rue X, 75001 Paris"), F.lit("France")))
    assert (r["postal"], r["city"]) == ("75", "75001 PARIS")
    assert one(spark, T.phone_suffix(F.lit("+1 (555) 123-4567"))) == "1234567"


def test_fuzzy():
    assert fuzzy.ratio("acme", "acne") == 75
    assert fuzzy.ratio("", "") == 100
    assert fuzzy.token_set_ratio("a b c", "c b") == 100
    assert fuzzy.token_sort_ratio("b a", "a b") == 100
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100
    vocabulary = {w: 10.0 for w in ("private", "yadav", "trading")}
    assert fuzzy.segment("privateyadavtradingcom", vocabulary) == "private yadav trading"
    assert fuzzy.segment("unknownword", vocabulary) == "unknownword"
    random.seed(0)
    for _ in range(300):
        a, b = ("".join(random.choice("abc ") for _ in range(random.randint(0, 9))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert fuzzy.lcs(a, b) == table[-1, -1]


def test_expected_f05_matches_enumeration():
    random.seed(1)
    for _ in range(60):
        p = np.array(sorted((random.random() for _ in range(random.randint(1, 7))), reverse=True))
        best, at = float(np.prod(1 - p)), 0
        for k in range(1, len(p) + 1):
            e = 0.0
            for y in itertools.product((0, 1), repeat=len(p)):
                tp, n = sum(y[:k]), sum(y)
                e += np.prod([q if v else 1 - q for q, v in zip(p, y)]) * (1.25 * tp / (k + 0.25 * n) if tp else 0)
            if e > best + 1e-12:
                best, at = e, k
        assert decide.best_prefix(p) == at


def test_claims(spark):
    pairs = spark.createDataFrame([(1, 9, 2, 0.9), (2, 9, 2, 0.6), (3, 9, 2, 0.2)], "i bigint, j bigint, src int, p double")
    rows = {r["i"]: r for r in context.competition(pairs).collect()}
    assert [(rows[i]["other"], rows[i]["rank"], rows[i]["sumo"], rows[i]["n"], rows[i]["margin"]) for i in (1, 2, 3)] == [(0.6, 1, 0.8, 3, 0.3), (0.9, 2, 1.1, 3, -0.3), (0.9, 3, 1.5, 3, -0.7)]
    by = lambda df: [r["p"] for r in df.orderBy("i").collect()]
    assert by(context.exclusivity(pairs)) == [0.9, 0.1, 0.1]
    assert by(context.exclusivity_symmetric(pairs)) == [0.4, 0.1, 0.1]
    assert by(context.one_to_one(pairs)) == [0.9, 0.0, 0.0]


def test_f05(spark):
    anchors = spark.createDataFrame([(k,) for k in range(6)], "i bigint")
    truth = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 1), (5, 1)], "i bigint, j bigint")
    predicted = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (4, 2), (5, 2)], "i bigint, j bigint")
    assert [r["f05"] for r in metrics.entity_f05(predicted, truth, anchors).orderBy("i").collect()] == [1.0, 0.0, 0.0, 0.833333, 0.555556, 0.0]
    assert metrics.macro_f05(truth, truth, anchors).first()["macro_f05"] == 1.0


def test_kept_quantile(spark):
    values = [round(random.Random(3).random(), 3) for _ in range(7)] + [0.5] * 50 + [k / 97 for k in range(97)]
    df = spark.createDataFrame([(float(v),) for v in values], "p double")
    for keep in (1.0, 0.998, 0.9, 0.5):
        assert metrics.kept_quantile(df, "p", keep).first()["threshold"] == sorted(values)[int((1 - keep) * len(values) + 1e-9)]


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S1-1", "a\tb", "", " us "), ("S1-1", "z", "y", "us"), ("", "no id", "", ""), ("S2-2", "", "NA", None)]
    views.write_tsv(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), str(tmp_path / "t"))
    back = {r["entity_id"]: tuple(r)[1:] for r in views.read_tsv(spark, str(tmp_path / "t")).collect()}
    assert back == {"S1-1": ("a b", "", "US"), "S2-2": ("", "NA", "")}


def test_caps_and_clusters(spark):
    pairs = spark.createDataFrame([(1, j, 2, j % 2, float(j)) for j in range(60)], "i bigint, j bigint, src int, fwd int, score double")
    kept = blocking.cap_candidates(pairs, 10, 3).collect()
    assert sorted(r["j"] for r in kept if r["fwd"]) == [51, 53, 55, 57, 59] and sorted(r["j"] for r in kept if not r["fwd"]) == [54, 56, 58]
    assert learn.clusters([("a", "b", 20), ("b", "c", 18), ("x", "y", 3)]) == {"b": "a", "c": "a"}


def test_stream(spark, tmp_path):
    from kinlake.streaming.incremental import match_stream

    spark.createDataFrame([(1, "blue bank"), (2, "red shop")], "id bigint, name string").write.parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame([(7, 2, "blue bank ltd"), (8, 2, "green")], "id bigint, src int, name string")
    arrivals = spark.readStream.schema("id bigint, name string").parquet(str(tmp_path / "in"))
    q = match_stream(arrivals, targets, T.words(F.col("name")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [(r["i"], r["j"], r["shared"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 7, 2)]


@pytest.mark.parametrize("name", ["norm_name", "norm_addr", "postal_house", "block_token_topk", "context_windows", "competition_features", "error_report", "validate_results", "jaro_winkler", "second_hop"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = Q.QUERIES[name](spark, DATA)
    r = con.execute(Q.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in x)) for x in rows)
    assert key(df.select(*names).collect()) == key(r.fetchall())


def test_entry_without_optional_parts(tmp_path):
    """The registry works when the optional subpackage and its pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "kinlake"), tmp_path / "kinlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_segment_words_by_the_whole_vocabulary(spark, tmp_path):
    """More than 50,000 words of equal counts; the glued words are of the last."""
    import itertools

    from kinlake.queries import QUERIES

    every = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnop", repeat=4), 50_100)]
    a, b = every[-1], every[-2]
    rows = [(k, f"{a}{b}. " + " ".join(every), "en", "s") for k in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["segmented"] for r in QUERIES["segment_words"](spark, str(tmp_path)).collect()} == {f"{a} {b}"}
