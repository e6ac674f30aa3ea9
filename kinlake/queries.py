"""Queries of the linkage operators over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake import sqlgen as S
from kinlake.functions import lexicon as L
from kinlake.functions import text as T
from kinlake.operators import blocking, context, decide, features, learn, metrics, nearest, vectors
from kinlake.plans import candidates as plan
from kinlake.registry import ORACLES, QUERIES, query  # noqa: F401
from kinlake.sources import scratch, views

def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values(items: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else S.q(v) if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in items)}) AS v({columns})"


# --- inline rows for what the tables have no example of -------------------------------------------------

NAMES = [
    (-1, "Acme Robotics Corp."), (-2, "Starbucks Starbucks Coffee"), (-3, "Private Limited"), (-4, "E.U.R.L. Dupont"), (-5, "ch0ice scho1arship"), (-6, "2nd 2th 007 000"), (-7, "NULL A&B n/a"),
    (-8, "The Acme Co. Ltd"), (-9, "fortunefinance.com"), (-10, "Müller & Söhne GmbH"), (-11, "A B C Traders Pvt Ltd"), (-12, "L'Oréal S.A."), (-13, ""), (-14, "Société Générale Ets Fils & Freres"), (-15, "Smt Shri Mfrs Hldgs Grp of the Centre"), (-16, "Acme + Sons Distr Engg dba Aka Univ Hosp Pv Ltda"),
]
ADDRESSES = [
    (-1, "123 Main St, NY"), (-2, "500 Pine St, Suite 12B"), (-3, "Apt 4, 12 Rd"), (-4, "10 Broadway, New York"), (-5, "Rue X 01234"), (-6, "12B Main St 12345-6789"), (-7, "Plot 5 MG Road Bengaluru Karnataka 560 001"),
    (-8, "unit unit 5 Hill Ave, West Virginia"), (-9, "Opp Post Office, N Hwy 7"), (-10, ""), (-11, "H No 4, Sec 9, Washington District of Columbia"), (-12, "प्लॉट 7, उत्तर प्रदेश 226001"), (-13, "Ste 5 Bld Saint Martin, Himachal Pradesh"), (-14, "12 Blk 4 Clny, Distt Pune, ஊர் தமிழ்நாடு"),
]
PLACES = [
    (1, "123 Main St, NY 10001-1234", "US"), (2, "1 MG Road, Karnataka, Bengaluru, 560001", "India"), (3, "12 Rue X, 75001 Paris", "France"), (4, "5 Elm, CA", "US"), (5, "somewhere", "India"), (6, "9 rue Y, 97400 Ville", "France"), (7, "x", "Peru"),
]
COUNTRIES = [(1, "USA"), (2, "United States"), (3, "u.s.a."), (4, "India"), (5, "FR"), (6, "Germany"), (7, "Narnia"), (8, ""), (9, "España")]
NATIVE = [(1, "ram शर्मा", "ram sharma"), (2, "शर्मा traders", "sharma traders"), (3, "शर्मा", "sarma"), (4, "दिल्ली foods", "delhi foods"), (5, "दिल्ली", "delhi"), (6, "क ख", "a"), (7, "plain", "plain")]
EQUIV = [("acme trading co", "acme traders co"), ("blue trading", "blue traders"), ("red trading hub", "red traders hub"), ("a 12 b", "a 13 b"), ("x y", "x z"), ("same", "same")]
CLAIMS = [(1, 100, 2, 0.9), (2, 100, 2, 0.6), (3, 100, 2, 0.2), (1, 101, 3, 0.4), (2, 102, 3, 0.55), (4, 103, 2, 0.5), (5, 103, 2, 0.5)]


def names_of(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text").unionByName(rows(spark, NAMES, "id bigint, text string"))


def addresses_of(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text").unionByName(rows(spark, ADDRESSES, "id bigint, text string"))


NAMES_SQL = f"n AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM {values(NAMES, 'id, text')})"
ADDR_SQL = f"n AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM {values(ADDRESSES, 'id, text')})"
CLEAN_SQL = f"t AS (SELECT id, {S.tokens(S.cleaned('text'))} AS t FROM n), c AS (SELECT id, {S.initials('t')} AS s FROM t)"
CLEAN_ADDR_SQL = f"t AS (SELECT id, {S.tokens(S.states(S.cleaned(S.native('text'))))} AS t FROM n), c AS (SELECT id, {S.initials('t')} AS s FROM t)"


# --- scans and sinks ---------------------------------------------------------------------------------------


@query(f"""SELECT 'S' || (CAST(substr(source, 4) AS INT) % 3 + 1) || '-' || doc_id AS entity_id, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS business_name,
 '' AS business_address, upper(trim(lang)) AS country FROM documents""")
def scan_source(spark, d):
    """Documents written as a tab-separated source table in the shared folder and scanned back; the address column is absent there."""
    from kinlake.sources.scratch import new_folder

    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = new_folder(spark, "source-tsv")
    views.write_tsv(docs.select(F.concat(F.lit("S"), views.role() + 1, F.lit("-"), F.col("doc_id")).alias("entity_id"), F.col("text").alias("business_name"), F.concat(F.lit(" "), "lang").alias("country")), path)
    return views.read_tsv(spark, path)


@query(f"WITH {S.RECORDS} SELECT i, j FROM truth")
def ground_truth_explode(spark, d):
    e, t = views.entities(spark, d), views.truth(spark, d)
    lists = t.groupBy("i").agg(F.concat(F.lit(" "), F.array_join(F.collect_list(F.col("j").cast("string")), ", "), F.lit(", ,nowhere")).alias("items"))
    left, right = e.filter("src = 0").select(F.col("id").alias("i")), e.filter("src > 0").select(F.col("id").cast("string").alias("j"))
    return views.explode_pairs(lists, "i", "items", left, right).select("i", F.col("j").cast("bigint").alias("j"))


@query(f"WITH {S.RECORDS} SELECT src, country, count(*) AS n, count(*) FILTER (name = '') AS no_name, count(*) FILTER (addr = '') AS no_addr FROM e GROUP BY ALL")
def profile_source(spark, d):
    return views.entities(spark, d).groupBy("src", "country").agg(F.count("*").alias("n"), F.count_if(F.col("name") == "").alias("no_name"), F.count_if(F.col("addr") == "").alias("no_addr"))


@query(f"WITH {S.RECORDS} SELECT n AS matches, count(*) AS anchors FROM (SELECT e.id, count(t.j) AS n FROM e LEFT JOIN truth t ON t.i = e.id WHERE src = 0 GROUP BY ALL) GROUP BY ALL")
def match_count_histogram(spark, d):
    e = views.entities(spark, d).filter("src = 0").select(F.col("id").alias("i"))
    n = views.truth(spark, d).groupBy("i").agg(F.count("*").alias("n"))
    return e.join(n, "i", "left").select(F.coalesce("n", F.lit(0)).alias("matches")).groupBy("matches").agg(F.count("*").alias("anchors"))


@query(f"WITH {S.CANDIDATES} SELECT e.id AS i, coalesce(string_agg(CAST(p.j AS VARCHAR), ',' ORDER BY CAST(p.j AS VARCHAR)), '') AS matched_entity_ids FROM e LEFT JOIN pairs p ON p.i = e.id AND p.p >= 0.3 WHERE e.src = 0 GROUP BY e.id")
def result_lists(spark, d):
    e = views.entities(spark, d)
    return decide.result_lists(plan.candidates(e).filter("p >= 0.3"), e.filter("src = 0").select(F.col("id").alias("i")))


@query(f"""WITH {S.CANDIDATES}, l AS (SELECT i, list(CAST(j AS VARCHAR) ORDER BY CAST(j AS VARCHAR)) AS x FROM pairs GROUP BY i)
SELECT i, array_to_string(x[1:3], ',') AS candidate_entity_ids FROM l""")
def limit_list(spark, d):
    e = views.entities(spark, d)
    p = plan.candidates(e)
    lists = decide.result_lists(p, p.select("i").distinct(), "candidate_entity_ids")
    return decide.limit_list(lists, "candidate_entity_ids", 3)


# --- normalisers -------------------------------------------------------------------------------------------


@query(f"WITH {NAMES_SQL} SELECT id, {S.fold('text')} AS folded FROM n")
def fold_ascii(spark, d):
    return names_of(spark, d).select("id", T.fold_ascii(F.col("text")).alias("folded"))


@query(f"WITH {NAMES_SQL}, {CLEAN_SQL} SELECT id, s AS cleaned FROM c")
def clean_tokens(spark, d):
    return names_of(spark, d).select("id", T.clean_tokens(F.col("text")).alias("cleaned"))


@query(f"WITH {NAMES_SQL}, t AS (SELECT id, string_split({S.plain('text')}, ' ') AS t FROM n) SELECT id, {S.initials('t')} AS collapsed FROM t")
def collapse_initials(spark, d):
    return names_of(spark, d).select("id", T.collapse_initials(F.trim(F.regexp_replace(T.fold_ascii(F.col("text")), "[^a-z0-9]+", " "))).alias("collapsed"))


@query(f"""WITH {NAMES_SQL}, {CLEAN_SQL}, m AS (SELECT id, list_transform({S.word_list('s')}, lambda t: {S.mapped(L.NAME_WORDS, 't')}) AS m FROM c),
x AS (SELECT id, unnest(m) AS w, generate_subscripts(m, 1) AS pos FROM m), f AS (SELECT id, w, min(pos) AS pos FROM x GROUP BY ALL),
g AS (SELECT id, string_agg(w, ' ' ORDER BY pos) AS n_full, string_agg(w, ' ' ORDER BY pos) FILTER (w NOT IN {S.strings(L.LEGAL_WORDS)}) AS core FROM f GROUP BY id)
SELECT n.id, coalesce(n_full, '') AS n_full, coalesce(core, n_full, '') AS n_core FROM n LEFT JOIN g USING (id)""")
def norm_name(spark, d):
    return names_of(spark, d).select("id", T.norm_name(F.col("text")).alias("r")).select("id", "r.n_full", "r.n_core")


_SUFFIX = f"list_filter(list_transform(s, lambda t: {S.mapped(L.SUFFIX_NAME_WORDS, 't')}), lambda t: t NOT IN ('dba', 'aka', ''))"


@query(f"""WITH {NAMES_SQL}, t AS (SELECT id, string_split({S.plain("replace(replace(replace(" + S.fold('text') + ", '&', ' and '), '+', ' and '), '''', '')")}, ' ') AS t FROM n),
c AS (SELECT id, string_split({S.initials('t')}, ' ') AS s FROM t), m AS (SELECT id, {_SUFFIX} AS m FROM c),
h AS (SELECT id, CASE WHEN len(m) > 1 AND m[1] = 'the' THEN m[2:] ELSE m END AS m FROM m),
k AS (SELECT id, m, coalesce(list_max(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i] NOT IN {S.strings(L.LEGAL_TAIL)} THEN i ELSE 0 END)), 0) AS last FROM h)
SELECT id, array_to_string(m[1:greatest(last, 1)], ' ') AS core FROM k""")
def norm_name_suffix(spark, d):
    return names_of(spark, d).select("id", T.norm_name_suffix(F.col("text")).alias("core"))


def _basic_sql() -> str:
    out = f"trim(regexp_replace(regexp_replace({S.fold('text')}, '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    for a, b in L.BASIC_SUFFIXES.items():
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return out


@query(f"WITH {NAMES_SQL} SELECT id, {_basic_sql()} AS normalised FROM n")
def norm_name_basic(spark, d):
    return names_of(spark, d).select("id", T.norm_name_basic(F.col("text")).alias("normalised"))


@query(f"""WITH n AS (SELECT page_id AS id, url AS text FROM pages UNION ALL SELECT * FROM {values(NAMES + [(-20, 'शर्मा foods')], 'id, text')}), l AS (SELECT *, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS letters FROM n)
SELECT id, CASE WHEN letters = '' THEN 0.0::DOUBLE ELSE len(list_filter(string_split(letters, ''), lambda c: ord(c) > 591)) / length(letters)::DOUBLE END AS nat,
 CAST(contains(lower(text), '.com') OR contains(lower(text), 'www') OR (length(text) > 12 AND NOT contains(text, ' ')) AS INT) AS dom FROM l""")
def name_flags(spark, d):
    n = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").alias("text")).unionByName(rows(spark, [*NAMES, (-20, "शर्मा foods")], "id bigint, text string"))
    return n.select("id", T.name_flags(F.col("text")).alias("r")).select("id", "r.nat", "r.dom")


@query(f"""WITH {S.RECORDS} SELECT id, coalesce({S.word_list('name')}[1], '') AS first, replace(name, ' ', '') AS compact,
 CASE WHEN len({S.word_list('name')}) > 1 THEN array_to_string(list_transform({S.word_list('name')}, lambda w: w[1]), '') ELSE '' END AS acro, len({S.word_list('name')}) AS ntok FROM e""")
def name_derived(spark, d):
    return views.entities(spark, d).select("id", T.name_derived(F.col("name")).alias("r")).select("id", "r.*")


@query(f"WITH {NAMES_SQL} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all({S.fold('text')}, '[\\p{{L}}\\p{{N}}]+'))), ' ') AS tokens FROM n")
def token_set(spark, d):
    return names_of(spark, d).select("id", F.array_join(T.token_set(F.col("text")), " ").alias("tokens"))


_UNITS = "|".join(k for k, v in L.ADDRESS_WORDS.items() if v == "unit")
_PLAIN_WORDS = {k: v for k, v in L.ADDRESS_WORDS.items() if v != "unit"}


@query(f"""WITH {ADDR_SQL}, {CLEAN_ADDR_SQL}, p AS (SELECT id, regexp_replace(' ' || replace(s, ' ', '  ') || ' ', ' ({_UNITS}) (?: [^ ]{{1,5}} )?', '', 'g') AS s FROM c),
m AS (SELECT id, list_transform({S.word_list('s')}, lambda t: {S.mapped(_PLAIN_WORDS, 't')}) AS m FROM p)
SELECT id, array_to_string(list_filter(m, lambda t: t NOT IN {S.strings(L.ADDRESS_DROP)}), ' ') AS a_norm FROM m""")
def norm_addr(spark, d):
    return addresses_of(spark, d).select("id", T.norm_address(F.col("text")).alias("a_norm"))


@query(f"WITH {ADDR_SQL} SELECT id, {S.states(S.cleaned('text'))} AS coded FROM n")
def state_codes(spark, d):
    return addresses_of(spark, d).select("id", T.state_codes(T._cleaned(F.col("text"))).alias("coded"))


@query(f"""WITH {ADDR_SQL}, a AS (SELECT id, {S.plain("regexp_replace(lower(text), '([0-9]{5})-[0-9]{4}', '\\1', 'g')")} AS s FROM n),
b AS (SELECT id, trim(regexp_replace(' ' || s || ' ', ' ([0-9]{{3}}) ([0-9]{{3}}) ', ' \\1\\2 ', 'g')) AS s FROM a),
m AS (SELECT id, list_transform({S.word_list('s')}, lambda t: {S.mapped(L.SUFFIX_ADDRESS_WORDS, 't')}) AS m FROM b),
p AS (SELECT id, m, coalesce(list_filter(m, lambda t: regexp_matches(t, '^[0-9]{{5,6}}$'))[-1], '') AS postal FROM m)
SELECT id, array_to_string(m, ' ') AS anorm, postal, coalesce(list_filter(m, lambda t: length(t) <= 5 AND regexp_matches(t, '^[0-9]+[a-z]?$') AND t <> postal)[1], '') AS house FROM p""")
def postal_house(spark, d):
    return addresses_of(spark, d).select("id", T.postal_house(F.col("text")).alias("r")).select("id", "r.*")


_CODES = "|".join(sorted({v.upper() for v in L.STATES.values()}))


@query(f"""WITH p AS (SELECT id, upper(address) AS u, address, lower(country) AS c, list_transform(string_split(upper(address), ','), lambda x: trim(x)) AS parts FROM {values(PLACES, 'id, address, country')})
SELECT id, CASE WHEN c = 'india' THEN nullif(regexp_extract(address, '\\b([0-9]{{6}})\\b', 1), '') END AS pin, CASE WHEN c = 'us' THEN nullif(regexp_extract(address, '\\b([0-9]{{5}})(-[0-9]{{4}})?\\b', 1), '') END AS zip,
 CASE WHEN c = 'france' THEN nullif(regexp_extract(address, '\\b(0[1-9]|[1-8][0-9]|9[0-5])[0-9]{{3}}\\b', 1), '') END AS postal,
 CASE WHEN c = 'india' AND len(parts) >= 2 THEN parts[-2] WHEN c = 'france' THEN parts[-1] END AS city,
 CASE WHEN c = 'india' AND len(parts) >= 3 THEN parts[-3] WHEN c = 'us' THEN nullif(regexp_extract(u, '\\b({_CODES})\\b', 1), '') END AS state FROM p""")
def parse_address(spark, d):
    return rows(spark, PLACES, "id int, address string, country string").select("id", T.parse_address(F.col("address"), F.col("country")).alias("r")).select("id", "r.*")


@query(f"WITH a AS (SELECT *, trim(regexp_replace({S.fold('name')}, '[^a-z]+', ' ', 'g')) AS k FROM {values(COUNTRIES, 'id, name')}) SELECT id, {S.mapped(L.COUNTRIES, 'k')} AS code FROM a")
def country_alias(spark, d):
    return rows(spark, COUNTRIES, "id int, name string").select("id", T.country_alias(F.col("name")).alias("code"))


# --- blocking ------------------------------------------------------------------------------------------------

_BLOCK_WORDS = "list_distinct(list_filter(string_split(name, ' '), lambda w: length(w) > 1))"
_SHARED = lambda f: f"a AS (SELECT id AS i, unnest({f}) AS f FROM e WHERE src = 0), b AS (SELECT id AS j, src, unnest(list_distinct({f})) AS f FROM e WHERE src > 0), s AS (SELECT i, j, src, count(*) AS score FROM a JOIN b USING (f) GROUP BY ALL)"


def _sides(spark, d):
    e = views.entities(spark, d)
    return e.filter("src = 0"), e.filter("src > 0")


def _units(spark, d, features):
    """The documents' features as counts, without regard to countries."""
    return nearest.lay_out(views.entities(spark, d), [nearest.Channel("shared", features)])


def _most_shared(units, k, by_src=False):
    return nearest.nearest(units, [("shared", k)], by_src=by_src).select(F.col("l").alias("i"), F.col("r").alias("j"), F.col("rsrc").alias("src"), F.col("score").cast("bigint").alias("shared")).drop(*["src"] * (not by_src))


def _block_words():
    return F.array_distinct(F.filter(T.words(F.col("name")), lambda w: F.length(w) > 1))


@query(f"WITH {S.RECORDS}, {_SHARED(_BLOCK_WORDS)} SELECT i, j FROM s")
def block_token(spark, d):
    return nearest.sharing(_units(spark, d, _block_words()))


_GRAMS3 = f"list_distinct({S.char_ngrams('name', 3)})"


@query(f"WITH {S.RECORDS}, {_SHARED(_GRAMS3)} SELECT i, j FROM s")
def block_ngram(spark, d):
    return nearest.sharing(_units(spark, d, T.char_ngrams(F.col("name"), 3)))


@query(f"WITH {S.RECORDS}, {_SHARED(_BLOCK_WORDS)} SELECT i, j, score AS shared FROM ({S.top('s', 'i', 50)})")
def block_token_topk(spark, d):
    return _most_shared(_units(spark, d, _block_words()), 50)


@query(f"WITH {S.RECORDS}, {_SHARED(S.char_ngrams('name', 3))} SELECT i, j, score AS shared FROM ({S.top('s', 'i', 10)})")
def block_ngram_topk(spark, d):
    """Repeats on the anchor's side count."""
    return _most_shared(_units(spark, d, T.char_ngrams(F.col("name"), 3, False)), 10)


@query(f"""WITH {S.RECORDS}, p AS (SELECT id, src, f FROM (SELECT id, src, unnest({_BLOCK_WORDS}) AS f FROM e WHERE src > 0) QUALIFY row_number() OVER (PARTITION BY f ORDER BY id) <= 500),
a AS (SELECT id AS i, unnest({_BLOCK_WORDS}) AS f FROM e WHERE src = 0), s AS (SELECT i, p.id AS j, p.src, count(*) AS score FROM a JOIN p USING (f) GROUP BY ALL)
SELECT i, j, src, score AS shared FROM ({S.top('s', 'i, src', 5)})""")
def block_token_capped(spark, d):
    a, b = _sides(spark, d)
    b = blocking.capped(b, _block_words(), 500)
    return blocking.top_k(blocking.overlap(a.withColumn("features", _block_words()), b, F.col("features")), ["i", "src"], 5, "shared").select("i", "j", "src", "shared")


@query(f"WITH {S.CHANNELS} SELECT i, j, src, score FROM ({S.top('s_char', 'i, src', 10)})")
def block_cosine_char(spark, d):
    return blocking.top_k(plan.scores(views.entities(spark, d), channels=("char",))["char"], ["i", "src"], 10).select("i", "j", "src", "score")


@query(f"WITH {S.CHANNELS} SELECT i, j, src, score FROM ({S.top('s_comb', 'i, src', 12)})")
def block_cosine_comb(spark, d):
    return plan.forward(plan.units(views.entities(spark, d), channels=("word", "addr")), [("joint", 12)]).select("i", "j", "src", "score")


@query(f"WITH {S.CHANNELS} SELECT i, j, src, score FROM ({S.top('s_addr', 'i, src', 6)})")
def block_cosine_addr(spark, d):
    return plan.forward(plan.units(views.entities(spark, d), channels=("addr",)), [("addr", 6)]).select("i", "j", "src", "score")


@query(f"WITH {S.CHANNELS} SELECT i, j, src, score FROM ({S.top('s_comb', 'j', 3)})")
def block_reverse_topk(spark, d):
    return plan.reverse(plan.units(views.entities(spark, d), channels=("word", "addr")), [("joint", 3)]).select("i", "j", "src", "score")


_V12 = f"list_concat(list_transform({S.word_list('name')}, lambda w: 'w' || w), list_transform(range(1, length('#' || replace(name, ' ', '') || '#') - 2), lambda k: 'c' || substr('#' || replace(name, ' ', '') || '#', k, 4)))"


@query(f"WITH {S.RECORDS}, {S.channel('v', _V12, 0.002, 60)} SELECT i, j, src, score FROM ({S.top('(SELECT * FROM s_v WHERE score >= 0.1)', 'i, src', 10)})")
def block_cosine_v12(spark, d):
    compact = F.concat(F.lit("#"), F.replace("name", F.lit(" "), F.lit("")), F.lit("#"))
    feats = F.concat(F.transform(T.words(F.col("name")), lambda w: F.concat(F.lit("w"), w)), F.transform(T.char_ngrams(compact, 4, False), lambda g: F.concat(F.lit("c"), g)))
    p = vectors.postings(views.entities(spark, d).withColumn("_f", feats), "_f", 0.002, 60)
    s = vectors.cosine(p.filter("src = 0"), p.filter("src > 0")).filter("score >= 0.1")
    return blocking.top_k(s, ["i", "src"], 10).select("i", "j", "src", "score")


@query(f"""WITH {S.RECORDS}, x AS (SELECT id, src, name, {S.word_list('name')} AS t, replace(name, ' ', '') AS c, coalesce(regexp_extract_all(addr, '\\b[0-9]{{5,6}}\\b')[-1], '') AS postal FROM e),
k AS (SELECT DISTINCT id, src, k FROM (SELECT id, src, 'k1:' || name AS k FROM x WHERE length(name) >= 3 UNION ALL SELECT id, src, 'k2:' || c FROM x WHERE length(c) >= 4
 UNION ALL SELECT id, src, 'k3:' || array_to_string(list_sort(t), ' ') FROM x WHERE len(t) >= 2 UNION ALL SELECT id, src, 'k4:' || t[1] || '|' || postal FROM x WHERE length(t[1]) >= 3 AND postal <> '')),
r AS (SELECT k FROM k WHERE src > 0 GROUP BY k HAVING count(*) <= 50)
SELECT DISTINCT a.id AS i, b.id AS j FROM k a JOIN r USING (k) JOIN k b USING (k) WHERE a.src = 0 AND b.src > 0""")
def block_exact_keys(spark, d):
    e = views.entities(spark, d).withColumn("postal", F.coalesce(F.get(F.reverse(F.regexp_extract_all("addr", F.lit(r"\b[0-9]{5,6}\b"), F.lit(0))), F.lit(0)), F.lit("")))
    return blocking.exact_keys(e.filter("src = 0"), e.filter("src > 0"))


@query(f"""WITH {S.CHANNELS}, p AS (SELECT i, j, score FROM ({S.top('s_comb', 'i, src', 12)})),
tt AS (SELECT a.id AS i, b.id AS j, round(sum(a.w * b.w), 6) AS score FROM w_word a JOIN w_word b USING (country, f) WHERE a.src > 0 AND b.src > 0 AND a.id <> b.id GROUP BY ALL),
an AS (SELECT i, j AS a, score AS s1 FROM ({S.top('(SELECT * FROM p WHERE score >= 0.3)', 'i', 2)})), nn AS (SELECT i AS a, j, score AS s2 FROM ({S.top('tt', 'i', 5)})),
h AS (SELECT i, j, round(max(s1 * s2), 6) AS score FROM an JOIN nn USING (a) GROUP BY ALL),
ok AS (SELECT h.* FROM h JOIN e x ON x.id = h.i JOIN e y ON y.id = h.j WHERE x.country = y.country AND NOT EXISTS (SELECT 1 FROM p WHERE p.i = h.i AND p.j = h.j))
SELECT i, j, score FROM ({S.top('ok', 'i', 10)})""")
def second_hop(spark, d):
    e = views.entities(spark, d)
    u = plan.units(e, channels=("word", "addr"))
    p = scratch.materialise(plan.forward(u, [("joint", 12)]).select("i", "j", "score"), "forward")
    near = nearest.nearest(plan.units(e, channels=("word",)), [("word", 5)], "targets", "targets", False)
    return blocking.second_hop(p, near.select(F.col("l").alias("i"), F.col("r").alias("j"), "score"), e.select("id", "country"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), n AS (SELECT id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM v),
s AS (SELECT a.id AS i, b.id AS j, round(list_dot_product(a.x, b.x), 6) AS score FROM n a, n b WHERE a.id % 50 = 0 AND a.id <> b.id)
SELECT i, j, score FROM s WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, j) <= 100""")
def embedding_topk(spark, d):
    """The stated query set (every vector whose id is divisible by 50) against all vectors."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return blocking.embedding_top_k(e.filter("id % 50 = 0"), e, 101).filter("i <> j").transform(lambda s: blocking.top_k(s, ["i"], 100)).select("i", "j", "score")


@query(f"WITH {S.CHANNELS} SELECT country, id, src, f AS feature, round(w, 6) AS w FROM w_word")
def tfidf_weights(spark, d):
    return plan.posts(views.entities(spark, d), "word").withColumn("w", F.round("w", 6))


@query(f"WITH {S.RECORDS}, t AS (SELECT id, unnest(list_distinct({S.word_list('name')})) AS token FROM e) SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM e) / count(*)::DOUBLE), 6) AS idf FROM t GROUP BY token")
def token_idf(spark, d):
    return vectors.idf_weights(views.entities(spark, d).withColumn("t", T.words(F.col("name"))), "t").withColumn("idf", F.round("idf", 6))


@query(f"WITH {S.CHANNELS}, u AS (SELECT i, j, 1 AS fwd FROM ({S.top('s_char', 'i, src', 10)}) UNION ALL SELECT i, j, 0 FROM ({S.top('s_comb', 'j', 3)})) SELECT i, j, max(fwd) AS fwd FROM u GROUP BY ALL")
def union_channels(spark, d):
    e = views.entities(spark, d)
    f, r = plan.forward(plan.units(e, channels=("char",)), [("char", 10)]), plan.reverse(plan.units(e, channels=("word", "addr")), [("joint", 3)])
    return blocking.union_channels([(f, 1), (r, 0)])


@query(f"""WITH {S.CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cm DESC, j) AS rk, row_number() OVER (PARTITION BY i, fwd ORDER BY cm DESC, j) AS rrk FROM pairs)
SELECT i, j, fwd, cm FROM r WHERE (fwd = 1 AND rk <= 12) OR (fwd = 0 AND rrk <= 4)""")
def cap_candidates(spark, d):
    p = plan.candidates(views.entities(spark, d)).withColumn("score", F.col("cm"))
    return blocking.cap_candidates(p, 12, 4).select("i", "j", "fwd", "cm")


# --- windows -------------------------------------------------------------------------------------------------

_RK = lambda by, s, tie, p: f"row_number() OVER (PARTITION BY {by} ORDER BY {s} DESC, {tie}) AS {p}rk_{s}, round(max({s}) OVER (PARTITION BY {by}) - {s}, 6) AS {p}gap_{s}"
_CMA = ("cc", "cm", "ca")


@query(f"WITH {S.CANDIDATES} SELECT *, {', '.join(_RK('i', s, 'j', '') for s in _CMA)}, count(*) OVER (PARTITION BY i) AS n_cand, row_number() OVER (PARTITION BY i, src ORDER BY cm DESC, j) AS rk_cm_src FROM pairs")
def context_windows(spark, d):
    return context.context(plan.candidates(views.entities(spark, d)))


@query(f"WITH {S.CANDIDATES} SELECT *, {', '.join(_RK('j', s, 'i', 'rev_') for s in _CMA)}, count(*) OVER (PARTITION BY j) AS rev_n FROM pairs")
def reverse_context_windows(spark, d):
    return context.reverse_context(plan.candidates(views.entities(spark, d)))


@query(f"WITH {S.CANDIDATES} SELECT i, j, rank() OVER (PARTITION BY i ORDER BY cm DESC) AS rk_cm, rank() OVER (PARTITION BY j ORDER BY cm DESC) AS rev_rk_cm FROM pairs")
def context_rank_ties(spark, d):
    near = lambda p: nearest.ranked(p.select("i", "j", plan.millionths("cm").alias("cm")), "i", "cm", "rk_cm")
    return context.context_ties(plan.candidates(views.entities(spark, d), shape=near))


@query(f"""WITH {S.CANDIDATES}, s AS (SELECT *, round(0.6::DOUBLE * cc + 0.4::DOUBLE * ca, 6) AS sim FROM pairs)
SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r_sim, row_number() OVER (PARTITION BY i ORDER BY cc DESC, j) AS r_cn, max(sim) OVER (PARTITION BY i) AS max_sim,
 round(max(sim) OVER (PARTITION BY i) - sim, 6) AS gap_sim, count(*) OVER (PARTITION BY i) AS n_c, row_number() OVER (PARTITION BY i, src ORDER BY sim DESC, j) AS r_sim_src, count(*) OVER (PARTITION BY i, src) AS n_c_src,
 row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) AS rev_r, count(*) OVER (PARTITION BY j) AS rev_n, round(max(sim) OVER (PARTITION BY j) - sim, 6) AS rev_gap FROM s""")
def context_v12(spark, d):
    return context.blended_context(plan.candidates(views.entities(spark, d)))


def _claims(spark, d):
    """Candidates and the inline claims."""
    p = plan.candidates(views.entities(spark, d)).select("i", "j", "src", "p")
    return p.unionByName(rows(spark, [(-i, -j, s, p) for i, j, s, p in CLAIMS], "i bigint, j bigint, src int, p double"))


_CLAIMS = f"{S.CANDIDATES}, c AS (SELECT i, j, src, p FROM pairs UNION ALL SELECT -i, -j, src, p::DOUBLE FROM {values(CLAIMS, 'i, j, src, p')})"
_BEST = lambda key, tie: f"SELECT *, row_number() OVER w AS rn, first_value(p) OVER w AS best, coalesce(nth_value(p, 2) OVER w, 0) AS second FROM c WINDOW w AS (PARTITION BY {key} ORDER BY p DESC, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"""WITH {_CLAIMS}, r AS ({_BEST('i', 'j')})
SELECT i, j, rn AS rk, round(best - p, 6) AS gap, round(sum(p) OVER (PARTITION BY i), 6) AS total, CAST(sum(CAST(p > 0.5 AS INT)) OVER (PARTITION BY i) AS BIGINT) AS n_half, CASE WHEN rn = 1 THEN second ELSE best END AS other,
 count(*) OVER (PARTITION BY i) AS n, row_number() OVER (PARTITION BY i, src ORDER BY p DESC, j) AS rk_src, count(*) OVER (PARTITION BY i, src) AS n_src FROM r""")
def stage2_group_stats(spark, d):
    return context.group_stats(_claims(spark, d))


@query(f"""WITH {_CLAIMS}, r AS ({_BEST('j', 'i')}), o AS (SELECT *, CASE WHEN rn = 1 THEN second ELSE best END AS other FROM r)
SELECT i, j, p, other, rn AS rank, round(sum(p) OVER (PARTITION BY j) - p, 6) AS sumo, count(*) OVER (PARTITION BY j) AS n, round(p - other, 6) AS margin FROM o""")
def competition_features(spark, d):
    p = plan.candidates(views.entities(spark, d), shape=lambda p: p.select("i", "j", plan.millionths("cm").alias("m")))
    claims = p.unionByName(rows(spark, [(-i, -j, round(p * 1e6)) for i, j, _, p in CLAIMS], "i bigint, j bigint, m int"))
    return context.competition(claims.repartition("j").select("i", "j", (F.col("m") / 1e6).alias("p")))  # whole numbers are shuffled


@query(f"WITH {_CLAIMS}, r AS ({_BEST('j', 'i')}) SELECT i, j, CASE WHEN rn = 1 THEN p ELSE round(least(p, 1 - best), 6) END AS p FROM r")
def exclusivity(spark, d):
    return context.exclusivity(_claims(spark, d))


@query(f"WITH {_CLAIMS}, r AS ({_BEST('j', 'i')}) SELECT i, j, round(least(p, 1 - CASE WHEN rn = 1 THEN second ELSE best END), 6) AS p FROM r")
def exclusivity_symmetric(spark, d):
    return context.exclusivity_symmetric(_claims(spark, d))


@query(f"WITH {_CLAIMS} SELECT i, j, CASE WHEN p = max(p) OVER (PARTITION BY j) THEN p ELSE 0 END AS p FROM c")
def one_to_one(spark, d):
    return context.one_to_one(_claims(spark, d))


# --- decisions and metrics -----------------------------------------------------------------------------------


@query(f"WITH {_CLAIMS} SELECT i, j, p FROM c QUALIFY p >= 0.1 AND row_number() OVER (PARTITION BY i ORDER BY p DESC, j) <= 15")
def prune_mask(spark, d):
    return decide.prune(_claims(spark, d), 0.1)


@query(f"WITH {_CLAIMS}, r AS (SELECT p, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS n FROM c) SELECT p AS threshold FROM r WHERE rn = floor((1.0::DOUBLE - 0.9::DOUBLE) * n + 1e-9) + 1")
def prune_threshold(spark, d):
    return metrics.kept_quantile(_claims(spark, d), "p", 0.9)


@query(f"WITH {S.CANDIDATES} SELECT i, j, CASE WHEN abs(p) IS NULL THEN NULL ELSE round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) END AS logit FROM pairs")
def logit_clip(spark, d):
    return plan.candidates(views.entities(spark, d)).select("i", "j", F.round(decide.logit(F.col("p")), 6).alias("logit"))


@query(f"""WITH {_CLAIMS}, s AS (SELECT i, j, p, count(*) OVER w AS k, sum(p) OVER w AS sk, sum(p) OVER (PARTITION BY i) AS s, sum(ln(greatest(1 - p, 1e-12))) OVER (PARTITION BY i) AS none
 FROM (SELECT i, j, least(p, 1) AS p, p AS o FROM c WHERE p >= 0.02) WINDOW w AS (PARTITION BY i ORDER BY o DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, round(1.25::DOUBLE * sk / (k + 0.25::DOUBLE * s), 9) AS f FROM s), b AS (SELECT *, max(f) OVER (PARTITION BY i) AS best FROM f),
x AS (SELECT *, min(CASE WHEN f = best THEN k END) OVER (PARTITION BY i) AS cut FROM b) SELECT i, j FROM x WHERE k <= cut AND best > exp(none)""")
def expected_f05_ratio(spark, d):
    return decide.expected_f05_ratio(_claims(spark, d))


@query()
def expected_f05_exact(spark, d):
    return decide.expected_f05_exact(decide.prune(_claims(spark, d), 0.02))


@query(f"""WITH {S.CANDIDATES}, t AS (SELECT i, j, p AS score, CASE x.country WHEN 'FR' THEN 0.42 WHEN 'ES' THEN 0.55 ELSE 0.5 END AS t FROM pairs JOIN e x ON x.id = i)
SELECT i, j, score FROM t WHERE score >= t QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, j) <= 5""")
def pick_threshold_topk(spark, d):
    e = views.entities(spark, d)
    p = plan.candidates(e).join(e.select(F.col("id").alias("i"), "country"), "i").withColumn("score", F.col("p"))
    return decide.threshold_top_k(p, {"FR": 0.42, "ES": 0.55}, 0.5, 5)


@query(f"""WITH {S.CANDIDATES}, r AS (SELECT i, j, src, row_number() OVER (PARTITION BY i, src ORDER BY p DESC, j) AS rk FROM pairs WHERE p > 0), x AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY src, rk) AS place FROM r WHERE rk <= 3) SELECT * FROM x WHERE place <= 5""")
def pick_per_source_topk(spark, d):
    return decide.per_source_top_k(plan.candidates(views.entities(spark, d)).withColumn("score", F.col("p")))


_SETF = f"""f AS (SELECT i, j, list_distinct({S.word_list('x.name')}) AS a, list_distinct({S.word_list('y.name')}) AS b, list_distinct({S.word_list('x.addr')}) AS c, list_distinct({S.word_list('y.addr')}) AS d, x.country = y.country AS same, length(x.name) AS l1, length(y.name) AS l2,
 x.name AS n1, y.name AS n2 FROM pairs JOIN e x ON x.id = i JOIN e y ON y.id = j)"""
_JAC = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"
_CON = lambda a, b: f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b}))::DOUBLE END"


@query(f"""WITH {S.CANDIDATES}, {_SETF} SELECT i, j, 0.55::DOUBLE * {_JAC('a', 'b')} + 0.30::DOUBLE * {_JAC('c', 'd')} + 0.10::DOUBLE * {_CON('a', 'b')} + 0.03::DOUBLE * CAST(same AS INT)
 + 0.02::DOUBLE * CASE WHEN greatest(l1, l2) = 0 THEN 0 ELSE least(l1, l2) / greatest(l1, l2)::DOUBLE END AS score FROM f""")
def score_weighted(spark, d):
    e = views.entities(spark, d)
    f = features.set_features(features.gather(plan.candidates(e), e))
    s = decide.weighted_score(F.col("n_jac"), F.col("a_jac"), F.col("n_cont"), F.col("same_cty").cast("double"), F.col("len_ratio"))
    return f.select("i", "j", s.alias("score"))  # unrounded: both sides add the same terms in the same order


@query(f"""WITH {S.CANDIDATES}, {_SETF}, t AS (SELECT id, unnest(list_distinct({S.word_list('name')})) AS t FROM e), w AS (SELECT t, ln((SELECT count(*) FROM e) / count(*)::DOUBLE) AS w FROM t GROUP BY t),
ia AS (SELECT i, j, sum(w) AS s FROM (SELECT i, j, unnest(a) AS t FROM f) JOIN w USING (t) GROUP BY ALL), ib AS (SELECT i, j, sum(w) AS s FROM (SELECT i, j, unnest(b) AS t FROM f) JOIN w USING (t) GROUP BY ALL),
ic AS (SELECT i, j, sum(w) AS s FROM (SELECT i, j, unnest(list_intersect(a, b)) AS t FROM f) JOIN w USING (t) GROUP BY ALL)
SELECT i, j, CAST(n1 = n2 AS INT) AS n_exact, round({_JAC('a', 'b')}, 6) AS n_jac, round({_CON('a', 'b')}, 6) AS n_cont, round({_JAC('c', 'd')}, 6) AS a_jac, round({_CON('c', 'd')}, 6) AS a_cont, CAST(same AS INT) AS same_cty,
 round(CASE WHEN coalesce(ia.s, 0) + coalesce(ib.s, 0) - coalesce(ic.s, 0) <= 0 THEN 0 ELSE coalesce(ic.s, 0) / (ia.s + ib.s - coalesce(ic.s, 0)) END, 6) AS n_idf_jac,
 round(CASE WHEN least(coalesce(ia.s, 0), coalesce(ib.s, 0)) <= 0 THEN 0 ELSE coalesce(ic.s, 0) / least(ia.s, ib.s) END, 6) AS n_idf_min,
 CASE WHEN len(c) = 0 AND len(d) = 0 THEN 2 WHEN len(c) = 0 OR len(d) = 0 THEN 1 ELSE 0 END AS a_missing
FROM f LEFT JOIN ia USING (i, j) LEFT JOIN ib USING (i, j) LEFT JOIN ic USING (i, j)""")
def pair_features_set(spark, d):
    e = views.entities(spark, d)
    idf = vectors.idf_weights(e.withColumn("t", T.words(F.col("name"))), "t")
    f = features.set_features(features.idf_features(features.gather(plan.candidates(e), e), e, idf))
    r = [F.round(c, 6).alias(c) for c in ("n_jac", "n_cont", "a_jac", "a_cont", "n_idf_jac", "n_idf_min")]
    return f.select("i", "j", "n_exact", "same_cty", "a_missing", *r)


@query()
def pair_features_fuzzy(spark, d):
    e = views.entities(spark, d)
    return features.fuzzy_features(features.gather(plan.candidates(e), e)).drop("n1", "n2", "a1", "a2", "c1", "c2")


_PARTS = "p AS (SELECT DISTINCT p_name AS s FROM part)"


@query(f"WITH {_PARTS} SELECT a.s AS a, b.s AS b, round(jaro_winkler_similarity(a.s, b.s), 6) AS jw FROM p a JOIN p b ON a.s[1] = b.s[1] AND a.s < b.s")
def jaro_winkler(spark, d):
    """Distinct part names of the same first letter."""
    from kinlake.functions import fuzzy

    return _part_pairs(spark, d).select("a", "b", F.round(fuzzy.pairwise("jaro_winkler")("a", "b"), 6).alias("jw"))


@query(f"WITH {_PARTS} SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s) AS distance FROM p a JOIN p b ON a.s[1] = b.s[1] AND a.s < b.s")
def edit_distance(spark, d):
    return _part_pairs(spark, d).select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("distance"))


def _part_pairs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("s")).distinct().withColumn("k", F.substring("s", 1, 1))
    return p.select(F.col("s").alias("a"), "k").join(p.select(F.col("s").alias("b"), "k"), "k").filter("a < b")


def _eval(spark, d, p=0.3):
    e = views.entities(spark, d)
    c = plan.candidates(e)
    return c, c.filter(F.col("p") >= p), views.truth(spark, d), e.filter("src = 0").select(F.col("id").alias("i"), "country")


@query(f"WITH {S.CANDIDATES} SELECT count(*) AS n_true, count(p.i) AS n_found, round(count(p.i) / count(*)::DOUBLE, 6) AS recall FROM truth t LEFT JOIN pairs p USING (i, j)")
def blocking_recall(spark, d):
    c, _, t, _ = _eval(spark, d)
    return metrics.recall(c, t)


@query(f"WITH {S.CANDIDATES} SELECT x.country, count(*) AS n_true, count(p.i) AS n_found, round(count(p.i) / count(*)::DOUBLE, 6) AS recall FROM truth t JOIN e x ON x.id = t.i LEFT JOIN pairs p ON p.i = t.i AND p.j = t.j GROUP BY ALL")
def blocking_recall_by_country(spark, d):
    e = views.entities(spark, d)
    with scratch.shuffles_dropped(spark):
        t = scratch.materialise(views.truth(spark, d).join(e.filter("src = 0").select(F.col("id").alias("i"), "country"), "i"), "links")
    return metrics.recall(plan.candidates(e, links=t), t, ["country"])


@query(f"""WITH {S.RECORDS} SELECT round(avg(CAST(x.country <> y.country AS INT)), 6) AS cross_country, (SELECT round(avg(CAST(n > 1 AS INT)), 6) FROM (SELECT j, count(*) AS n FROM truth GROUP BY j)) AS multi_claim
FROM truth JOIN e x ON x.id = i JOIN e y ON y.id = j""")
def plan_facts(spark, d):
    """What decides the plan: links across countries, and targets with more than one anchor."""
    e, t = views.entities(spark, d), views.truth(spark, d)
    ci, cj = (e.select(F.col("id").alias(x), F.col("country").alias(f"c{x}")) for x in "ij")
    cross = t.join(ci, "i").join(cj, "j").agg(F.round(F.avg((F.col("ci") != F.col("cj")).cast("int")), 6).alias("cross_country"))
    multi = t.groupBy("j").count().agg(F.round(F.avg((F.col("count") > 1).cast("int")), 6).alias("multi_claim"))
    return cross.crossJoin(multi)


_F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25::DOUBLE * tp / (n_pred + 0.25::DOUBLE * n_true) END"
_ENTITY = f"""pr AS (SELECT i, j FROM pairs WHERE p >= 0.3), ent AS (SELECT e.id AS i, e.country, coalesce(a.n, 0) AS n_pred, coalesce(b.n, 0) AS n_true, coalesce(c.n, 0) AS tp FROM e LEFT JOIN (SELECT i, count(*) AS n FROM pr GROUP BY i) a ON a.i = e.id
 LEFT JOIN (SELECT i, count(*) AS n FROM truth GROUP BY i) b ON b.i = e.id LEFT JOIN (SELECT i, count(*) AS n FROM pr JOIN truth USING (i, j) GROUP BY i) c ON c.i = e.id WHERE e.src = 0), f05 AS (SELECT *, round({_F05}, 6) AS f05 FROM ent)"""


@query(f"WITH {S.CANDIDATES}, {_ENTITY} SELECT i, n_pred, n_true, tp, f05 FROM f05")
def entity_f05(spark, d):
    _, p, t, a = _eval(spark, d)
    return metrics.entity_f05(p, t, a)


@query(f"WITH {S.CANDIDATES}, {_ENTITY} SELECT round(avg(f05), 6) AS macro_f05, count(*) AS entities FROM f05")
def macro_f05(spark, d):
    _, p, t, a = _eval(spark, d)
    return metrics.macro_f05(p, t, a)


_GRID = [round(0.30 + 0.02 * k, 2) for k in range(28)]


@query(f"""WITH {S.CANDIDATES}, t AS (SELECT unnest({_GRID})::DOUBLE AS threshold), a AS (SELECT id AS i FROM e WHERE src = 0), y AS (SELECT i, count(*) AS n FROM truth GROUP BY i),
c AS (SELECT p.i, threshold, count(*) AS n_pred, count(u.i) AS tp FROM pairs p JOIN t ON p.p >= threshold LEFT JOIN truth u ON u.i = p.i AND u.j = p.j GROUP BY ALL),
m AS (SELECT threshold, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(y.n, 0) AS n_true FROM a CROSS JOIN t LEFT JOIN c USING (i, threshold) LEFT JOIN y ON y.i = a.i) SELECT threshold, round(avg({_F05}), 6) AS macro_f05 FROM m GROUP BY threshold""")
def threshold_sweep(spark, d):
    c, _, t, a = _eval(spark, d)
    return metrics.threshold_sweep(c, t, a, _GRID)


_CAT = f"""{_ENTITY}, re AS (SELECT i, count(*) AS n FROM truth JOIN pairs USING (i, j) GROUP BY i), er AS (SELECT f05.*, CASE WHEN n_true = 0 AND n_pred > 0 THEN 'singleton_false_merge' WHEN n_true > 0 AND coalesce(re.n, 0) = 0 THEN 'match_not_in_candidates'
 WHEN n_true > 0 AND n_pred = 0 THEN 'predicted_empty_but_reachable' WHEN n_true > 0 AND tp = 0 THEN 'only_wrong_picks' WHEN n_true > 0 AND (tp < n_true OR tp < n_pred) THEN 'partial_set' ELSE 'correct' END AS category FROM f05 LEFT JOIN re USING (i))"""


@query(f"WITH {S.CANDIDATES}, {_CAT} SELECT category, count(*) AS entities, round(sum(1 - f05), 6) AS lost, round(avg(f05), 6) AS mean_f05 FROM er GROUP BY category")
def error_report(spark, d):
    c, p, t, a = _eval(spark, d)
    return metrics.error_report(metrics.error_rows(p, t, c, a), ["category"])


@query(f"WITH {S.CANDIDATES}, {_CAT} SELECT country, category, count(*) AS entities, round(sum(1 - f05), 6) AS lost, round(avg(f05), 6) AS mean_f05 FROM er GROUP BY ALL")
def error_report_by_country(spark, d):
    c, p, t, a = _eval(spark, d)
    return metrics.error_report(metrics.error_rows(p, t, c, a).join(a, "i"), ["country", "category"])


_BAD = [("S1-x", "S2-1,S2-1"), ("S1-x", ""), ("S1-y", "S1-1,Q-2"), ("S1-z", "S2-999999999")]


@query(f"""WITH {S.CANDIDATES}, l AS (SELECT 'S1-' || e.id AS k, coalesce(string_agg('S' || (p.src + 1) || '-' || p.j, ','), '') AS m FROM e LEFT JOIN pairs p ON p.i = e.id AND p.p >= 0.3 WHERE e.src = 0 GROUP BY e.id UNION ALL SELECT * FROM {values(_BAD, 'k, m')}),
x AS (SELECT k, list_filter(list_transform(string_split(m, ','), lambda y: trim(y)), lambda y: y <> '') AS ids FROM l), each AS (SELECT k, unnest(ids) AS j FROM x), tg AS (SELECT 'S' || (src + 1) || '-' || id AS j FROM e WHERE src > 0), an AS (SELECT 'S1-' || id AS k FROM e WHERE src = 0)
SELECT 'duplicate_row' AS rule, count(*) AS offenders FROM (SELECT k FROM l GROUP BY k HAVING count(*) > 1) UNION ALL SELECT 'duplicate_id', count(*) FROM x WHERE len(ids) > len(list_distinct(ids))
UNION ALL SELECT 'anchor_in_list', count(*) FROM each WHERE starts_with(j, 'S1-') UNION ALL SELECT 'wrong_prefix', count(*) FROM each WHERE NOT regexp_matches(j, '^S[123]-') UNION ALL SELECT 'unknown_id', count(*) FROM each WHERE j NOT IN (SELECT j FROM tg)
UNION ALL SELECT 'missing_row', count(*) FROM an WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT 'extra_row', count(*) FROM l WHERE k NOT IN (SELECT k FROM an)""")
def validate_results(spark, d):
    """The result table of the candidates, with rows that break each rule."""
    e = views.entities(spark, d)
    p = plan.candidates(e).filter("p >= 0.3").select(F.concat(F.lit("S1-"), "i").alias("i"), F.concat(F.lit("S"), F.col("src") + 1, F.lit("-"), F.col("j")).alias("j"))
    anchors = e.filter("src = 0").select(F.concat(F.lit("S1-"), "id").alias("i"))
    targets = e.filter("src > 0").select(F.concat(F.lit("S"), F.col("src") + 1, F.lit("-"), F.col("id")).alias("j"))
    lists = decide.result_lists(p, anchors).withColumnRenamed("i", "source1_entity_id").unionByName(rows(spark, _BAD, "source1_entity_id string, matched_entity_ids string"))
    return metrics.validate(lists, anchors, targets)


# --- learning ------------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT *, string_split(native, ' ') AS x, string_split(latin, ' ') AS y FROM {values(NATIVE, 'id, native, latin')}), s AS (SELECT unnest(x) AS token, unnest(y) AS plain FROM a WHERE len(x) = len(y) AND regexp_matches(native, '[^\\x00-\\x7F]') AND NOT regexp_matches(latin, '[^\\x00-\\x7F]')),
n AS (SELECT token, plain, count(*) AS n FROM s GROUP BY ALL) SELECT token, plain, n FROM n QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, plain) = 1 AND n >= 2 AND n >= 0.6 * sum(n) OVER (PARTITION BY token)""")
def mine_translit(spark, d):
    return learn.mine_transliterations(rows(spark, NATIVE, "id int, native string, latin string"))


@query(f"WITH {S.RECORDS}, t AS (SELECT unnest({S.word_list('addr')}) AS token FROM e) SELECT token, round(ln(count(*)::DOUBLE), 6) AS log_n FROM t WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY token HAVING count(*) >= 20")
def vocabulary(spark, d):
    return learn.vocabulary(views.entities(spark, d).select(F.explode(T.words(F.col("addr"))).alias("token")))


@query(f"""WITH a AS (SELECT string_split(a, ' ') AS a, string_split(b, ' ') AS b FROM {values(EQUIV, 'a, b')}), x AS (SELECT list_filter(list_distinct(a), lambda t: NOT list_contains(b, t)) AS x, list_filter(list_distinct(b), lambda t: NOT list_contains(a, t)) AS y FROM a)
SELECT least(x[1], y[1]) AS u, greatest(x[1], y[1]) AS v, count(*) AS n FROM x WHERE len(x) = 1 AND len(y) = 1 AND NOT regexp_matches(x[1] || y[1], '^[0-9]+$') GROUP BY ALL""")
def mine_equivalences(spark, d):
    p = rows(spark, EQUIV, "a string, b string").select(F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    return learn.substitutions(p)


@query()
def segment_words(spark, d):
    """First sentences without their spaces, segmented again by the corpus's vocabulary."""
    from kinlake.functions import fuzzy
    from kinlake.sources import scratch

    e = views.entities(spark, d)
    counts = learn.vocabulary(e.select(F.explode(T.words(F.col("addr"))).alias("token")), 20, 3)
    path = scratch.new_folder(spark, "vocabulary")
    counts.select("token", F.round(F.exp("log_n")).cast("bigint").alias("n")).write.parquet(path)
    words = F.transform(T.words(F.col("name")), lambda w: F.concat(w, F.lit("com")))
    return e.select("id", fuzzy.segmenter(path)(F.array_join(words, " ")).alias("segmented"))


@query()
def stage2_coherence(spark, d):
    e = views.entities(spark, d)
    return features.reference_coherence(decide.prune(plan.candidates(e), 0.02), e)


@query()
def stage3_coherence(spark, d):
    e = views.entities(spark, d)
    return features.set_coherence(decide.prune(plan.candidates(e), 0.02), e)


@query()
def linkage_pipeline(spark, d):
    """Pruner, three stacked models, calibration, exclusivity and exact selection, end to end."""
    from kinlake.plans import linkage

    e = views.entities(spark, d)
    return linkage.link(e, views.truth(spark, d)).select("i", "matched_entity_ids")
