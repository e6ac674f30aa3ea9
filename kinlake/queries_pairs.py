"""Queries of records, further blocking channels, pair features, scorers, variants and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlake import queries as Q
from kinlake import sqlgen as S
from kinlake.functions import fuzzy
from kinlake.functions import lexicon as L
from kinlake.functions import text as T
from kinlake.operators import blocking, decide, kernel, learn, metrics, nearest, rescore, vectors
from kinlake.plans import candidates as plan
from kinlake.registry import query
from kinlake.sources import artefacts, scratch, split, views

# --- records ---------------------------------------------------------------------------------------------------

_NAME = lambda source, out: f"""{out}_t AS (SELECT id, {S.tokens(S.cleaned('text'))} AS t FROM {source}), {out}_c AS (SELECT id, {S.initials('t')} AS s FROM {out}_t),
{out}_m AS (SELECT id, list_transform({S.word_list('s')}, lambda t: {S.mapped(L.NAME_WORDS, 't')}) AS m FROM {out}_c),
{out}_x AS (SELECT id, unnest(m) AS w, generate_subscripts(m, 1) AS pos FROM {out}_m), {out}_f AS (SELECT id, w, min(pos) AS pos FROM {out}_x GROUP BY ALL),
{out}_g AS (SELECT id, string_agg(w, ' ' ORDER BY pos) AS n_full, string_agg(w, ' ' ORDER BY pos) FILTER (w NOT IN {S.strings(L.LEGAL_WORDS)}) AS core FROM {out}_f GROUP BY id),
{out} AS (SELECT s.id, coalesce(n_full, '') AS n_full, coalesce(core, n_full, '') AS n_core FROM {source} s LEFT JOIN {out}_g USING (id))"""  # noqa: E731
_UNITS = "|".join(k for k, v in L.ADDRESS_WORDS.items() if v == "unit")
_PLAIN = {k: v for k, v in L.ADDRESS_WORDS.items() if v != "unit"}
_ADDR = lambda source, out: f"""{out}_t AS (SELECT id, {S.tokens(S.states(S.cleaned(S.native('text'))))} AS t FROM {source}), {out}_c AS (SELECT id, {S.initials('t')} AS s FROM {out}_t),
{out}_p AS (SELECT id, regexp_replace(' ' || replace(s, ' ', '  ') || ' ', ' ({_UNITS}) (?: [^ ]{{1,5}} )?', '', 'g') AS s FROM {out}_c),
{out}_m AS (SELECT id, list_transform({S.word_list('s')}, lambda t: {S.mapped(_PLAIN, 't')}) AS m FROM {out}_p),
{out} AS (SELECT id, array_to_string(list_filter(m, lambda t: t NOT IN {S.strings(L.ADDRESS_DROP)}), ' ') AS a_norm FROM {out}_m)"""  # noqa: E731
_FLAGS = lambda s: f"""CASE WHEN regexp_replace({s}, '[^\\p{{L}}]', '', 'g') = '' THEN 0.0::DOUBLE ELSE len(list_filter(string_split(regexp_replace({s}, '[^\\p{{L}}]', '', 'g'), ''), lambda c: ord(c) > 591)) / length(regexp_replace({s}, '[^\\p{{L}}]', '', 'g'))::DOUBLE END AS nat,
 CAST(contains(lower({s}), '.com') OR contains(lower({s}), 'www') OR (length({s}) > 12 AND NOT contains({s}, ' ')) AS INT) AS dom"""  # noqa: E731
_NORMALISED = f"""{S.RECORDS}, rn AS (SELECT id, raw_name AS text FROM e), ra AS (SELECT id, substr(text, length(raw_name) + 2) AS text FROM e), {_NAME('rn', 'nn')}, {_ADDR('ra', 'na')}"""


@query(f"WITH {_NORMALISED} SELECT e.id, src, country, n_full AS \"full\", n_core AS name, a_norm AS addr, {_FLAGS('raw_name')} FROM e JOIN nn USING (id) JOIN na USING (id)")
def records(spark, d):
    """Every document as a normalised record of the linkage."""
    return views.records(spark, d).drop("postal", "house")


def _basic_address() -> str:
    out = f"trim(regexp_replace(regexp_replace({S.fold('text')}, '[^a-z0-9_\\s,]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for a, b in L.BASIC_ADDRESS_WORDS.items():
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return out


@query(f"WITH {Q.ADDR_SQL} SELECT id, {_basic_address()} AS normalised FROM n")
def norm_address_basic(spark, d):
    return Q.addresses_of(spark, d).select("id", T.norm_address_basic(F.col("text")).alias("normalised"))


@query()
def fold_scripts(spark, d):
    """Names of any script, the pages' paths and the documents' texts in plain letters."""
    extra = Q.rows(spark, [(-30, "प्राइवेट लिमिटेड"), (-31, "কোম্পানি"), (-32, "Ελλάδα"), (-33, "Москва")], "id bigint, text string")
    return Q.names_of(spark, d).unionByName(extra).select("id", fuzzy.fold_scripts(F.col("text")).alias("folded"))


@query("SELECT doc_id AS id, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) >= 7 THEN right(regexp_replace(text, '[^0-9]', '', 'g'), 7) ELSE '' END AS phone FROM documents")
def phone_suffix(spark, d):
    """The last seven digits of every document, as a phone number's would be."""
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), T.phone_suffix(F.coalesce("text", F.lit(""))).alias("phone"))


@query(f"""WITH {S.CANDIDATES}, zp AS (SELECT id, nullif(coalesce(regexp_extract_all(addr, '\\b[0-9]{{5,6}}\\b')[-1], ''), '') AS postal FROM e)
SELECT i, j, CASE WHEN x.postal IS NULL OR y.postal IS NULL THEN -1 ELSE CAST(x.postal = y.postal AS INT) END AS postal_match FROM pairs JOIN zp x ON x.id = i JOIN zp y ON y.id = j""")
def component_match(spark, d):
    """Whether the postal codes of a candidate pair are equal, where both have one."""
    e = views.entities(spark, d)
    code = F.get(F.reverse(F.regexp_extract_all("addr", F.lit(r"\b[0-9]{5,6}\b"), F.lit(0))), F.lit(0))
    z = scratch.materialise(e.select("id", code.alias("postal")).filter("postal <> ''"), "postal")  # so that Spark knows how few have one
    p = plan.candidates(e).join(z.select(F.col("id").alias("i"), F.col("postal").alias("x")), "i", "left").join(z.select(F.col("id").alias("j"), F.col("postal").alias("y")), "j", "left")
    return p.select("i", "j", T.component_match(F.col("x"), F.col("y")).alias("postal_match"))


# --- scans, sinks and artefacts ----------------------------------------------------------------------------------

_ENTITY = "'S' || (CAST(substr(source, 4) AS INT) % 3 + 1) || '-' || doc_id"
_SAFE = "regexp_replace(coalesce(text, ''), '[\\t\\r\\n]', ' ', 'g')"


def _split_files(spark, d, folder):
    """The documents as three source tables in folders of their own under `folder`."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.split_part(F.col("text"), F.lit("."), F.lit(1))
    rows = docs.select(
        F.concat(F.lit("S"), views.role() + 1, F.lit("-"), F.col("doc_id")).alias("entity_id"), name.alias("business_name"),
        F.substring("text", F.length(name) + 2, F.lit(1 << 30)).alias("business_address"), F.col("lang").alias("country"), views.role().alias("src"),
    )
    for n in (1, 2, 3):
        views.write_tsv(rows.filter(F.col("src") == n - 1).drop("src"), f"{folder}/part{n}/train_source{n}.tsv")
    return docs


@query(f"""WITH e AS (SELECT {_ENTITY} AS entity_id, CAST(substr(source, 4) AS INT) % 3 AS src, upper(trim(lang)) AS country, doc_id AS id, split_part({_SAFE}, '.', 1) AS raw_name, substr({_SAFE}, length(split_part({_SAFE}, '.', 1)) + 2) AS rest FROM documents),
rn AS (SELECT id, raw_name AS text FROM e), ra AS (SELECT id, rest AS text FROM e), {_NAME('rn', 'nn')}, {_ADDR('ra', 'na')}
SELECT entity_id, country, src, n_full AS "full", n_core AS name, a_norm AS addr, {_FLAGS('raw_name')} FROM e JOIN nn USING (id) JOIN na USING (id)""")
def load_split(spark, d):
    """Three tab-separated tables, found by name under one folder, tagged and normalised."""
    folder = scratch.new_folder(spark, "split")
    _split_files(spark, d, folder)
    return split.load_split(spark, folder, "train")


@query(f"SELECT {_ENTITY} AS entity_id, lang AS country FROM documents WHERE CAST(substr(source, 4) AS INT) % 3 = 1")
def scan_pruned(spark, d):
    """Two columns of a table; lines that are not of its shape are skipped."""
    folder = scratch.new_folder(spark, "split")
    _split_files(spark, d, folder)
    path = split.find_file(spark, folder, "train_source2.tsv")
    spark.createDataFrame([("a line of one field",)], "value string").write.mode("append").text(path)
    return split.read_pruned(spark, path, ["entity_id", "country"], list(views.SOURCE))


@query(f"SELECT {_ENTITY} AS entity_id, split_part({_SAFE}, '.', 1) AS business_name, lang AS country FROM documents WHERE CAST(substr(source, 4) AS INT) % 3 = 2")
def scan_plain(spark, d):
    folder = scratch.new_folder(spark, "split")
    _split_files(spark, d, folder)
    return split.read_plain(spark, split.find_file(spark, folder, "train_source3.tsv")).select("entity_id", "business_name", "country")


@query(f"WITH {S.CANDIDATES} SELECT CAST(i AS VARCHAR) AS i, CAST(j AS VARCHAR) AS j FROM pairs")
def scan_candidates(spark, d):
    """Candidates written as comma lists and read back as pairs."""
    p = plan.candidates(views.entities(spark, d))
    path = f"{scratch.new_folder(spark, 'candidates')}/candidate_pairs.tsv"
    views.write_tsv(decide.result_lists(p, p.select("i").distinct(), "candidate_entity_ids").withColumnRenamed("i", "source1_entity_id"), path)
    return split.read_candidates(spark, path)


@query(f"WITH {S.CANDIDATES} SELECT i, j, src, fwd, cc, cm, ca, p FROM pairs")
def candidate_cache(spark, d):
    """Candidates from a cache keyed by all parameters: the second call reads what the first wrote."""
    folder = scratch.new_folder(spark, "cache")
    make = lambda: plan.candidates(views.entities(spark, d))
    artefacts.cached(spark, folder, "candidates", vars(plan.DEFAULT) | {"input": d}, make)
    return artefacts.cached(spark, folder, "candidates", vars(plan.DEFAULT) | {"input": d}, lambda: 1 / 0)


@query(f"""WITH {S.CANDIDATES}, b AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY p DESC, i) AS rn, max(p) OVER (PARTITION BY j) AS best FROM pairs), v AS (SELECT 'noexcl' AS variant, i, j, p FROM b UNION ALL SELECT 'excl', i, j, CASE WHEN rn = 1 THEN p ELSE round(least(p, 1 - best), 6) END FROM b)
SELECT v.variant, e.id AS i, coalesce(string_agg(CAST(v2.j AS VARCHAR), ',' ORDER BY CAST(v2.j AS VARCHAR)), '') AS matched_entity_ids FROM e CROSS JOIN (SELECT DISTINCT variant FROM v) v LEFT JOIN v v2 ON v2.i = e.id AND v2.variant = v.variant AND v2.p >= 0.3 WHERE e.src = 0 GROUP BY ALL""")
def result_variants(spark, d):
    """Result files with and without exclusivity, written and read back."""
    from kinlake.operators import context

    e = views.entities(spark, d)
    p = plan.candidates(e)
    anchors = e.filter("src = 0").select(F.col("id").alias("i"))
    lists = {"noexcl": decide.result_lists(p.filter("p >= 0.3"), anchors), "excl": decide.result_lists(context.exclusivity(p).filter("p >= 0.3"), anchors)}
    out = None
    for name, path in artefacts.write_variants(lists, scratch.new_folder(spark, "results")).items():
        part = views.read_tsv(spark, path, ("i", "matched_entity_ids")).select(F.lit(name).alias("variant"), F.col("i").cast("bigint").alias("i"), "matched_entity_ids")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {S.CANDIDATES} SELECT i, j, p, x.country, 1.2::DOUBLE AS gamma, 1 AS excl FROM pairs JOIN e x ON x.id = i")
def probability_dump(spark, d):
    """Scored pairs with the run's choices, written and read back."""
    e = views.entities(spark, d)
    p = plan.candidates(e).join(e.select(F.col("id").alias("i"), "country"), "i").select("i", "j", "p", "country")
    path = scratch.new_folder(spark, "probabilities")
    artefacts.write_probabilities(p, path, gamma=1.2, excl=1)
    return spark.read.parquet(path)


@query(f"WITH {S.RECORDS} SELECT count(*) AS links, count(DISTINCT i) AS anchors, count(DISTINCT j) AS targets FROM truth")
def matched_counts(spark, d):
    return metrics.matched(views.truth(spark, d))


@query()
def hold_out(spark, d):
    """Anchors held out, for training, and the rest: 50, 100 and all others."""
    return split.hold_out(views.entities(spark, d).filter("src = 0").select(F.col("id").alias("i")), 50, 100)


# --- blocking ------------------------------------------------------------------------------------------------------

_GRAMS2 = f"list_distinct({S.char_ngrams('name', 2)})"
_GRAMS3 = f"list_distinct({S.char_ngrams('name', 3)})"


@query(f"WITH {S.RECORDS}, {Q._SHARED(_GRAMS2)} SELECT i, j FROM s")
def block_ngram2(spark, d):
    return nearest.sharing(Q._units(spark, d, T.char_ngrams(F.col("name"), 2)))


@query(f"WITH {S.RECORDS}, {Q._SHARED(_GRAMS3)} SELECT i, j, score AS shared FROM ({S.top('s', 'i', 50)})")
def block_ngram_topk_distinct(spark, d):
    return Q._most_shared(Q._units(spark, d, F.array_distinct(T.char_ngrams(F.col("name"), 3))), 50)


@query(f"WITH {S.RECORDS}, {Q._SHARED(Q._BLOCK_WORDS)} SELECT i, j, score AS shared FROM ({S.top('s', 'i', 6)})")
def block_prerank(spark, d):
    """The six targets of either source that share most words, before any dearer score."""
    return Q._most_shared(Q._units(spark, d, Q._block_words()), 6)


@query(f"""WITH {S.RECORDS}, p AS (SELECT id, src, f FROM (SELECT id, src, unnest({_GRAMS3}) AS f FROM e WHERE src > 0) QUALIFY row_number() OVER (PARTITION BY f ORDER BY id) <= 1000),
a AS (SELECT id AS i, unnest({S.char_ngrams('name', 3)}) AS f FROM e WHERE src = 0), s AS (SELECT i, p.id AS j, p.src, count(*) AS score FROM a JOIN p USING (f) GROUP BY ALL)
SELECT i, j, src, score AS shared FROM ({S.top('s', 'i, src', 5)})""")
def block_ngram_capped(spark, d):
    """Posting lists of triples cut to their 1,000 smallest ids, which is the feature."""
    a, b = Q._sides(spark, d)
    grams = T.char_ngrams(F.col("name"), 3, False)
    b = blocking.capped(b, grams, 1000)
    both = scratch.materialise(a.select("id", "src", grams.alias("features")).unionByName(b), "capped")
    return Q._most_shared(nearest.lay_out(both, [nearest.Channel("shared", F.col("features"))]), 5, True)


@query(f"WITH {S.CHANNELS} SELECT i, j, src, score FROM ({S.top('s_char', 'j', 3)})")
def block_reverse_char(spark, d):
    return blocking.top_k(plan.scores(views.entities(spark, d), channels=("char",))["char"], ["j"], 3).select("i", "j", "src", "score")


@query(f"WITH {S.CHANNELS} SELECT i, j, src, score FROM ({S.top('s_addr', 'j', 3)})")
def block_reverse_addr(spark, d):
    return plan.reverse(plan.units(views.entities(spark, d), channels=("addr",)), [("addr", 3)]).select("i", "j", "src", "score")


_ADDR_FEATURES = f"list_concat(list_transform(list_filter({S.word_list('addr')}, lambda w: length(w) > 1 OR regexp_matches(w, '^[0-9]$')), lambda w: 'a' || w), CASE WHEN postal <> '' THEN ['p' || postal] ELSE [] END)"
_V12_COMB = f"""{S.RECORDS.replace('e AS (', 'e0 AS (', 1).replace('truth AS', 'e AS (SELECT *, coalesce(regexp_extract_all(addr, ' + chr(39) + '\\b[0-9]{5,6}\\b' + chr(39) + ')[-1], ' + chr(39) * 2 + ') AS postal FROM e0),' + chr(10) + 'truth AS', 1)},
{S.channel('v', Q._V12, 0.002, 60)}, {S.channel('va', _ADDR_FEATURES, 0.002, 60)},
z AS (SELECT id, sqrt(CASE WHEN id IN (SELECT id FROM w_v) THEN 1.0::DOUBLE ELSE 0 END + 0.49::DOUBLE * CASE WHEN id IN (SELECT id FROM w_va) THEN 1 ELSE 0 END) AS z FROM (SELECT id FROM w_v UNION SELECT id FROM w_va)),
s_vc AS (SELECT i, j, src, round((coalesce(a.score, 0) + 0.49::DOUBLE * coalesce(b.score, 0)) / (x.z * y.z), 6) AS score FROM s_v a FULL JOIN s_va b USING (i, j, src) JOIN z x ON x.id = i JOIN z y ON y.id = j)"""


def _v12_channels(spark, d):
    e = views.entities(spark, d).withColumn("postal", F.coalesce(F.get(F.reverse(F.regexp_extract_all("addr", F.lit(r"\b[0-9]{5,6}\b"), F.lit(0))), F.lit(0)), F.lit("")))
    compact = F.concat(F.lit("#"), F.replace("name", F.lit(" "), F.lit("")), F.lit("#"))
    name = F.concat(F.transform(T.words(F.col("name")), lambda w: F.concat(F.lit("w"), w)), F.transform(T.char_ngrams(compact, 4, False), lambda g: F.concat(F.lit("c"), g)))
    words = F.filter(T.words(F.col("addr")), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))
    addr = F.concat(F.transform(words, lambda w: F.concat(F.lit("a"), w)), F.when(F.col("postal") != "", F.array(F.concat(F.lit("p"), "postal"))).otherwise(F.array().cast("array<string>")))
    return nearest.lay_out(e, [nearest.Channel("name", name, 0.002, 60), nearest.Channel("addr", addr, 0.002, 60)], F.col("country"))


@query(f"WITH {_V12_COMB} SELECT i, j, src, score FROM ({S.top('(SELECT * FROM s_vc WHERE score >= 0.1)', 'i, src', 10)})")
def block_cosine_v12_comb(spark, d):
    """The joint space of names, and of addresses and postal codes at 0.7."""
    found = nearest.nearest(_v12_channels(spark, d), [("joint", 10)], joint=nearest.Joint("name", "addr", 0.7))
    return found.filter("score >= 0.1").select(F.col("l").alias("i"), F.col("r").alias("j"), F.col("rsrc").alias("src"), "score")


@query(f"""WITH {S.CANDIDATES}, s AS (SELECT i, j, cc AS cn, ca, round(greatest(cc, 0.6::DOUBLE * cc + 0.4::DOUBLE * ca), 6) AS score FROM pairs) SELECT i, j, cn, ca, score FROM ({S.top('s', 'i', 8)})""")
def cap_blended(spark, d):
    best = lambda p: blocking.cap_blended(p.select("i", "j", F.col("cc").alias("cn"), "ca"), 8, True)
    return plan.candidates(views.entities(spark, d), shape=best)


_BLANK = S.RECORDS.replace("upper(lang) AS country", "CASE WHEN doc_id % 10 = 3 THEN '' ELSE upper(lang) END AS country")
_GROUPED = f"""{_BLANK.replace('e AS (', 'e0 AS (', 1).replace('truth AS', "e AS (SELECT * FROM e0 WHERE NOT (src > 0 AND country = '') UNION ALL SELECT e0.* REPLACE (c.country AS country) FROM e0, (SELECT DISTINCT country FROM e0 WHERE src = 0) c WHERE src > 0 AND e0.country = '')," + chr(10) + 'truth AS', 1)}"""
_W_KEYED = S.channel("word", S.word_list("name"), 0.02).replace("PARTITION BY id", "PARTITION BY country, id")


@query(f"WITH {_GROUPED}, {_W_KEYED} SELECT i, j, src, score FROM ({S.top('s_word', 'i, src', 10)})")
def block_blank_country(spark, d):
    """Every tenth record has no country here: such targets meet the anchors of every country, as do blank anchors the blank targets."""
    e = views.entities(spark, d).withColumn("country", F.when(F.col("id") % 10 == 3, "").otherwise(F.col("country")))
    p = plan.posts(vectors.country_groups(e), "word")
    return blocking.top_k(vectors.cosine(p.filter("src = 0"), p.filter("src > 0")), ["i", "src"], 10).select("i", "j", "src", "score")


_SMOKE = [
    ("S1-001", 0, "Acme Robotics Corp.", "123 Main St, NY", "US"), ("S1-002", 0, "Starbucks Coffee", "500 Pine St", "US"),
    ("S2-001", 1, "Acme Robotics Corporation", "123 Main Street, NY", "USA"), ("S2-002", 1, "Starbucks", "500 Pine Street", "US"), ("S2-003", 1, "Different Co", "999 Other St", "US"),
]


@query("SELECT * FROM (VALUES ('S1-001', 'S2-001'), ('S1-002', 'S2-002')) AS v(i, best)")
def smoke_rows(spark, d):
    """The task's own five test rows: the best target of each anchor by the set scorer."""
    r = Q.rows(spark, _SMOKE, "id string, src int, business_name string, business_address string, country string")
    r = split.normalise(r).withColumn("country", T.country_alias(F.col("country")))
    pairs = r.filter("src = 0").select(F.col("id").alias("i"), "country").join(r.filter("src > 0").select(F.col("id").alias("j"), "country"), "country").select("i", "j")
    scored = rescore.set_score(kernel.gather(pairs, r, "country"))
    return blocking.top_k(scored, ["i"], 1).select("i", F.col("j").alias("best"))


# --- pair features and scorers ----------------------------------------------------------------------------------------

_D = lambda x: f"list_distinct({S.word_list(x)})"
_NUM = lambda x: f"list_filter({x}, lambda t: regexp_matches(t, '^[0-9]+$'))"
_JAC, _CON = Q._JAC, Q._CON
_IDF = lambda out, col: f"{out} AS (SELECT t, ln((SELECT count(*) FROM e) / count(*)::DOUBLE) AS w FROM (SELECT id, unnest({_D(col)}) AS t FROM e) GROUP BY t)"
_SUM = lambda out, expr, idf: f"{out} AS (SELECT i, j, sum(w) AS s FROM (SELECT i, j, unnest({expr}) AS t FROM k) JOIN {idf} USING (t) GROUP BY ALL)"
_RATIO = lambda a, b, ab, kind: (
    f"CASE WHEN {a}.s IS NULL OR {b}.s IS NULL THEN 0.0::DOUBLE WHEN least({a}.s, {b}.s) <= 0 THEN 0 ELSE coalesce({ab}.s, 0) / "
    + (f"({a}.s + {b}.s - coalesce({ab}.s, 0))" if kind == "jac" else f"least({a}.s, {b}.s)") + " END"
)
_ACRO = "CASE WHEN len(la) >= 2 AND len(lb) = 1 AND length(lb[1]) >= 2 THEN CAST(array_to_string(list_transform(la, lambda w: w[1]), '') = lb[1] AS INT) WHEN len(lb) >= 2 AND len(la) = 1 AND length(la[1]) >= 2 THEN CAST(array_to_string(list_transform(lb, lambda w: w[1]), '') = la[1] AS INT) ELSE 0 END"
_KERNEL = f"""k AS (SELECT i, j, x.name AS n1, y.name AS n2, {S.word_list('x.name')} AS la, {S.word_list('y.name')} AS lb, {_D('x.name')} AS a, {_D('y.name')} AS b, {_D('x.addr')} AS u, {_D('y.addr')} AS v,
 {_NUM(_D('x.addr'))} AS nu, {_NUM(_D('y.addr'))} AS nv, list_filter({_D('x.addr')}, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')) AS wu, list_filter({_D('y.addr')}, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')) AS wv
 FROM pairs JOIN e x ON x.id = i JOIN e y ON y.id = j),
{_IDF('iw', 'name')}, {_IDF('aw', 'addr')}, {_SUM('sa', 'a', 'iw')}, {_SUM('sb', 'b', 'iw')}, {_SUM('sab', 'list_intersect(a, b)', 'iw')}, {_SUM('su', 'u', 'aw')}, {_SUM('sv', 'v', 'aw')}, {_SUM('suv', 'list_intersect(u, v)', 'aw')},
{_SUM('swu', 'wu', 'aw')}, {_SUM('swv', 'wv', 'aw')}, {_SUM('swuv', 'list_intersect(wu, wv)', 'aw')}"""
_BOTH, _ADDRS = "len(a) > 0 AND len(b) > 0", "len(u) > 0 AND len(v) > 0"
_IF = lambda ok, x, other: f"CASE WHEN {ok} THEN CAST({x} AS DOUBLE) ELSE {other}.0::DOUBLE END"
_POST = lambda x: f"list_filter({x}, lambda t: regexp_matches(t, '^[0-9]{{5,6}}$'))"
_SET_SQL = {
    "n_exact": _IF(_BOTH, "n1 = n2", 0), "n_jac": _IF(_BOTH, _JAC("a", "b"), 0), "n_idf_jac": _RATIO("sa", "sb", "sab", "jac"), "n_idf_min": _RATIO("sa", "sb", "sab", "min"),
    "n_first": _IF(_BOTH, "la[1] = lb[1]", 0), "n_acro": _IF(_BOTH, _ACRO, 0), "n_len1": "length(n1)::DOUBLE", "n_len2": "length(n2)::DOUBLE", "n_ntok1": "len(la)::DOUBLE", "n_ntok2": "len(lb)::DOUBLE",
    "n_digits": f"CASE WHEN len({_NUM('a')}) = 0 AND len({_NUM('b')}) = 0 THEN -1.0::DOUBLE ELSE CAST(list_sort({_NUM('a')}) = list_sort({_NUM('b')}) AS DOUBLE) END",
    "a_missing": "CASE WHEN len(u) = 0 AND len(v) = 0 THEN 2.0::DOUBLE WHEN len(u) = 0 OR len(v) = 0 THEN 1 ELSE 0 END",
    "a_idf_jac": _IF(_ADDRS, _RATIO("su", "sv", "suv", "jac"), -1), "a_idf_min": _IF(_ADDRS, _RATIO("su", "sv", "suv", "min"), -1),
    "a_postal": _IF(f"{_ADDRS} AND len({_POST('u')}) > 0 AND len({_POST('v')}) > 0", f"len(list_intersect({_POST('u')}, {_POST('v')})) > 0", -1),
    "a_num_jac": _IF(f"{_ADDRS} AND len(nu) > 0 AND len(nv) > 0", _JAC("nu", "nv"), -1), "a_name_in": _IF(_ADDRS, f"{_BOTH} AND len(list_intersect(a, v)) = len(a)", -1),
    "a_wjac": _IF(f"{_ADDRS} AND len(wu) > 0 AND len(wv) > 0", _JAC("wu", "wv"), -1), "a_wcont": _IF(f"{_ADDRS} AND len(wu) > 0 AND len(wv) > 0", _CON("wu", "wv"), -1),
    "a_widf": _IF(f"{_ADDRS} AND len(wu) > 0 AND len(wv) > 0", _RATIO("swu", "swv", "swuv", "min"), -1), "a_num_conflict": _IF(_ADDRS, "len(nu) > 0 AND len(nv) > 0 AND len(list_intersect(nu, nv)) = 0", -1),
}


def _full(spark, d):
    return views.entities(spark, d).withColumn("full", F.col("name"))


@query(f"WITH {S.CANDIDATES}, {_KERNEL} SELECT i, j, {', '.join(f'round({x}, 6) AS {c}' for c, x in _SET_SQL.items())} FROM k " + " ".join(f"LEFT JOIN {t} USING (i, j)" for t in ("sa", "sb", "sab", "su", "sv", "suv", "swu", "swv", "swuv")))
def pair_features_kernel(spark, d):
    """All set and IDF features of the candidate pairs."""
    e = scratch.materialise(_full(spark, d).drop("text", "raw_name"), "records")
    idf = [vectors.idf_weights(e.withColumn("t", T.words(F.col(x))), "t") for x in ("name", "addr")]
    heavy = scratch.materialise(kernel.with_weights(e, *idf), "weighted")
    f = kernel.set_features(kernel.gather(plan.candidates(e).select("i", "j"), heavy, *kernel.WEIGHTS))
    return f.select("i", "j", *[F.round(c, 6).alias(c) for c in kernel.SETS])


@query()
def pair_features_strings(spark, d):
    """All string ratios of the candidate pairs' names and addresses."""
    e = _full(spark, d)
    return kernel.string_features(kernel.gather(plan.candidates(e).select("i", "j"), e)).select("i", "j", *kernel.STRINGS)


_V12_RECORDS = S.RECORDS.replace("e AS (", "e0 AS (", 1).replace("truth AS", f"""e AS (SELECT *, coalesce(regexp_extract_all(addr, '\\b[0-9]{{5,6}}\\b')[-1], '') AS postal, coalesce(list_filter({S.word_list('addr')}, lambda t: length(t) <= 5 AND regexp_matches(t, '^[0-9]+[a-z]?$'))[1], '') AS house,
 coalesce({S.word_list('name')}[1], '') AS first, replace(name, ' ', '') AS compact, CASE WHEN len({S.word_list('name')}) > 1 THEN array_to_string(list_transform({S.word_list('name')}, lambda w: w[1]), '') ELSE '' END AS acro, len({S.word_list('name')}) AS ntok FROM e0),
truth AS""", 1)
_V12_CANDIDATES = S.CANDIDATES.replace(S.RECORDS, _V12_RECORDS, 1)
_B = lambda x: f"CAST(({x}) AS DOUBLE)"
_V12_SQL = {
    "pc_eq": _B("x.postal <> '' AND y.postal <> '' AND x.postal = y.postal"), "pc_conf": _B("x.postal <> '' AND y.postal <> '' AND x.postal <> y.postal"), "pc_missing": _B("x.postal = '' OR y.postal = ''"),
    "hn_eq": _B("x.house <> '' AND y.house <> '' AND x.house = y.house"), "hn_conf": _B("x.house <> '' AND y.house <> '' AND x.house <> y.house"), "exact_core": _B("x.name = y.name AND x.name <> ''"),
    "first_eq": _B("x.first = y.first AND x.first <> ''"), "acro": _B("(x.acro = y.compact AND x.acro <> '') OR (x.compact = y.acro AND y.acro <> '')"), "ntok_a": "x.ntok::DOUBLE", "ntok_b": "y.ntok::DOUBLE",
    "len_ratio": "round(least(length(x.name), length(y.name)) / greatest(length(x.name), length(y.name), 1)::DOUBLE, 6)", "alen_a": "length(x.addr)::DOUBLE", "alen_b": "length(y.addr)::DOUBLE", "src3": _B("y.src = 2"),
}


def _v12_pairs(spark, d):
    e = _full(spark, d)
    e = e.withColumn("postal", F.coalesce(F.get(F.reverse(F.regexp_extract_all("addr", F.lit(r"\b[0-9]{5,6}\b"), F.lit(0))), F.lit(0)), F.lit("")))
    e = e.withColumn("house", F.coalesce(F.get(F.filter(T.words(F.col("addr")), lambda t: (F.length(t) <= 5) & t.rlike("^[0-9]+[a-z]?$")), F.lit(0)), F.lit("")))
    return kernel.gather(plan.candidates(e).select("i", "j"), e, "postal", "house", "src")


@query(f"WITH {_V12_CANDIDATES} SELECT i, j, {', '.join(f'{x} AS {c}' for c, x in _V12_SQL.items())} FROM pairs JOIN e x ON x.id = i JOIN e y ON y.id = j")
def pair_features_v12(spark, d):
    return kernel.suffix_features(_v12_pairs(spark, d)).select("i", "j", *[F.round(c, 6).alias(c) if c == "len_ratio" else c for c in kernel.SUFFIX_SETS])


@query()
def pair_features_v12_strings(spark, d):
    return kernel.suffix_strings(_v12_pairs(spark, d)).select("i", "j", *kernel.SUFFIX_STRINGS)


_G3 = lambda n: f"list_distinct(list_transform(range(1, length(replace({n}, ' ', '')) - 1), lambda q: substr(replace({n}, ' ', ''), q, 3)))"


@query(f"""WITH {S.CANDIDATES}, b AS (SELECT i, j, x.name AS n1, y.name AS n2, {_D('x.name')} AS a, {_D('y.name')} AS b, {_D('x.addr')} AS u, {_D('y.addr')} AS v, {_G3('x.name')} AS g, {_G3('y.name')} AS h, x.country = y.country AS same FROM pairs JOIN e x ON x.id = i JOIN e y ON y.id = j)
SELECT i, j, round({_JAC('a', 'b')}, 6) AS name_jaccard, round({_JAC('g', 'h')}, 6) AS name_ngram3_jaccard, round(least(length(n1), length(n2)) / greatest(length(n1), length(n2), 1)::DOUBLE, 6) AS name_len_ratio, round({_JAC('u', 'v')}, 6) AS addr_jaccard,
 round(1 - levenshtein(n1, n2) / greatest(length(n1), length(n2), 1)::DOUBLE, 6) AS name_edit, CAST(same AS INT) AS country_match FROM b""")
def pair_features_basic(spark, d):
    """The first version's features, but for the shared sound, which SQL has no function for."""
    e = _full(spark, d)
    f = kernel.basic_features(kernel.gather(plan.candidates(e).select("i", "j"), e, "country"))
    return f.select("i", "j", *[F.round(c, 6).alias(c) for c in ("name_jaccard", "name_ngram3_jaccard", "name_len_ratio", "addr_jaccard", "name_edit")], "country_match")


@query(f"""WITH {S.CANDIDATES}, b AS (SELECT i, j, x.name AS n1, y.name AS n2, {_D('x.name')} AS a, {_D('y.name')} AS b, {_D('x.addr')} AS u, {_D('y.addr')} AS v, x.country = y.country AND x.country <> '' AS same FROM pairs JOIN e x ON x.id = i JOIN e y ON y.id = j)
SELECT i, j, 0.4::DOUBLE * {_JAC('a', 'b')} + 0.3::DOUBLE * {_JAC('u', 'v')} + 0.15::DOUBLE * CASE WHEN greatest(length(n1), length(n2)) = 0 THEN 0 ELSE 1.0::DOUBLE - levenshtein(n1, n2) / greatest(length(n1), length(n2))::DOUBLE END + 0.1::DOUBLE * {_CON('a', 'b')} + 0.03::DOUBLE * CAST(same AS DOUBLE)
 + 0.02::DOUBLE * CASE WHEN greatest(length(n1), length(n2)) = 0 THEN 0 ELSE least(length(n1), length(n2)) / greatest(length(n1), length(n2))::DOUBLE END AS score FROM b""")
def rescore_sets(spark, d):
    """Unrounded: both sides add the same terms in the same order."""
    e = _full(spark, d)
    return rescore.set_score(kernel.gather(plan.candidates(e).select("i", "j"), e, "country"))


@query()
def rescore_names(spark, d):
    e = _full(spark, d)
    return rescore.name_score(kernel.gather(plan.candidates(e).select("i", "j"), e, "country"))


@query()
def rescore_pairs(spark, d):
    """The pair scorer; documents have no city, and their digits stand for phone and postal code."""
    e = _full(spark, d).withColumn("city", F.lit("")).withColumn("phone", T.phone_suffix(F.col("addr")))
    e = e.withColumn("postal", F.coalesce(F.get(F.reverse(F.regexp_extract_all("addr", F.lit(r"\b[0-9]{5,6}\b"), F.lit(0))), F.lit(0)), F.lit("")))
    return rescore.pair_score(kernel.gather(plan.candidates(e).select("i", "j"), e, "country", "city", "phone", "postal"))


# --- decisions, reports and dictionaries ---------------------------------------------------------------------------------

_F05 = Q._F05


@query(f"""WITH {S.CANDIDATES}, x AS (SELECT i, j, p, CASE WHEN row_number() OVER (PARTITION BY j ORDER BY p DESC, i) = 1 THEN p ELSE round(least(p, 1 - max(p) OVER (PARTITION BY j)), 6) END AS pe FROM pairs),
g AS (SELECT exclusive, gamma::DOUBLE AS gamma FROM (VALUES (0), (1)) a(exclusive), (VALUES (0.85), (1.0), (1.2), (1.5)) b(gamma)), v AS (SELECT exclusive, gamma, i, j, pow(CASE WHEN exclusive = 1 THEN pe ELSE p END, gamma) AS o FROM x, g),
s AS (SELECT exclusive, gamma, i, j, count(*) OVER w AS k, sum(p) OVER w AS sk, sum(p) OVER z AS s, sum(ln(greatest(1 - p, 1e-12))) OVER z AS none FROM (SELECT *, least(o, 1) AS p FROM v WHERE o >= 0.02) WINDOW w AS (PARTITION BY exclusive, gamma, i ORDER BY o DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY exclusive, gamma, i)),
f AS (SELECT *, round(1.25::DOUBLE * sk / (k + 0.25::DOUBLE * s), 9) AS f FROM s), b AS (SELECT *, max(f) OVER (PARTITION BY exclusive, gamma, i) AS best FROM f), c AS (SELECT *, min(CASE WHEN f = best THEN k END) OVER (PARTITION BY exclusive, gamma, i) AS cut FROM b),
h AS (SELECT exclusive, gamma, i, count(*) AS n_pred, count(t.j) AS tp FROM (SELECT exclusive, gamma, i, j FROM c WHERE k <= cut AND best > exp(none)) q LEFT JOIN truth t USING (i, j) GROUP BY ALL),
m AS (SELECT g.exclusive, g.gamma, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(y.n, 0) AS n_true FROM e CROSS JOIN g LEFT JOIN h ON h.i = e.id AND h.exclusive = g.exclusive AND h.gamma = g.gamma LEFT JOIN (SELECT i, count(*) AS n FROM truth GROUP BY i) y ON y.i = e.id WHERE e.src = 0)
SELECT exclusive, gamma, round(avg({_F05}), 6) AS macro_f05 FROM m GROUP BY ALL""")
def variant_search(spark, d):
    """F0.5 of every variant of exclusivity and exponent."""
    c, _, t, a = Q._eval(spark, d)
    return decide.variant_search(c, t, a)


@query(f"WITH sweep AS ({Q.ORACLES['threshold_sweep']}) SELECT threshold, macro_f05 FROM sweep ORDER BY macro_f05 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    c, _, t, a = Q._eval(spark, d)
    return metrics.best_threshold(metrics.threshold_sweep(c, t, a, Q._GRID))


@query()
def expected_f05_drawn(spark, d):
    """The choice by 400 fixed draws."""
    return decide.expected_f05_drawn(Q._claims(spark, d))


@query(f"""WITH {S.CANDIDATES}, {Q._CAT}, x AS (SELECT i, category FROM er WHERE category <> 'correct')
SELECT category, x.i, 'cand' AS kind, p.j, p.p, CAST(t.j IS NOT NULL AS INT) AS is_true, CAST(p.p >= 0.3 AS INT) AS selected FROM x JOIN pairs p ON p.i = x.i LEFT JOIN truth t ON t.i = p.i AND t.j = p.j WHERE t.j IS NOT NULL OR p.p > 0.2
UNION ALL SELECT category, x.i, 'MISSED_TRUE', t.j, NULL, 1, 0 FROM x JOIN truth t ON t.i = x.i WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.i = t.i AND p.j = t.j)""")
def error_dump(spark, d):
    """Candidates and missed targets of every anchor with an error."""
    c, p, t, a = Q._eval(spark, d)
    return metrics.error_dump(metrics.error_examples(metrics.error_rows(p, t, c, a), 1 << 30), c, p, t)


_ALIKE = lambda u, v: (
    f"(levenshtein({u}, {v}) <= 0.3::DOUBLE * greatest(length({u}), length({v})) OR (least(length({u}), length({v})) >= 2 AND {u}[1] = {v}[1] AND regexp_matches(CASE WHEN length({u}) <= length({v}) THEN {v} ELSE {u} END, "
    f"'^' || regexp_replace(CASE WHEN length({u}) <= length({v}) THEN {u} ELSE {v} END, '(.)', '\\1.*', 'g') || '$')))"
)


@query(f"""WITH {S.CANDIDATES}, k AS (SELECT {_D('x.name')} AS a, {_D('y.name')} AS b FROM pairs JOIN e x ON x.id = i JOIN e y ON y.id = j WHERE cc >= 0.4 UNION ALL SELECT string_split(a, ' '), string_split(b, ' ') FROM {Q.values(Q.EQUIV, 'a, b')}),
x AS (SELECT list_filter(list_distinct(a), lambda t: NOT list_contains(b, t)) AS x, list_filter(list_distinct(b), lambda t: NOT list_contains(a, t)) AS y FROM k), o AS (SELECT x[1] AS x, y[1] AS y FROM x WHERE len(x) = 1 AND len(y) = 1)
SELECT least(x, y) AS u, greatest(x, y) AS v, count(*) AS n FROM o WHERE NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(y, '^[0-9]+$') AND {_ALIKE('x', 'y')} GROUP BY ALL""")
def word_substitutions(spark, d):
    """Words that stand for each other in the names of close candidate pairs, and in the worked examples."""
    e = _full(spark, d)
    p = kernel.gather(plan.candidates(e).filter("cc >= 0.4").select("i", "j"), e)
    words = p.select(T.words(F.col("name1")).alias("a"), T.words(F.col("name2")).alias("b"))
    extra = Q.rows(spark, Q.EQUIV, "a string, b string").select(F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    return learn.substitutions(words.unionByName(extra), True)


_FOLDED = f"trim(regexp_replace({S.fold('raw_name')}, '[^a-z0-9]+', ' ', 'g'))"
_RAW = "trim(regexp_replace(lower(raw_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"""WITH {S.RECORDS}, a AS (SELECT string_split({_RAW}, ' ') AS x, string_split({_FOLDED}, ' ') AS y, {_RAW} AS native, {_FOLDED} AS latin FROM e), s AS (SELECT unnest(x) AS token, unnest(y) AS plain FROM a WHERE len(x) = len(y) AND regexp_matches(native, '[^\\x00-\\x7F]') AND NOT regexp_matches(latin, '[^\\x00-\\x7F]')),
n AS (SELECT token, plain, count(*) AS n FROM s GROUP BY ALL) SELECT token, plain, n FROM n QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, plain) = 1 AND n >= 2 AND n >= 0.6 * sum(n) OVER (PARTITION BY token)""")
def word_transliterations(spark, d):
    """Words with letters beyond ASCII in first sentences, and what they are in the folded ones."""
    e = views.entities(spark, d)
    raw = F.trim(F.regexp_replace(F.lower("raw_name"), r"[^\p{L}\p{N}]+", " "))
    return learn.mine_transliterations(e.select(raw.alias("native"), F.col("name").alias("latin")))


@query(f"""WITH {S.RECORDS}, m(token, plain) AS (VALUES ('the', 'article'), ('und', 'and'), ('de', 'of')), x AS (SELECT id, unnest({S.word_list('name')}) AS w, generate_subscripts({S.word_list('name')}, 1) AS pos FROM e)
SELECT e.id, coalesce((SELECT string_agg(coalesce(m.plain, x.w), ' ' ORDER BY x.pos) FROM x LEFT JOIN m ON m.token = x.w WHERE x.id = e.id), '') AS name_map FROM e""")
def rewritten_names(spark, d):
    """Names with the words of a dictionary replaced."""
    table = Q.rows(spark, [("the", "article"), ("und", "and"), ("de", "of")], "token string, plain string")
    return kernel.rewrite(views.entities(spark, d).select("id", "name"), "name", table, "name_map").select("id", "name_map")


# --- learning ----------------------------------------------------------------------------------------------------------


def _labelled(spark, d):
    """Candidate pairs with the context features and their labels."""
    from kinlake.operators import context

    p = context.reverse_context(context.context(plan.candidates(views.entities(spark, d))))
    y = views.truth(spark, d).select("i", "j", F.lit(1).alias("y")).distinct()
    return scratch.materialise(p.join(y, ["i", "j"], "left").na.fill(0, ["y"]), "labelled")


_CHEAP = ("fwd", "cc", "cm", "ca", "rk_cc", "gap_cc", "rk_cm", "gap_cm", "rk_ca", "gap_ca", "n_cand", "rev_rk_cm", "rev_gap_cm", "rev_n")


@query()
def pruner_importance(spark, d):
    """What the pruner's trees gain by each feature, over its folds."""
    from kinlake.operators import models

    report: dict = {}
    models.cross_fit(_labelled(spark, d), "y", _CHEAP, "p0", 2, 3, 5, report=report)
    return Q.rows(spark, models.importance(report, "p0"), "feature string, gain double")


@query()
def cv_probabilities(spark, d):
    """Out-of-fold probabilities by five folds of anchors, beside those of the model of all pairs."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from kinlake.operators import models

    pairs = _labelled(spark, d)
    scored, model = models.train_all(pairs, "y", _CHEAP, "p", 5, 3, 5)
    both = model.transform(VectorAssembler(inputCols=list(_CHEAP), outputCol="_x").transform(scored))
    return both.select("i", "j", "y", "p", vector_to_array("probability")[1].alias("p_all"))
