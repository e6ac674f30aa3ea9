"""DuckDB SQL of the operators, written from their definitions, for side-by-side checks."""

from __future__ import annotations

from kinlake.functions import lexicon as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def mapped(d: dict, t: str) -> str:
    return f"coalesce(MAP{{{', '.join(f'{q(k)}: {q(v)}' for k, v in d.items())}}}[{t}], {t})"


def fold(s: str) -> str:
    out = f"translate(lower(coalesce({s}, '')), {q(L.FOLD_FROM)}, {q(L.FOLD_TO)})"
    for a, b in L.FOLD_PAIRS.items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def plain(s: str) -> str:
    return f"trim(regexp_replace({fold(s)}, '[^a-z0-9]+', ' ', 'g'))"


def token(t: str) -> str:
    digits, letters = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))", f"length(regexp_replace({t}, '[^a-z]', '', 'g'))"
    bare = f"regexp_extract({t}, '^([0-9]+)', 1)"
    return (
        f"CASE WHEN regexp_matches({t}, '^[0-9]+(st|nd|rd|th)?$') THEN CASE WHEN ltrim({bare}, '0') = '' THEN '0' ELSE ltrim({bare}, '0') END "
        f"WHEN regexp_matches({t}, '^[a-z]') AND {digits} BETWEEN 1 AND 2 AND {letters} >= 3 THEN translate({t}, '013457', 'oleast') ELSE {t} END"
    )


def initials(tokens: str) -> str:
    """Tokens (a list expression, evaluated once by the caller) joined, single letters in a row without spaces."""
    single = lambda x: f"regexp_matches({x}, '^[a-z]$')"
    at = lambda i: f"{tokens}[{i}]"
    return f"array_to_string(list_transform(range(1, len({tokens}) + 1), lambda i: CASE WHEN i = 1 OR ({single(at('i'))} AND {single(at('i - 1'))}) THEN {at('i')} ELSE ' ' || {at('i')} END), '')"


def cleaned(s: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace({fold(s)}, '&', ' and '), '''', ''), 'n/a', ' '), '[^a-z0-9]+', ' ', 'g'))"


def tokens(s: str) -> str:
    return f"list_filter(list_transform(list_filter(string_split({s}, ' '), lambda t: t <> ''), lambda t: {token('t')}), lambda t: t NOT IN ('null', 'none'))"


def states(s: str) -> str:
    out = s
    for name in sorted(L.STATES, key=lambda n: (-len(n), n)):
        out = f"regexp_replace({out}, '\\b{name}\\b', '{L.STATES[name]}', 'g')"
    return out


def native(s: str) -> str:
    out = f"coalesce({s}, '')"
    for name, code in L.NATIVE_STATES.items():
        out = f"replace({out}, {q(name)}, ' {code} ')"
    return out


def unique(xs: str) -> str:
    """Distinct items, first places kept."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def char_ngrams(s: str, n: int) -> str:
    t = f"replace({s}, ' ', '_')"
    return f"list_transform(range(1, length({t}) - {n} + 2), lambda k: substr({t}, k, {n}))"


def word_grams(s: str, n: int = 3) -> str:
    return f"flatten(list_transform(list_filter(string_split({s}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2 - {n} + 2), lambda k: substr('_' || w || '_', k, {n}))))"


def word_list(s: str) -> str:
    return f"list_filter(string_split({s}, ' '), lambda w: w <> '')"


#: Records: id, src, country, name, addr, raw_name, text.
RECORDS = f"""e AS (SELECT doc_id AS id, CAST(substr(source, 4) AS INT) % 3 AS src, upper(lang) AS country, {plain("split_part(text, '.', 1)")} AS name,
 {plain("substr(text, length(split_part(text, '.', 1)) + 2)")} AS addr, split_part(text, '.', 1) AS raw_name, text FROM documents),
truth AS (SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.text = b.text WHERE a.src = 0 AND b.src > 0)"""


def channel(c: str, features: str, max_df: float, floor: int = 50) -> str:
    """CTEs w_<c> (postings) and s_<c> (anchor-target scores)."""
    return f"""tf_{c} AS (SELECT country, id, src, f, count(*) AS tf FROM (SELECT country, id, src, unnest({features}) AS f FROM e) GROUP BY ALL),
df_{c} AS (SELECT d.country, f, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT country, f, count(*) AS df FROM tf_{c} GROUP BY ALL) d
  JOIN (SELECT country, count(*) AS n FROM e GROUP BY ALL) n USING (country) WHERE df >= 2 AND df <= greatest({floor}::DOUBLE, {max_df}::DOUBLE * n)),
r_{c} AS (SELECT country, id, src, f, (1 + ln(tf::DOUBLE)) * idf AS w FROM tf_{c} JOIN df_{c} USING (country, f)),
w_{c} AS (SELECT country, id, src, f, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r_{c}),
s_{c} AS (SELECT a.id AS i, b.id AS j, b.src, round(sum(a.w * b.w), 6) AS score FROM w_{c} a JOIN w_{c} b USING (country, f) WHERE a.src = 0 AND b.src > 0 GROUP BY ALL)"""


def joint(weight: float = 0.8) -> str:
    w2 = f"{weight * weight!r}::DOUBLE"
    return f"""z AS (SELECT id, sqrt(CASE WHEN id IN (SELECT id FROM w_word) THEN 1.0::DOUBLE ELSE 0 END + {w2} * CASE WHEN id IN (SELECT id FROM w_addr) THEN 1 ELSE 0 END) AS z
  FROM (SELECT id FROM w_word UNION SELECT id FROM w_addr)),
s_comb AS (SELECT i, j, src, round((coalesce(a.score, 0) + {w2} * coalesce(b.score, 0)) / (x.z * y.z), 6) AS score
  FROM s_word a FULL JOIN s_addr b USING (i, j, src) JOIN z x ON x.id = i JOIN z y ON y.id = j)"""


def top(source: str, by: str, k: int, ties: str = "i, j") -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {ties}) <= {k}"


CHANNELS = ",\n".join([RECORDS, channel("char", word_grams("name"), 0.05), channel("word", word_list("name"), 0.02), channel("addr", word_list("addr"), 0.02), joint()])

#: Candidates of all channels: i, j, src, fwd, cc, cm, ca and p.
CANDIDATES = f"""{CHANNELS},
u AS (SELECT i, j, src, max(fwd) AS fwd FROM (
  SELECT i, j, src, 1 AS fwd FROM ({top('s_char', 'i, src', 10)}) UNION ALL SELECT i, j, src, 1 FROM ({top('s_comb', 'i, src', 12)})
  UNION ALL SELECT i, j, src, 1 FROM ({top('s_addr', 'i, src', 6)}) UNION ALL SELECT i, j, src, 0 FROM ({top('s_comb', 'j', 3)})) GROUP BY ALL),
pairs AS (SELECT u.i, u.j, u.src, u.fwd, coalesce(a.score, 0) AS cc, coalesce(b.score, 0) AS cm, coalesce(c.score, 0) AS ca, coalesce(b.score, 0) AS p
  FROM u LEFT JOIN s_char a USING (i, j) LEFT JOIN s_comb b USING (i, j) LEFT JOIN s_addr c USING (i, j))"""
