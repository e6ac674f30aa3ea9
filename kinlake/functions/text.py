"""Scalar normalisers for names and addresses, string -> string (or array), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlake.functions import lexicon as L


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def fold_ascii(s: Column) -> Column:
    """Lower case without marks; ß and ligatures become two letters. Other scripts stay; see fuzzy.fold_scripts."""
    out = F.translate(F.lower(F.coalesce(s, F.lit(""))), L.FOLD_FROM, L.FOLD_TO)
    for a, b in L.FOLD_PAIRS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def token(t: Column) -> Column:
    """One token: leading zeros go, ordinals become numbers, look-alike digits in words become letters."""
    digits, letters = F.length(F.regexp_replace(t, "[^0-9]", "")), F.length(F.regexp_replace(t, "[^a-z]", ""))
    number = F.regexp_replace(F.regexp_replace(t, "(st|nd|rd|th)$", ""), "^0+([0-9])", "$1")
    return (
        F.when(t.rlike("^[0-9]+(st|nd|rd|th)?$"), number)
        .when(t.rlike("^[a-z]") & digits.between(1, 2) & (letters >= 3), F.translate(t, "013457", "oleast"))
        .otherwise(t)
    )


def collapse_initials(s: Column) -> Column:
    """Runs of single letters in a space-separated string become one token."""
    return F.regexp_replace(s, "(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")


def _cleaned(s: Column) -> Column:
    out = F.replace(F.replace(F.replace(fold_ascii(s), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit("")), F.lit("n/a"), F.lit(" "))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def _tokens(s: Column) -> Column:
    return F.filter(F.transform(F.filter(F.split(s, " "), lambda t: t != ""), token), lambda t: ~t.isin("null", "none"))


def clean_tokens(s: Column) -> Column:
    """Folded, cleaned and repaired tokens of a name, separated by single spaces."""
    return collapse_initials(F.array_join(_tokens(_cleaned(s)), " "))


def state_codes(s: Column) -> Column:
    """State names in a cleaned address become their codes, longer names first. Rows without a name skip the replacements."""
    names = sorted(L.STATES, key=lambda n: (-len(n), n))
    out = s
    for name in names:
        out = F.regexp_replace(out, rf"\b{name}\b", L.STATES[name])
    return F.when(s.rlike(rf"\b({'|'.join(names)})\b"), out).otherwise(s)


def native_states(s: Column) -> Column:
    """Names of states in their own scripts become their codes between blanks."""
    out = s
    for name, code in L.NATIVE_STATES.items():
        out = F.replace(out, F.lit(name), F.lit(f" {code} "))
    return F.when(s.rlike("|".join(L.NATIVE_STATES)), out).otherwise(s)


def clean_address(s: Column) -> Column:
    return collapse_initials(F.array_join(_tokens(state_codes(_cleaned(native_states(F.coalesce(s, F.lit("")))))), " "))


def norm_name(s: Column) -> Column:
    """struct(n_full, n_core): abbreviations expanded, repeated words dropped; the core is without legal forms, unless
    nothing else is there."""
    mapped = F.array_distinct(F.transform(F.filter(F.split(clean_tokens(s), " "), lambda t: t != ""), lambda t: F.coalesce(literal_map(L.NAME_WORDS)[t], t)))
    core = F.transform(F.array(mapped), lambda m: F.struct(F.array_join(m, " ").alias("n_full"), F.array_join(F.filter(m, lambda t: ~t.isin(L.LEGAL_WORDS)), " ").alias("n_core")))[0]
    return F.transform(F.array(core), lambda c: F.struct(c["n_full"].alias("n_full"), F.when(c["n_core"] == "", c["n_full"]).otherwise(c["n_core"]).alias("n_core")))[0]


def norm_address(s: Column) -> Column:
    """Abbreviations expanded in one pass; unit words go with the short token after them, and so do the dropped words."""
    pad = F.concat(F.lit(" "), F.replace(clean_address(s), F.lit(" "), F.lit("  ")), F.lit(" "))
    units = "|".join(k for k, v in L.ADDRESS_WORDS.items() if v == "unit")
    kept = F.regexp_replace(pad, f" ({units}) (?: [^ ]{{1,5}} )?", "")
    words = {k: v for k, v in L.ADDRESS_WORDS.items() if v != "unit"}
    mapped = F.transform(F.filter(F.split(kept, " "), lambda t: t != ""), lambda t: F.coalesce(literal_map(words)[t], t))
    return F.array_join(F.filter(mapped, lambda t: ~t.isin(L.ADDRESS_DROP)), " ")


def norm_name_suffix(s: Column) -> Column:
    """The core of a name by position: a leading 'the' and trailing legal forms go while a word remains."""
    plain = F.replace(F.replace(F.replace(fold_ascii(s), F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")), F.lit("'"), F.lit(""))
    text = collapse_initials(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")))
    mapped = F.transform(F.split(text, " "), lambda t: F.coalesce(literal_map(L.SUFFIX_NAME_WORDS)[t], t))
    joined = F.array_join(F.filter(mapped, lambda t: ~t.isin("dba", "aka", "")), " ")
    return F.regexp_replace(F.regexp_replace(joined, "^the (?=.)", ""), f"^(.+?)( ({'|'.join(L.LEGAL_TAIL)}))+$", "$1")


def norm_name_basic(s: Column) -> Column:
    """Folded, without punctuation, blanks squeezed, legal suffixes expanded."""
    out = F.trim(F.regexp_replace(F.regexp_replace(fold_ascii(s), "[^a-z0-9_\\s]", ""), "\\s+", " "))
    for a, b in L.BASIC_SUFFIXES.items():
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return out


def norm_address_basic(s: Column) -> Column:
    """Folded, punctuation but commas as blanks, blanks squeezed, abbreviations expanded one after the other."""
    out = F.trim(F.regexp_replace(F.regexp_replace(fold_ascii(s), "[^a-z0-9_\\s,]", " "), "\\s+", " "))
    for a, b in L.BASIC_ADDRESS_WORDS.items():
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return out


def name_flags(s: Column) -> Column:
    """struct(nat, dom): the share of letters beyond Latin, and whether the name looks like a domain."""
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    native = F.length(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}]", ""), "[\u0000-ɏ]", ""))
    low = F.lower(s)
    dom = F.contains(low, F.lit(".com")) | F.contains(low, F.lit("www")) | ((F.length(s) > 12) & ~F.contains(s, F.lit(" ")))
    return F.struct(F.when(letters > 0, native / letters).otherwise(0.0).alias("nat"), dom.cast("int").alias("dom"))


def token_set(s: Column) -> Column:
    """Sorted distinct runs of letters and digits of the folded text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fold_ascii(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def words(s: Column) -> Column:
    """Tokens of a normalised string, none for an empty one."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def name_derived(core: Column) -> Column:
    """struct(first, compact, acro, ntok) of a normalised name."""
    t = words(core)
    acro = F.when(F.size(t) > 1, F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), "")).otherwise("")
    return F.struct(F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"), F.replace(core, F.lit(" "), F.lit("")).alias("compact"), acro.alias("acro"), F.size(t).cast("bigint").alias("ntok"))


def postal_house(s: Column) -> Column:
    """struct(anorm, postal, house): ZIP+4 cut to 5 digits, 'ddd ddd' joined; postal is the last token of 5 or 6 digits, house the
    first short token that starts with a digit and is a number, with one letter at most."""
    text = F.regexp_replace(F.lower(s), "([0-9]{5})-[0-9]{4}", "$1")
    text = F.trim(F.regexp_replace(fold_ascii(text), "[^a-z0-9]+", " "))
    text = F.trim(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), " ([0-9]{3}) ([0-9]{3}) ", " $1$2 "))
    norm = F.array_join(F.transform(words(text), lambda t: F.coalesce(literal_map(L.SUFFIX_ADDRESS_WORDS)[t], t)), " ")
    postal = F.coalesce(F.get(F.reverse(F.filter(words(norm), lambda t: t.rlike("^[0-9]{5,6}$"))), F.lit(0)), F.lit(""))
    house = F.get(F.filter(words(norm), lambda t: (F.length(t) <= 5) & t.rlike("^[0-9]+[a-z]?$") & (t != postal)), F.lit(0))
    return F.struct(norm.alias("anorm"), postal.alias("postal"), F.coalesce(house, F.lit("")).alias("house"))


def parse_address(address: Column, country: Column) -> Column:
    """struct(pin, zip, postal, city, state), null where a country's format has no such part."""
    parts = F.transform(F.split(F.upper(address), ","), lambda p: F.trim(p))
    nth = lambda k: F.get(F.reverse(parts), F.lit(k - 1))
    found = lambda s, p, g: F.when(s.rlike(p), F.regexp_extract(s, p, g))
    c = F.lower(country)
    codes = "|".join(sorted({v.upper() for v in L.STATES.values()}))
    return F.struct(
        F.when(c == "india", found(address, r"\b([0-9]{6})\b", 1)).alias("pin"),
        F.when(c == "us", found(address, r"\b([0-9]{5})(-[0-9]{4})?\b", 1)).alias("zip"),
        F.when(c == "france", found(address, r"\b(0[1-9]|[1-8][0-9]|9[0-5])[0-9]{3}\b", 1)).alias("postal"),
        F.when((c == "india") & (F.size(parts) >= 2), nth(2)).when(c == "france", nth(1)).alias("city"),
        F.when((c == "india") & (F.size(parts) >= 3), nth(3)).when(c == "us", found(F.upper(address), rf"\b({codes})\b", 1)).alias("state"),
    )


def component_match(a: Column, b: Column) -> Column:
    """1 equal, 0 different, -1 either missing."""
    return F.when(a.isNull() | b.isNull(), -1).otherwise((a == b).cast("int"))


def country_alias(s: Column) -> Column:
    key = F.trim(F.regexp_replace(fold_ascii(s), "[^a-z]+", " "))
    return F.coalesce(literal_map(L.COUNTRIES)[key], key)


def phone_suffix(s: Column) -> Column:
    """The last seven digits, empty if there are fewer."""
    d = F.regexp_replace(s, "[^0-9]", "")
    return F.when(F.length(d) >= 7, F.right(d, F.lit(7))).otherwise("")


def char_ngrams(s: Column, n: int, distinct: bool = True) -> Column:
    """n-grams of a string with spaces as underscores; none for shorter strings."""
    # A lambda binds the string, so that it is not made anew for every position.
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    none = F.array().cast("array<string>")
    grams = F.transform(F.array(F.replace(s, F.lit(" "), F.lit("_"))), lambda t: F.when(F.length(t) >= n, cut(t)).otherwise(none))[0]
    return F.array_distinct(grams) if distinct else grams


def word_char_ngrams(s: Column, n: int = 3) -> Column:
    """n-grams of each word with a space on both sides, repeats included."""
    per = F.transform(words(s), lambda w: char_ngrams(F.concat(F.lit(" "), w, F.lit(" ")), n, False))
    return F.flatten(per)
