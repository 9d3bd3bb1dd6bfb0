"""Cleaning of business names and addresses as column expressions.

Everything is a chain of built-in functions inside one projection; only text outside ASCII crosses to Python, in Arrow
batches, for Unicode repair and transliteration.  '' stands for a missing value, as in the input.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import vocabulary as V

PHONE, DOMAIN = V.PHONE, V.DOMAIN
LEGAL = r"\b(" + "|".join(V.legal_forms()) + r")\b"


def replace(c: Column, *rules: tuple[str, str]) -> Column:
    """Regular expressions replaced in turn."""
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def pick(values: dict[str, str], key: Column) -> Column:
    """The value of a key in a constant map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


# Unicode


@lru_cache(1 << 14)
def _letter(c: str) -> str:
    """A letter of any script in ASCII, by its parts or its name."""
    plain = "".join(p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p))
    if plain.isascii():
        return plain
    name = unicodedata.name(c, "")
    if m := re.match(r"LATIN (SMALL|CAPITAL) (?:LETTER|LIGATURE) (SHARP S|[A-Z]+)", name):
        word = {"SHARP S": "ss", "ETH": "d", "THORN": "th", "DOTLESS": "i"}.get(m[2], m[2].lower())
        return word if m[1] == "SMALL" else word.capitalize()
    if m := re.search(r"(?:LETTER|VOWEL SIGN|DIGIT) (?:VOCALIC |CANDRA |SHORT )?([A-Z]+)$", name):
        digits = "zero one two three four five six seven eight nine".split()
        word = m[1].lower()
        return str(digits.index(word)) if word in digits else {"aa": "a", "ii": "i", "uu": "u", "ee": "e", "oo": "o"}.get(word, word)
    return {"ANUSVARA": "n", "CANDRABINDU": "n", "VISARGA": "h"}.get(name.rpartition(" ")[2], " " if unicodedata.category(c)[0] in "PSZ" else "")


def _silent(c: str) -> bool:
    name = unicodedata.name(c, "")
    return "VOWEL SIGN" in name or name.endswith(("VIRAMA", "NUKTA"))


def transliterate(text: str) -> str:
    """ASCII of a text: a consonant of an Indic script drops its inherent vowel before a vowel sign, a virama or the word's end."""
    out = []
    for k, c in enumerate(text):
        if c.isascii():
            out.append(c)
            continue
        word = _letter(c)
        name = unicodedata.name(c, "")
        indic = " LETTER " in name and len(word) > 1 and word.endswith("a") and not name.startswith("LATIN")
        follow = text[k + 1] if k + 1 < len(text) else " "
        if indic and (_silent(follow) or not (follow.isalnum() or unicodedata.category(follow)[0] == "M")):
            word = word[:-1]
        out.append(word)
    return "".join(out)


def repair(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, put right where it decodes; stray C1 signs as the marks they stand for."""
    for encoding in ("cp1252", "latin-1"):
        try:
            return unicodedata.normalize("NFKC", text.encode(encoding).decode("utf-8"))
        except UnicodeError:
            continue
    text = re.sub(V.STRAY, lambda m: V.MARKS.get(m[0][-1], " "), text)
    return unicodedata.normalize("NFKC", text)


@F.pandas_udf(StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: transliterate(repair(t)), na_action="ignore")


@F.pandas_udf(StringType())
def _ascii_states(texts: pd.Series) -> pd.Series:
    states = V.native_states()
    known = re.compile("|".join(map(re.escape, states)))
    return texts.map(lambda t: transliterate(known.sub(lambda m: states[m[0]], repair(t))), na_action="ignore")


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(" " if unicodedata.category(c)[0] == "C" else c for c in unicodedata.normalize("NFKC", repair(t))), na_action="ignore")


def to_ascii(c: Column, states: bool = False) -> Column:
    """ASCII text; names of Indian states in their own scripts become English with ``states``.  Null becomes ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\bn\s?[°º]\s*", "no ")
    foreign = c.rlike(r"[^\x00-\x7f]")
    return F.coalesce((_ascii_states if states else _ascii)(F.when(foreign, c)), c)


def safe_text(c: Column) -> Column:
    """Conservative clean-up: repaired, NFKC, control characters as spaces, squashed."""
    c = F.coalesce(c, F.lit(""))
    plain = F.regexp_replace(c, r"\p{C}", " ")
    return squash(F.coalesce(_compose(F.when(c.rlike(r"[^\x00-\x7f]"), c)), plain))


def script_of(c: Column) -> Column:
    """The non-Latin script with most letters in a text, or null."""
    scripts = ["Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Arabic", "Cyrillic", "Greek", "Han"]
    counts = F.array(*[F.struct(F.regexp_count(c, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(s).alias("script")) for s in scripts])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["script"])


# Names


def name_text(c: Column) -> Column:
    """A name in lower-case words, its legal forms still as written."""
    return squash(
        replace(
            F.lower(to_ascii(c)),
            (r"^\s*null\s*$", ""),
            (DOMAIN, "$1"),
            (PHONE, " "),
            (r"\s-\s*$|^\s*-+\s", " "),
            (V.COUNTRY_TAGS, " "),
            ("&", " and "),
            (r"\+", " plus "),
            (r"'s\b", "s"),
            (r"(?<=\b[a-z])\.(?=[a-z]\b)", ""),
            (r"[^a-z0-9 ]+", " "),
        )
    )


def private_limited(c: Column) -> Column:
    """Transliterated spellings of "private limited" in one."""
    return F.regexp_replace(c, V.PRIVATE_LIMITED, "private limited")


def legal_form(text: Column) -> Column:
    """The legal forms in a cleaned name, each once, sorted; "private limited" takes "limited" in."""
    forms = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LEGAL), F.lit(1)), lambda v: pick(V.legal_forms(), v)))
    forms = F.when(F.array_contains(forms, "private limited"), F.array_remove(forms, "limited")).otherwise(forms)
    return F.concat_ws(" ", F.array_sort(forms))


def name_norm(text: Column) -> Column:
    """A cleaned name with each legal form as one token."""
    tokens = {v: form.replace(" ", "_") for v, form in V.legal_forms().items()}
    found = F.transform(F.regexp_extract_all(text, F.lit(LEGAL), F.lit(1)), lambda v: pick(tokens, v))
    between = F.split(text, LEGAL, -1)
    joined = F.zip_with(between, found, lambda a, b: F.concat_ws(" ", a, b))
    return squash(F.array_join(joined, " "))


def name_core(text: Column) -> Column:
    """A cleaned name without legal forms and words that identify nothing."""
    stop = F.array(*[F.lit(w) for w in V.NAME_STOPWORDS])
    words = F.split(squash(F.regexp_replace(text, LEGAL, " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(stop, w)), " ")


# Addresses


def address_text(c: Column) -> Column:
    return replace(
        F.lower(to_ascii(c, states=True)),
        (r"\b(h|s|f|p|g)\.\s*no\b\.?", "$1no"),
        (r"\bp\.?\s?o\.?\s?box\b", "pobox"),
        (r"\.", " "),
        ("'", ""),
    )


def _by_country(country: Column, values: dict, other: Column, make) -> Column:
    out = None
    for name, v in values.items():
        if name:
            out = F.when(country == name, make(v)) if out is None else out.when(country == name, make(v))
    return out.otherwise(other)


def address_parts(text: Column, country: Column) -> Column:
    """Components of an address: array of (text, region), abbreviations spelled out, empty and null-like ones gone, each once."""
    nulls = F.array(*[F.lit(w) for w in V.ADDRESS_NULLS])
    parts = F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(p, r"[^a-z0-9 /-]+", " ")))
    parts = F.filter(parts, lambda p: (p != "") & ~F.array_contains(nulls, p))

    def spelled(p: Column, words: dict[str, str]) -> Column:
        return F.array_join(F.transform(F.split(squash(p), " "), lambda t: F.coalesce(pick(words, t), t)), " ")

    def one(p: Column) -> Column:
        region = _by_country(country, V.regions(), F.lit(None).cast("string"), lambda m: pick(m, F.replace(p, F.lit("-"), F.lit(" "))))
        words = V.address_words()
        text = F.coalesce(region, _by_country(country, words, spelled(p, words[""]), lambda m: spelled(p, m)))
        return F.struct(text.alias("text"), region.alias("region"))

    return F.array_distinct(F.filter(F.transform(parts, one), lambda p: p["text"] != ""))


def postcode(text: Column, country: Column) -> Column:
    found = _by_country(country, V.POSTCODES, F.regexp_extract(text, V.POSTCODES[""], 1), lambda p: F.regexp_extract(text, p, 1))
    return F.replace(found, F.lit(" "), F.lit(""))


def clean_records(records: DataFrame) -> DataFrame:
    """``records`` (business_name, business_address, country and more) with name_norm, name_core, legal_form, addr_norm, region,
    postcode and house_no; the country is tidied.  A null field is ''."""
    out = records.withColumn("country", squash(to_ascii(F.col("country"))))
    out = out.withColumn("_name", private_limited(name_text(F.col("business_name")))).withColumn("_address", address_text(F.col("business_address")))
    out = out.withColumn("_parts", address_parts(F.col("_address"), F.col("country")))
    texts = F.array_distinct(F.transform("_parts", lambda p: p["text"]))
    out = out.withColumns(
        {
            "name_norm": name_norm(F.col("_name")),
            "name_core": name_core(F.col("_name")),
            "legal_form": legal_form(F.col("_name")),
            "addr_norm": F.array_join(texts, ", "),
            "region": F.coalesce(F.get(F.filter(F.transform("_parts", lambda p: p["region"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")),
            "postcode": postcode(F.col("_address"), F.col("country")),
        }
    )
    return out.withColumn("house_no", F.regexp_extract("addr_norm", V.HOUSE, 1)).drop("_name", "_address", "_parts")


# The plainer normal form, for word bags


def lexical(c: Column) -> Column:
    """Lower-case ASCII words and numbers, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(to_ascii(c)), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def strip_suffixes(c: Column, suffixes: str = "co company corp corporation inc incorporated limited llc llp ltd plc private pvt") -> Column:
    """A name without legal words at its end, at least one word staying."""
    return F.regexp_replace(c, rf"^(\S+(?: \S+)*?)(?: (?:{'|'.join(suffixes.split())}))+$", "$1")


def bags(name: Column, address: Column) -> dict[str, Column]:
    """Word bags of a lexical name and address: character trigrams of the joined name, initials, and numbers."""
    joined = F.replace(name, F.lit(" "), F.lit(""))
    n = F.length(joined)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat(F.lit("g"), F.substring(joined, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    initials = F.concat(F.lit("i"), F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), ""))
    short = F.when((n > 0) & (n <= 8), F.array(F.concat(F.lit("i"), joined))).otherwise(F.array().cast("array<string>"))
    numbers = F.transform(F.regexp_extract_all(F.concat_ws(" ", name, address), F.lit(r"(\d+)"), F.lit(1)), lambda d: F.concat(F.lit("n"), d))
    return {
        "grams": F.array_distinct(grams),
        "initials": F.when(n > 0, F.array_distinct(F.concat(F.array(initials), short))).otherwise(F.array().cast("array<string>")),
        "numbers": F.array_distinct(numbers),
    }


#: Kinds of noise in raw fields, by the pattern that shows it.
NOISE = {
    "phone": PHONE,
    "domain": r"(?i)\b[a-z0-9-]+\.(?:com|net|org|in|fr)\b",
    "leading_dash": r"^\s*-",
    "trailing_separator": r"[-,;:]\s*$",
    "double_space": r"\s{2,}",
    "edge_space": r"^\s|\s$",
    "ampersand": "&",
    "parentheses": r"[()]",
    "digits": r"\d",
    "only_upper": r"^[^a-z]*[A-Z][^a-z]*$",
    "only_lower": r"^[^A-Z]*[a-z][^A-Z]*$",
    "dotted_initials": r"\b[A-Za-z]\.[A-Za-z]\.",
    "apostrophe": "['’]",
    "slash": "/",
    "hash": "#",
    "non_ascii": r"[^\x00-\x7f]",
    "repeated_letter": r"([A-Za-z])\1\1",
    "mixed_token": r"\b(?:[a-z]+\d+[a-z]+|\d+[a-z]+\d+)\b",
    "null_word": r"(?i)\bnull\b",
}
