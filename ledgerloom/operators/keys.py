"""Blocking keys of cleaned records, as one projection and an explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import vocabulary as V
from ledgerloom.functions.text import pick

#: Weights of key families in the passes by name, by address and by both.
BY_NAME = {"name": 1.0, "phon": 0.5, "join": 1.0, "nreg": 1.0, "init": 0.3}
BY_ADDRESS = {"addr": 1.0, "anum": 0.5, "house": 1.0}
BY_ALL = BY_NAME | BY_ADDRESS


def undo_leet(t: Column) -> Column:
    """Digits for letters undone in words that mix both."""
    return F.when(t.rlike("[a-z]") & t.rlike("[0-9]"), F.translate(t, *V.LEET)).otherwise(t)


def skeleton(t: Column) -> Column:
    """Consonants of a word by sound; the word itself if it has none."""
    s = t
    for pattern, by in (("ph", "f"), ("([bcdfgjklmnpqrstvwxz])h", "$1"), ("[cq]", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("[aeiou]", ""), (r"(.)\1+", "$1")):
        s = F.regexp_replace(s, pattern, by)
    return F.when(s == "", t).otherwise(s)


def zero_strip(t: Column) -> Column:
    """A number without leading zeros."""
    return F.when(t.rlike("^0+$"), F.lit("0")).otherwise(F.regexp_replace(t, "^0+(?=[0-9])", ""))


def _one_address_token(t: Column) -> Column:
    ordinals = {w: str(k) for k, w in enumerate(V.ORDINALS)}
    return (
        F.when(pick(ordinals, t).isNotNull(), pick(ordinals, t))
        .when(t.rlike("^[0-9]+(st|nd|rd|th)$"), F.regexp_extract(t, "^0*([0-9]+)(?:st|nd|rd|th)$", 1))
        .when(t.rlike("^[0-9]+$"), zero_strip(t))
        .otherwise(t)
    )


def address_tokens(t: Column) -> Column:
    """Canonical tokens of a word of an address: numbers without zeros, ordinals as numbers, ranges and unit suffixes in two."""
    t = F.regexp_replace(t, "^[-/]+|[-/]+$", "")
    two = F.filter(F.split(t, "-"), lambda p: p != "")
    halves = t.rlike("^[0-9]") & t.contains("-") & (F.size(two) == 2) & F.coalesce(F.get(two, F.lit(0)).rlike("^[0-9]+$"), F.lit(False))
    return F.when(t == "", F.array().cast("array<string>")).when(halves, F.transform(F.transform(two, lambda p: F.regexp_replace(p, "^/+|/+$", "")), _one_address_token)).otherwise(F.array(_one_address_token(t)))


def _keys(family: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(family).alias("family"), k.alias("key")))


def _grams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    none = F.array().cast("array<string>")
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), ""))).otherwise(none)


def record_keys(records: DataFrame, name: str = "name_core", address: str = "addr_norm", region: str = "region", leet: bool = True) -> DataFrame:
    """``records`` (with country) with ``keys``: array of (family, key), each once; with ``leet``, digits for letters in names are undone."""
    none = F.array().cast("array<string>")
    own = F.coalesce(F.col(region), F.lit(""))
    words = F.filter(F.split(F.coalesce(F.col(name), F.lit("")), " +"), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]$"))
    out = records.withColumn("_own", own).withColumn("_region", F.coalesce(pick(V.split_states(), own), own)).withColumn("_words", F.transform(words, undo_leet) if leet else words)
    w, joined, area = F.col("_words"), F.array_join("_words", ""), F.col("_region")
    raw = F.filter(F.split(F.replace(F.coalesce(F.col(address), F.lit("")), F.lit(","), F.lit(" ")), " +"), lambda t: t != "")
    generic = F.array(*[F.lit(x) for x in V.ADDRESS_GENERIC])
    tokens = F.filter(F.flatten(F.transform(raw, address_tokens)), lambda t: (t != "") & ~F.array_contains(generic, t) & (t != F.col("_own")) & (t != area))
    out = out.withColumn("_places", tokens)
    p = F.col("_places")
    streets = F.filter(p, lambda t: ~t.rlike("^[0-9]") & (F.length(t) >= 3))
    house, street = F.get(F.filter(p, lambda t: t.rlike("^[0-9]")), F.lit(0)), F.get(streets, F.lit(0))
    initials = F.when(F.size(w) >= 2, F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), "")).when(joined.rlike("^[a-z]{2,4}$"), joined)
    families = [
        ("name", F.transform(F.concat(w, _grams(w, 2), _grams(w, 3)), lambda t: F.concat(F.lit("n|"), t))),
        ("nreg", F.when(area != "", F.transform(w, lambda t: F.concat_ws("|", F.lit("r"), area, t))).otherwise(none)),
        ("phon", F.transform(F.filter(w, lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$")), lambda t: F.concat(F.lit("p|"), skeleton(t)))),
        ("join", F.when(F.length(joined) >= 6, F.array(F.concat(F.lit("j|"), joined))).otherwise(none)),
        ("init", F.when(initials.isNotNull(), F.array(F.concat(F.lit("i|"), initials))).otherwise(none)),
        ("addr", F.transform(F.filter(p, lambda t: t.rlike("^[0-9]") | (F.length(t) >= 3)), lambda t: F.concat_ws("|", F.lit("a"), area, t))),
        ("anum", F.transform(F.filter(p, lambda t: (F.length(t) >= 3) & t.rlike("[0-9]")), lambda t: F.concat(F.lit("g|"), t))),
        ("house", F.when(house.isNotNull() & street.isNotNull(), F.array(F.concat_ws("|", F.lit("h"), house, street))).otherwise(none)),
    ]
    return out.withColumn("keys", F.array_distinct(F.concat(*[_keys(f, k) for f, k in families]))).drop("_own", "_region", "_words", "_places")


def exploded(keyed: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(id, country, family, key), one row for each key of a record."""
    # explode_outer: else the optimiser adds a filter on the keys' number, which computes them once more
    return keyed.select(F.col(id_col).alias("id"), "country", F.explode_outer("keys").alias("k")).select("id", "country", "k.family", "k.key").where("key is not null")
