"""Texts of record pairs for a scoring model outside Spark, and regular-expression tags of concepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a record text may be about.
CONCEPTS = {
    "legal": r"\b(?:llc|inc|ltd|limited|corp|sarl|gmbh|pvt)\b",
    "number": r"[0-9]",
    "food": r"\b(?:cafe|coffee|restaurant|bakery|pizza|seafood|grill)\b",
    "health": r"\b(?:clinic|dental|hospital|medical|pharmacy|health)\b",
    "trade": r"\b(?:export|import|traders?|trading|wholesale|store|shop)s?\b",
    "technology": r"\b(?:tech|technolog\w+|software|systems?|digital|data)\b",
}


def field(c: Column) -> Column:
    """A field as it goes into a prompt: missing ones are named, control marks broken up."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "[missing]").otherwise(F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")))


def pair_prompt(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """One text of two records, field by field."""
    side = lambda name, fields: F.concat_ws("\n", F.lit(name), *[F.concat(F.lit(f"{k}: "), field(c)) for k, c in fields.items()])
    return F.concat_ws("\n\n", side("Record A", left), side("Record B", right))


def head_and_tail(c: Column, budget: int) -> Column:
    """A text of at most ``budget`` words: its head and its tail, an ellipsis between."""
    w = F.split(F.trim(c), r"\s+")
    head = (budget + 1) // 2
    cut = F.concat_ws(" ", F.array_join(F.slice(w, 1, head), " "), F.lit("..."), F.array_join(F.slice(w, -(budget - head), budget - head), " ")) if budget > 1 else F.get(w, F.lit(0))
    return F.when(F.size(w) <= budget, F.array_join(w, " ")).otherwise(cut)


def concept_tags(c: Column) -> dict[str, Column]:
    return {k: F.lower(c).rlike(p) for k, p in CONCEPTS.items()}
