"""Tokens of lexical search and of hashed features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that lexical search ignores.
STOPWORDS = (
    "a an and are as at be but by for from has have he her his i if in into is it its "
    "of on or she that the their them they this to was were what when where which who "
    "will with you your do does did not no so such than then there these those we us"
).split()
TERM = "[a-z0-9]+(?:['-][a-z0-9]+)*"


def search_terms(text: Column, stopwords: bool = False) -> Column:
    """Terms in order: a compound (a-b, a'b) gives itself and its parts; stop words go last, unless kept. Null: none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(TERM), F.lit(0))
    each = F.flatten(F.transform(found, lambda w: F.when(w.rlike("['-]"), F.concat(F.array(w), F.split(w, "['-]"))).otherwise(F.array(w))))
    spread = F.when(low.rlike("[a-z0-9]['-][a-z0-9]"), each).otherwise(found)  # most texts have no compounds to take apart
    return spread if stopwords else F.filter(spread, lambda w: ~w.isin(*STOPWORDS))


def hash_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def features(terms: Column) -> Column:
    """The terms, then each pair of neighbours as a_b."""
    pairs = F.zip_with(F.slice(terms, 1, F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, 2, F.greatest(F.size(terms) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(terms, pairs)
