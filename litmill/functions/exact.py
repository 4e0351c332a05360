"""Arrow forms of the text rules, for exact compatibility normalisation and case folding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def fold_words(value: str) -> str:
    """Compatibility form, case folded, words parted by single blanks."""
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join(re.sub(r"\W+", " ", folded).split())


def fold_term(value: str) -> str:
    """Compatibility form, case folded, white space collapsed, punctuation kept."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def _mapped(fn):
    def series(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return series


def match_text(c: Column) -> Column:
    return F.pandas_udf(_mapped(fold_words), "string")(c)


def title_text(c: Column) -> Column:
    """Exact title rule; null stands for the error of an empty one."""
    s = match_text(c)
    return F.when(s != "", s)


def term_text(c: Column) -> Column:
    return F.pandas_udf(_mapped(fold_term), "string")(c)
