"""Samples and question sets taken from stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(articles: DataFrame, design: Column, n: int, strict: bool = True) -> DataFrame:
    """The newest ``n`` articles of a design with an abstract; fewer than n is an error."""
    rows = articles.filter(design & F.col("abstract_available"))
    out = rows.orderBy(F.desc_nulls_last("publication_date"), F.asc("record_id")).limit(n)
    if strict and out.count() < n:
        raise ValueError(f"fewer than {n} articles")
    return out
