"""Citable text spans: sentences, three-sentence windows, and resolving cited span ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill import scale
from litmill.functions import markup

# Fixed value: version stamp of the splitting rule.
SEGMENTER_VERSION = "sentence-window-v1"
SPAN_TYPE = (
    "array<struct<span_id:string,source:string,sequence:int,text:string,"
    "start_offset:int,end_offset:int>>"
)


def sentences(df: DataFrame, col: str, guard_abbreviations: bool = False) -> DataFrame:
    """One row per sentence with its place and trimmed offsets."""
    bounds = markup.sentence_bounds(F.col(col), guard_abbreviations)
    cut = df.withColumn("_b", bounds)
    at = F.posexplode(F.sequence(F.lit(0), (F.size("_b") / 2).cast("int") - 1))
    rows = cut.filter(F.size("_b") > 0).select(*df.columns, "_b", at.alias("sentence", "_i"))
    start = F.get(F.col("_b"), F.col("_i") * 2)
    end = F.get(F.col("_b"), F.col("_i") * 2 + 1)
    return rows.select(
        *df.columns, "sentence", start.alias("start_offset"), end.alias("end_offset")
    )


def _windows(article: Column, source: str, body: Column, bounds: Column, window: int) -> Column:
    count = (F.size(bounds) / 2).cast("int")

    def span(i: Column) -> Column:
        start = F.get(bounds, i * 2)
        end = F.get(bounds, F.least(i + (window - 1), count - 1) * 2 + 1)
        number = (i / window).cast("int") + 1
        return F.struct(
            F.format_string(f"%s:{source}:%03d", article, number).alias("span_id"),
            F.lit(source).alias("source"),
            number.alias("sequence"),
            F.substring(body, start + 1, end - start).alias("text"),
            start.alias("start_offset"),
            end.alias("end_offset"),
        )

    starts = F.sequence(F.lit(0), count - 1, F.lit(window))
    return F.when(count > 0, F.transform(starts, span)).otherwise(
        F.array().cast(SPAN_TYPE)
    ).cast(SPAN_TYPE)


def with_spans(
    df: DataFrame, article: str, title: str = "title", abstract: str = "abstract", window: int = 3
) -> DataFrame:
    """Add ``spans``: windows of at most ``window`` sentences of title and abstract."""
    key = F.col(article).cast("string")
    cut = df.withColumn("_t", markup.sentence_bounds(F.coalesce(title, F.lit("")))).withColumn(
        "_a", markup.sentence_bounds(F.coalesce(abstract, F.lit("")))
    )
    spans = F.concat(
        _windows(key, "title", F.col(title), F.col("_t"), window),
        _windows(key, "abstract", F.col(abstract), F.col("_a"), window),
    )
    return cut.select(*df.columns, spans.alias("spans"))


def span_rows(df: DataFrame, article: str, **kw) -> DataFrame:
    """Spans in long form, one row each."""
    made = with_spans(df, article, **kw)
    # The outer form does not test the array's size first, which would build it twice.
    rows = made.select(article, F.explode_outer("spans").alias("s")).filter("s is not null")
    return rows.select(article, "s.*")


def backfill(articles: DataFrame, article: str = "article_id") -> DataFrame:
    """Add spans and the version stamp where they are still null; other rows stay as they are."""
    todo = articles.filter("spans is null").drop("spans", "span_version")
    made = with_spans(todo, article).withColumn("span_version", F.lit(SEGMENTER_VERSION))
    return articles.filter("spans is not null").unionByName(made)


def resolve_spans(cites: DataFrame, spans: DataFrame, keys: list[str], article: str) -> DataFrame:
    """Texts of cited spans, in text order, joined by line breaks, with issue codes.

    ``cites`` holds ``keys``, the citing article and an array ``span_ids``.
    Unknown, repeated and foreign ids are reported, and then no quote is given.
    """
    cited = cites.select(*keys, F.col(article).alias("_by"), F.explode("span_ids").alias("span_id"))
    known = spans.select("span_id", F.col(article).alias("_owner"), "source", "sequence", "text")
    met = cited.join(known, ["span_id"], "left")
    order = F.struct(
        F.when(F.col("source") == "title", 0).otherwise(1).alias("o"), "sequence", "text"
    )
    foreign = F.col("_owner") != F.col("_by")
    got = met.groupBy(*keys).agg(
        F.count("*").alias("cited"),
        F.count_if(F.col("_owner").isNull()).alias("unknown"),
        F.count_if(foreign).alias("foreign"),
        F.count_distinct("span_id").alias("distinct_ids"),
        F.array_sort(F.collect_list(F.when(F.col("_owner").isNotNull(), order))).alias("_texts"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("unknown") > 0, F.lit("unknown_span")),
            F.when(F.col("foreign") > 0, F.lit("foreign_span")),
            F.when(F.col("distinct_ids") < F.col("cited"), F.lit("repeated_span")),
        )
    )
    quote = F.array_join(F.transform("_texts", lambda x: x["text"]), "\n")
    return got.select(
        *keys,
        "cited",
        issues.alias("issues"),
        F.when(F.size(issues) == 0, quote).alias("quote"),
    )
