"""Rank the retained set by coverage contribution and cut it for the recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litmill import scale
from litmill.operators.quality import codes

# Contribution scores and the coverage states that count as gaps.
CONTRIBUTION_SCORES = {"high": 3.0, "medium": 2.0, "low": 1.0, "none": 0.0}
GAP_STATES = ("absent", "partial", "indirect", "conflicting")
# Order of preference among full-text formats, one per use.
FORMAT_ORDERS = {
    "store": ("pdf", "xml", "html", "epub", "text", "other"),
    "provider": ("pdf", "epub", "html", "xml", "text", "other"),
    "oa": ("pdf", "epub", "xml", "html", "text", "tgz", "other"),
}


def contribution_score(level: Column) -> Column:
    pairs = [F.lit(x) for kv in CONTRIBUTION_SCORES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), level)


def coverage_gaps(coverage: DataFrame) -> DataFrame:
    """One ``concept:status`` row per concept that is not directly covered."""
    return coverage.filter(F.col("status").isin(*GAP_STATES)).withColumn(
        "gap", F.concat_ws(":", "concept", "status")
    )


def join_scores(scores: DataFrame, contributions: DataFrame, publication: DataFrame) -> DataFrame:
    """Scores, contributions and dates side by side; ids not covered by all three are flagged."""
    a = scores.withColumn("_a", F.lit(1))
    b = contributions.withColumn("_b", F.lit(1))
    c = publication.withColumn("_c", F.lit(1))
    rows = a.join(b, "article_id", "full_outer").join(c, "article_id", "full_outer")
    return rows.withColumn(
        "issues",
        codes(
            (F.col("_a").isNull(), "no_score"),
            (F.col("_b").isNull(), "no_contribution"),
            (F.col("_c").isNull(), "no_date_row"),
        ),
    ).drop("_a", "_b", "_c")


def retained_order() -> list[Column]:
    return [
        F.desc("contribution_score"),
        F.desc("composite_score"),
        F.desc_nulls_last("publication_date"),
        F.asc("article_id"),
    ]


def fallback_order() -> list[Column]:
    return [F.desc("composite_score"), F.asc("article_id")]


def rank_retained(df: DataFrame) -> DataFrame:
    """Contribution, composite, newest date (unknown last), id."""
    return scale.running_sum(df, [], retained_order(), name="position")


def rank_fallback(df: DataFrame) -> DataFrame:
    """Composite score, id: used when no contributions are at hand."""
    return scale.running_sum(df, [], fallback_order(), name="position")


def truncate(
    df: DataFrame, order: list[Column], above: int | None = None, keep: int = 25, key: str = "article_id"
) -> DataFrame:
    """More than ``above`` rows: the first ``keep`` stay and the rest are marked truncated; without it all are kept.

    Only a bounded top list and a row count are needed, not a global window.
    """
    if above is None:
        return df.withColumn("window", F.lit("kept"))
    if not 1 <= keep <= above:
        raise ValueError("keep must be between 1 and above")
    top = df.orderBy(*order).limit(keep).select(key, F.lit(True).alias("_top"))
    total = df.agg(F.count("*").alias("n")).scalar()
    marked = df.join(F.broadcast(top), key, "left").withColumn("_n", total)
    kept = (F.col("_n") <= above) | F.coalesce("_top", F.lit(False))
    return marked.withColumn(
        "window", F.when(kept, F.lit("kept")).otherwise(F.lit("truncated"))
    ).drop("_top", "_n")


def chunks(
    df: DataFrame, order: list[Column], size: int = 3, top: int | None = None
) -> DataFrame:
    """All rows, or the first ``top`` if given, numbered and cut into contiguous chunks of ``size``."""
    if top is None:
        numbered = scale.running_sum(df, [], order, name="position")
    else:
        # ``top`` rows at most reach this window.
        numbered = df.orderBy(*order).limit(top).withColumn("position", F.row_number().over(W.orderBy(*order)))
    return numbered.withColumn("chunk", F.floor((F.col("position") - 1) / size).cast("int"))


def keep_selected(chunked: DataFrame, size: int = 3, key: str = "article_id") -> DataFrame:
    """Up to ``size`` selected rows per chunk; if nothing was selected, the first ``size`` rows."""
    per = W.partitionBy("chunk").orderBy("position")
    picked = chunked.filter("selected").withColumn("_rn", F.row_number().over(per))
    picked = picked.filter(F.col("_rn") <= size).drop("_rn")
    any_picked = chunked.agg(F.coalesce(F.bool_or("selected"), F.lit(False)).alias("x")).scalar()
    spare = chunked.orderBy("position").limit(size).withColumn("_any", any_picked)
    return picked.unionByName(spare.filter("not _any").drop("_any"))


def format_rank(fmt: Column, use: str = "store") -> Column:
    pairs = [F.lit(x) for i, f in enumerate(FORMAT_ORDERS[use]) for x in (f, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(fmt)), F.lit(99))


def best_resource(
    resources: DataFrame, use: str = "store", by: str = "article_id", open_only: bool = True
) -> DataFrame:
    """Best downloadable full text per article: format, then preferred, then resource id."""
    fit = F.col("is_downloadable")
    if open_only:
        fit = fit & F.col("is_open_access")
    order = F.struct(
        format_rank(F.col("format"), use),
        ~F.coalesce("is_preferred", F.lit(False)),
        F.col("resource_id").cast("string"),
    )
    rest = [c for c in resources.columns if c != by]
    best = resources.filter(fit).groupBy(by).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(by, "r.*")


def one_preferred(resources: DataFrame, by: str = "article_id") -> DataFrame:
    """At most one preferred resource per article: best format, then URL, of the newest run."""
    order = F.struct(-F.col("run_seq"), format_rank(F.col("format")), F.col("url"))
    best = (
        resources.filter("is_downloadable")
        .groupBy(by)
        .agg(F.min_by("url", order).alias("_url"))
    )
    rows = resources.drop("is_preferred").join(best, [by], "left")
    return rows.withColumn(
        "is_preferred", F.col("is_downloadable") & F.col("url").eqNullSafe(F.col("_url"))
    ).drop("_url")


def attach_best_resource(articles: DataFrame, resources: DataFrame, **kw) -> DataFrame:
    """Articles with their best full text, if there is one."""
    best = best_resource(resources, **kw).select(
        "article_id", "resource_id", F.lower("format").alias("format"), "url"
    )
    return articles.join(best, "article_id", "left")


def candidate_issues(df: DataFrame) -> DataFrame:
    """Recommendation input: unique ids, finite scores, the summary belongs to its candidate."""
    counts = df.groupBy("article_id").agg(F.count("*").alias("_n"))
    rows = df.join(counts, ["article_id"], "left")
    score = F.col("composite_score")
    infinite = F.isnan(score) | (F.abs(score) == float("inf"))
    return rows.withColumn(
        "issues",
        codes(
            (F.col("article_id").isNull(), "no_article_id"),
            (F.col("_n") > 1, "repeated_article_id"),
            (score.isNull() | infinite, "score_not_finite"),
            (~F.col("has_summary"), "no_summary"),
            (
                F.col("summary_article_id").isNotNull()
                & (F.col("summary_article_id") != F.col("article_id")),
                "summary_of_other_article",
            ),
        ),
    ).drop("_n")
