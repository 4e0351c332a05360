"""Resolve a corpus, rank it for a question, screen its quality, and recommend."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill import scale
from litmill.functions import dates, text
from litmill.operators import audit, portfolio, quality, rank, records, resolve, routing
from litmill.operators.ordering import balanced_batches
from litmill.operators.search import Concept


@dataclass
class Resolved:
    """What resolving a corpus gives."""

    articles: DataFrame
    clusters: DataFrame
    keys: DataFrame
    bad: DataFrame
    runs: DataFrame


def resolve_corpus(rec: DataFrame, pack_lists: bool = True) -> Resolved:
    """Records to canonical articles: contract rules, identity keys, components, merge.

    ``rec`` must be cheap to read again (a table, not a long lineage).
    """
    good, bad, runs = records.split_quarantine(rec)
    keys = resolve.staged_keys(good)
    clusters = scale.stage(resolve.components(keys, staged=True), "clusters")
    # Winners are good records, so their texts are looked up without judging all records again.
    merged = resolve.merge_clusters(good, clusters, pack_lists, rec)
    return Resolved(merged, clusters, keys, bad, runs)


def rank_corpus(
    articles: DataFrame,
    profile: Sequence[Concept],
    reference: dt.date,
    vectors: DataFrame,
    query_vector: Sequence[float],
    limit: int = 50,
    coarse: bool = False,
) -> DataFrame:
    """Every article with its rank, parts of the score, status and reason.

    articles: article_id, title, abstract, publication_date, publication_year,
    publication_types, study_design.  vectors: article_id, embedding; an article
    without one ranks last with status no_vector.  ``coarse`` cuts before the vectors
    are read, for interactive use; by default nothing is cut.  The texts
    are mapped once; only thin score rows are written and ranked.
    """
    from litmill.functions.values import cosine_to

    title = text.match_text(F.col("title"))
    abstract = text.match_text(F.coalesce("abstract", F.lit("")))
    scored = rank.match_concepts(
        articles.withColumn("_tm", title).withColumn("_am", abstract), profile, F.col("_tm"), F.col("_am")
    )
    scored = scored.select(
        "article_id", "title", "publication_date", "publication_year", "keyword_score",
        "core_matched", "matched_concepts",
        routing.study_group(
            F.col("publication_types"), F.col("study_design"), F.col("abstract")
        ).alias("study_group"),
        dates.recency(F.col("publication_date"), F.col("publication_year"), reference).alias(
            "recency_score"
        ),
    )
    scored = scale.stage(scored, "scored")
    kept = rank.coarse_filter(scored, 200).filter("coarse_status = 'passed'").drop("coarse_status") if coarse else scored
    kept = kept.join(vectors.select("article_id", "embedding"), "article_id", "left")
    final = rank.candidate_score(kept, cosine_to(F.col("embedding"), query_vector)).drop("embedding")
    final = scale.stage(final, "candidates")
    ranked = rank.decide(rank.rank(final), limit)
    return ranked.withColumn(
        "reasons",
        rank.selection_reasons(
            F.col("core_matched"), F.col("matched_concepts"), F.col("publication_date"),
            F.col("publication_year"),
        ),
    )


@dataclass
class Screened:
    """What quality screening gives."""

    retained: DataFrame
    excluded: DataFrame
    unsupported: DataFrame
    batches: DataFrame
    issues: DataFrame


def screen_quality(
    articles: DataFrame,
    criteria: DataFrame,
    relevance: DataFrame,
    rubric: DataFrame,
    threshold: float = quality.THRESHOLD,
    batch_size: int = 1,
    weights: quality.Weights = quality.Weights(),
    journal: Column | None = None,
    recency: Column | None = None,
) -> Screened:
    """Route articles, check their assessments against the rubric, score and cut them.

    articles: article_id (numeric), study_group.  criteria: article_id, study_type,
    criterion_id, status.  relevance: article_id, relevance_score, answerability_score.
    Articles with any issue take no part in the cut; they are listed in ``issues``.
    """
    supported, unsupported = routing.split_supported(articles)
    batches = balanced_batches(
        supported.select("article_id", "study_group"), "study_group", batch_size,
        [F.asc("article_id")],
    )
    cover = quality.rubric_cover(criteria, rubric).select("article_id", F.col("issues").alias("a"))
    paired = quality.pair_assessments(
        relevance, criteria.select("article_id").distinct(), supported
    ).select("article_id", F.col("issues").alias("b"))
    scores = quality.preliminary_quality(criteria)
    none = F.array().cast("array<string>")
    checks = (
        paired.join(cover, "article_id", "full_outer")
        .join(scores.select("article_id", F.col("issues").alias("c"), "quality_score"), "article_id", "full_outer")
        .withColumn("issues", F.concat(*[F.coalesce(x, none) for x in ("a", "b", "c")]))
        .drop("a", "b", "c")
    )
    checks = scale.stage(checks, "checks")
    fine = checks.filter(F.size("issues") == 0).select("article_id", "quality_score")
    ready = supported.join(fine, "article_id").join(relevance, "article_id")
    scored = quality.composite(ready, weights, journal, recency)
    kept, dropped = quality.partition_by_threshold(scored, threshold)
    return Screened(kept, dropped, unsupported, batches, checks.filter(F.size("issues") > 0))


def rank_portfolio(
    retained: DataFrame, contributions: DataFrame | None, above: int | None = None, keep: int = 25
) -> DataFrame:
    """Retained articles in recommendation order, marked kept or truncated.

    Without contributions the composite score alone decides.
    """
    if contributions is None:
        rows, order = retained, portfolio.fallback_order()
        ranked = portfolio.rank_fallback(rows)
    else:
        rows = retained.join(
            contributions.select(
                "article_id", portfolio.contribution_score(F.col("level")).alias("contribution_score")
            ),
            "article_id",
        )
        order = portfolio.retained_order()
        ranked = portfolio.rank_retained(rows)
    ranked = scale.stage(ranked, "ranked")
    return portfolio.truncate(ranked, order, above, keep)


def recommend(ranked: DataFrame, resources: DataFrame, order: list[Column], top: int | None = None, size: int = 3) -> DataFrame:
    """Kept articles in chunks with their best full text; the input rules are checked first."""
    good = portfolio.candidate_issues(ranked).filter(F.size("issues") == 0).drop("issues")
    best = portfolio.chunks(good, order, size, top)
    return portfolio.attach_best_resource(best, resources)


def audit_batches(checked: DataFrame, max_calls: int | None = None) -> DataFrame:
    """Per task: classes, eligible articles, planned calls and whether they fit the budget."""
    return audit.checks_summary(checked, max_calls)
