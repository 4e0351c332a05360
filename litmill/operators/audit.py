"""Batch audits, run and progress metrics, set checks and ranking consistency."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill import scale
from litmill.operators import quality
from litmill.operators.quality import codes
from litmill.operators.rubrics import STUDY_TYPES

# Batch states and public stages.
BATCH_STATES = ("pending", "processing", "completed", "failed", "cancelled")
ELIGIBILITY = ("eligible", "failed", "pending", "invalid")
JUDGES = ("routing", "criterion", "ranking")


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left whose key has no partner in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def only_candidates(df: DataFrame, candidates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that refer to a candidate, and the rows that do not."""
    ids = candidates.select(key).distinct()
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")


def set_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: do both sides hold the same ids without repeats, and what differs."""
    left = a.groupBy(key).agg(F.count("*").alias("n_left"))
    right = b.groupBy(key).agg(F.count("*").alias("n_right"))
    both = left.join(right, key, "full_outer")
    return both.agg(
        F.count_if(F.col("n_right").isNull()).alias("only_left"),
        F.count_if(F.col("n_left").isNull()).alias("only_right"),
        F.count_if(F.col("n_left") > 1).alias("repeated_left"),
        F.count_if(F.col("n_right") > 1).alias("repeated_right"),
    ).withColumn(
        "equal",
        (F.col("only_left") == 0) & (F.col("only_right") == 0)
        & (F.col("repeated_left") == 0) & (F.col("repeated_right") == 0),
    )


def ledger_status(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """Expected batches in their order with ledger state and what it means."""
    rows = expected.join(ledger, "batch_id", "left")
    state = F.col("status")
    return rows.withColumn(
        "outcome",
        F.when(state.isNull(), F.lit("missing"))
        .when(state.isin("pending", "processing"), F.lit("unfinished"))
        .when(state == "completed", F.lit("completed"))
        .otherwise(F.lit("not_evaluated")),
    )


def check_batches(
    batches: DataFrame,
    batch_articles: DataFrame,
    articles: DataFrame,
    assessed: DataFrame,
    scores: DataFrame,
    criteria: DataFrame,
    span_issues: DataFrame | None = None,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Class and issue codes of every batch of every task, in a fixed number of aggregations.

    batches: batch_id, task_id, group_id, study_type, status, has_assessment, has_scores,
    assessment_task_id, assessment_group_id, assessment_study_type.
    batch_articles, assessed: batch_id, article_id.  scores: batch_id, article_id,
    quality_score.  criteria: batch_id, article_id, criterion score.  span_issues: batch_id, and
    optionally ``issue``; an article cited without spans of its own in the batch is a
    missing_frozen_spans, any other bad reference an invalid_evidence_span.
    """
    known = articles.select("article_id").distinct().withColumn("_known", F.lit(True))
    # All four tables meet in one aggregation, which a task can spill, not in joins that each hold a sorted table.
    parts = [
        batch_articles.select("batch_id", "article_id").join(known, ["article_id"], "left").withColumn("_kind", F.lit(0)),
        assessed.select("batch_id", "article_id").withColumn("_kind", F.lit(1)),
        scores.select("batch_id", "article_id", F.col("quality_score").alias("_v")).withColumn("_kind", F.lit(2)),
        criteria.select("batch_id", "article_id", F.col("score").alias("_v")).withColumn("_kind", F.lit(3)),
    ]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    # Rows without a key agree with no row of another table.
    alone = F.when(F.col("batch_id").isNull() | F.col("article_id").isNull(), F.col("_kind"))
    kind = lambda k: F.col("_kind") == k
    some_of = lambda k: F.nullif(F.count_if(kind(k)), F.lit(0))
    rows = every.groupBy("batch_id", "article_id", alone.alias("_alone")).agg(
        some_of(0).alias("_times"),
        F.bool_or("_known").alias("_known"),
        F.max(F.when(kind(1), F.lit(True))).alias("_assessed"),
        some_of(2).alias("_scored"),
        F.min(F.when(kind(2), F.col("_v"))).alias("_low"),
        F.max(F.when(kind(2), F.col("_v"))).alias("_high"),
        F.count_if(kind(2) & F.col("_v").isNull()).alias("_no_score"),
        F.avg(F.when(kind(3), F.col("_v"))).alias("_mean"),
        F.count(F.when(kind(3), F.col("_v"))).alias("_applicable"),
    ).filter("_times is not null or _assessed or _scored is not null")
    calc = F.lit(5.0) + F.lit(5.0) * F.col("_mean")
    off = quality.apart(F.col("_low"), calc, tolerance) | quality.apart(F.col("_high"), calc, tolerance)
    per = rows.groupBy("batch_id").agg(
        F.sum(F.coalesce("_times", F.lit(0))).alias("article_count"),
        F.count_if(F.col("_times") > 1).alias("_rep"),
        F.count_if(F.col("_times").isNotNull() & F.col("_known").isNull()).alias("_lost"),
        F.count_if(F.col("_times").isNotNull() & F.col("_assessed").isNull()).alias("_a1"),
        F.count_if(F.col("_times").isNull() & F.col("_assessed").isNotNull()).alias("_a2"),
        F.count_if(F.col("_times").isNotNull() & F.col("_scored").isNull()).alias("_s1"),
        F.count_if(F.col("_times").isNull() & F.col("_scored").isNotNull()).alias("_s2"),
        F.count_if(F.col("_scored") > 1).alias("_s3"),
        F.count_if(
            F.col("_scored").isNotNull()
            & ((F.col("_no_score") > 0) | (F.coalesce("_applicable", F.lit(0)) == 0))
        ).alias("_bad"),
        F.count_if(F.coalesce(off, F.lit(False))).alias("_off"),
    )
    per = batches.join(per, "batch_id", "left")
    if span_issues is not None:
        issue = F.col("issue") if "issue" in span_issues.columns else F.lit("invalid_evidence_span")
        unfrozen = issue.eqNullSafe("missing_frozen_spans")
        found = span_issues.groupBy("batch_id").agg(
            F.count_if(unfrozen).alias("_unfrozen"), F.count_if(~unfrozen).alias("_spans")
        )
        per = per.join(found, "batch_id", "left")
    else:
        per = per.withColumns({"_unfrozen": F.lit(0), "_spans": F.lit(0)})
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    has_a, has_s = F.col("has_assessment"), F.col("has_scores")
    known_type = F.coalesce(F.col("study_type").isin(*STUDY_TYPES), F.lit(False))
    compared = has_a & known_type
    found = codes(
        (~F.col("status").eqNullSafe("completed"), "unsupported_status"),
        (~some("article_count"), "empty_article_ids"),
        (some("_rep"), "duplicate_article_ids"),
        (some("_lost"), "missing_articles"),
        (~known_type, "unknown_study_type"),
        (~has_a, "missing_assessment_payload"),
        (~has_s, "missing_score_payload"),
        (compared & ~F.col("assessment_task_id").eqNullSafe(F.col("task_id")), "task_id_mismatch"),
        (compared & ~F.col("assessment_group_id").eqNullSafe(F.col("group_id")), "group_id_mismatch"),
        (
            compared & ~F.col("assessment_study_type").eqNullSafe(F.col("study_type")),
            "study_type_mismatch",
        ),
        (compared & (some("_a1") | some("_a2")), "assessment_articles_mismatch"),
        (some("_unfrozen"), "missing_frozen_spans"),
        (some("_spans"), "invalid_evidence_span"),
        (compared & some("_bad"), "invalid_score_payload"),
        (compared & some("_off"), "quality_score_mismatch"),
        (compared & some("_s3"), "duplicate_score_articles"),
        (compared & (some("_s1") | some("_s2")), "score_articles_mismatch"),
    )
    state = F.col("status")
    skip = state.isin("failed", "pending", "processing")
    issues = F.when(skip, F.array().cast("array<string>")).otherwise(found)
    return per.select(
        "batch_id",
        "task_id",
        "study_type",
        F.coalesce("article_count", F.lit(0)).alias("article_count"),
        issues.alias("issues"),
        F.when(state == "failed", F.lit("failed"))
        .when(state.isin("pending", "processing"), F.lit("pending"))
        .when(F.size(issues) > 0, F.lit("invalid"))
        .otherwise(F.lit("eligible"))
        .alias("class"),
    )


def checks_summary(checked: DataFrame, max_calls: int | None = None) -> DataFrame:
    """Per task: batches per class, eligible articles and batches by study type, planned judge calls, budget flag."""
    counts = [F.count_if(F.col("class") == c).alias(c) for c in ELIGIBILITY]
    out = checked.groupBy("task_id").agg(
        *counts,
        F.coalesce(
            F.sum(F.when(F.col("class") == "eligible", F.col("article_count"))), F.lit(0)
        ).alias("eligible_articles"),
        F.concat_ws(
            ",",
            *[
                F.when(n > 0, F.concat(F.lit(f"{t}:"), n.cast("string")))
                for t in sorted((*STUDY_TYPES, "portfolio"))
                for n in [F.count_if((F.col("class") == "eligible") & (F.col("study_type") == t))]
            ],
        ).alias("eligible_by_type"),
    )
    calls = F.col("eligible") * F.lit(len(JUDGES))
    within = F.lit(True) if max_calls is None else calls <= max_calls
    return out.withColumn("planned_calls", calls).withColumn("within_budget", within)


def progress(batches: DataFrame, by: str) -> DataFrame:
    """Per execution: planned batches and one count per state (article batches only)."""
    rows = batches.filter(F.col("kind") == "article") if "kind" in batches.columns else batches
    return rows.groupBy(by).agg(
        F.count("*").alias("planned"),
        *[F.count_if(F.col("status") == s).alias(s) for s in BATCH_STATES],
    )


def run_metrics(requested: DataFrame, records: DataFrame) -> DataFrame:
    """Per run: status and counts; a run without any record stays, with zeros."""
    got = records.groupBy("search_run_id").agg(
        F.count("*").alias("retrieved"), F.count_if(F.col("invalid")).alias("invalid_records")
    )
    rows = requested.join(got, "search_run_id", "left").na.fill(0, ["retrieved", "invalid_records"])
    status = (
        F.when(F.col("failed"), F.lit("failed"))
        .when(F.col("invalid_records") > 0, F.lit("partial_success"))
        .when(F.col("retrieved") == 0, F.lit("success_empty"))
        .otherwise(F.lit("success_with_results"))
    )
    return rows.withColumn("status", status)


def result_counts(records: DataFrame, by: str) -> DataFrame:
    """Per run: records with an abstract, open access, downloadable."""
    return records.groupBy(by).agg(
        F.count("*").alias("records"),
        F.count_if(F.col("abstract_available")).alias("with_abstract"),
        F.count_if(F.col("is_open_access")).alias("open_access"),
        F.count_if(F.col("can_download_full_text")).alias("downloadable"),
    )


def plan_metrics(keywords: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: keyword, matched, unmatched and match counts of a vocabulary lookup."""
    per = matches.groupBy("keyword_id").agg(F.count("*").alias("n"))
    rows = keywords.select("keyword_id").join(per, "keyword_id", "left")
    return rows.agg(
        F.count("*").alias("keywords"),
        F.count("n").alias("matched"),
        F.count_if(F.col("n").isNull()).alias("unmatched"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"),
    )


def stage_latency(events: DataFrame, stage: str, ms: str, tokens: Sequence[str] = ()) -> DataFrame:
    """Per stage: attempts, total, mean, greatest and median time, and the sums of token counts (missing ones as 0)."""
    return events.groupBy(stage).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens],
        F.count("*").alias("attempts"),
        F.sum(ms).alias("total_ms"),
        F.avg(ms).alias("mean_ms"),
        F.max(ms).alias("max_ms"),
        F.percentile_approx(ms, 0.5, 10_000).alias("median_ms"),
    )


def peak_in_flight(spans: DataFrame, start: str, end: str, **kw) -> DataFrame:
    """One row: the greatest number of requests open at one time.

    Starts add one and ends take one away, ends first at equal times; the
    running total is computed by ranges of time, not in one task.
    """
    opened = spans.select(F.col(start).alias("at"), F.lit(1).alias("step"))
    closed = spans.select(F.col(end).alias("at"), F.lit(-1).alias("step"))
    steps = opened.unionByName(closed).groupBy("at", "step").agg(F.sum("step").alias("delta"))
    rows = scale.running_sum(steps, [], [F.asc("at"), F.asc("step")], value=F.col("delta"), name="open")
    return rows.agg(F.max("open").alias("peak"))


def apply_patches(
    updates: DataFrame, key: str, seq: str, fields: Sequence[str], error: str, status: str
) -> DataFrame:
    """Snapshot per key: last non-null value of each field; a later "running" clears the error."""

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))

    running = F.max(F.when(F.col(status) == "running", F.col(seq)))
    failed = F.max(F.when(F.col(error).isNotNull(), F.col(seq)))
    rows = updates.groupBy(key).agg(
        *[last(c).alias(c) for c in fields],
        last(error).alias(error),
        running.alias("_run"),
        failed.alias("_err"),
    )
    cleared = F.coalesce(F.col("_run") > F.col("_err"), F.lit(False))
    return rows.withColumn(error, F.when(~cleared, F.col(error))).drop("_run", "_err")


def inversions(rows: DataFrame, by: str = "batch_id") -> DataFrame:
    """Per batch: is the judge's order consistent with the scores, and how many pairs flip.

    A pair flips when one article has the better (greater) score and the worse
    (greater) tier; ties and missing values never do.  No pairs are formed.
    Equal (tier, score) articles are counted together; then, for every bit of
    the tier number, a cell asks how many articles of the sibling range of
    greater tiers have a greater score, which one running sum per range answers.
    """
    cells = (
        rows.filter(F.col("tier").isNotNull() & F.col("score").isNotNull())
        .groupBy(by, "tier", "score")
        .agg(F.count("*").alias("n"))
    )
    cells = scale.stage(cells, "cells")
    top = cells.agg(F.max("tier")).first()[0] or 0
    bits = max(int(top).bit_length(), 1)
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    at = cells.select(by, "tier", "score", "n", level)
    node = F.expr("shiftright(cast(tier as bigint), level)")
    give = at.select(by, "level", node.alias("node"), "score", F.col("n").alias("given"), F.lit(0).alias("asked"))
    ask = at.filter(F.expr("shiftright(cast(tier as bigint), level) % 2 = 0")).select(
        by, "level", (node + 1).alias("node"), "score", F.lit(0).cast("long").alias("given"),
        F.col("n").alias("asked"),
    )
    both = give.unionByName(ask)
    # Questions come before answers of the same score, so only greater scores count.
    seen = scale.running_sum(
        both, [by, "level", "node"], [F.desc("score"), F.desc(F.col("asked") > 0)],
        value=F.col("given"), name="above",
    )
    flips = seen.groupBy(by).agg(F.sum(F.col("asked") * F.col("above")).alias("conflicts"))
    batches = rows.select(by).distinct()
    return batches.join(flips, by, "left").select(
        by,
        F.coalesce("conflicts", F.lit(0)).alias("conflicts"),
        (F.coalesce("conflicts", F.lit(0)) == 0).alias("is_consistent"),
    )


def task_snapshot(tasks: DataFrame, batches: DataFrame, batch_articles: DataFrame) -> DataFrame:
    """Batches of the given tasks with their article counts; order by created_at, batch_id."""
    counts = batch_articles.groupBy("batch_id").agg(
        F.count("*").alias("articles"), F.count_distinct("article_id").alias("distinct_articles")
    )
    own = batches.join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    return own.join(counts, "batch_id", "left").na.fill(0, ["articles", "distinct_articles"])
