"""Validate assessments against their rubric and recompute every score in code.

``criteria`` is one row per (article, criterion) with ``status``; ``relevance``
is one row per article.  Rule operators add an ``issues`` array; ``strict``
raises on the first issue instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Score of each criterion status (not applicable has none).
STATUS_SCORES = {"favorable": 1.0, "unclear": -0.5, "not_reported": -1.0}
STATUSES = ("favorable", "unclear", "not_reported", "not_applicable")
LEGAL_SCORES = (1.0, -0.5, -1.0)
NOT_REPORTED_QUOTE = "摘要未报告"
THRESHOLD = 3.0
SCORE_TOLERANCE = 1e-9
NEUTRAL_SIGNAL = 5.0


@dataclass(frozen=True)
class Weights:
    """Weights of the composite score; they must not be negative and add up to one."""

    relevance: float = 0.50
    quality: float = 0.25
    answerability: float = 0.15
    journal: float = 0.05
    recency: float = 0.05

    def __post_init__(self) -> None:
        parts = (self.relevance, self.quality, self.answerability, self.journal, self.recency)
        if min(parts) < 0 or abs(sum(parts) - 1.0) > 1e-9:
            raise ValueError("weights must not be negative and must add up to 1")


def codes(*rules: tuple[Column, str]) -> Column:
    """Array of the codes whose condition is true."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))


def demand(df: DataFrame, strict: bool, issues: str = "issues") -> DataFrame:
    """With ``strict``, raise on any row that has an issue."""
    if not strict:
        return df
    checked = F.when(F.size(issues) == 0, F.col(issues)).otherwise(
        F.raise_error(F.array_join(F.col(issues), ","))
    )
    return df.withColumn(issues, checked)


def status_score(status: Column) -> Column:
    pairs = [F.lit(x) for kv in STATUS_SCORES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), status)


def relevance_level(score: Column) -> Column:
    return (
        F.when(score >= 8.0, F.lit("high"))
        .when(score >= 4.0, F.lit("partial"))
        .when(score.isNotNull(), F.lit("low"))
    )


def relevance_issues(df: DataFrame, strict: bool = False) -> DataFrame:
    """Score ranges, stated level against score, reason length."""
    out = df.withColumn(
        "issues",
        codes(
            (~F.coalesce(F.col("score").between(0, 10), F.lit(False)), "score_range"),
            (
                ~F.coalesce(F.col("answerability_score").between(0, 10), F.lit(False)),
                "answerability_range",
            ),
            (~F.coalesce(F.col("level") == relevance_level(F.col("score")), F.lit(False)), "level_mismatch"),
        ),
    )
    return demand(out, strict)


def criterion_issues(df: DataFrame, strict: bool = False) -> DataFrame:
    """Per criterion: known status, stated score agrees with it, reason of 1..200 characters."""
    expected = status_score(F.col("status"))
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    length = F.coalesce(F.length("reason"), F.lit(0))
    out = df.withColumn(
        "issues",
        codes(
            (~known, "unknown_status"),
            (known & F.col("score").isNotNull() & ~F.col("score").eqNullSafe(expected), "score_mismatch"),
            ((length < 1) | (length > 200), "reason_length"),
        ),
    )
    return demand(out, strict)


def evidence_issues(df: DataFrame) -> DataFrame:
    """Which statuses may, must and must not cite spans (``cited`` counts the ids)."""
    none_allowed = F.col("status").isin("not_reported", "not_applicable")
    return df.withColumn(
        "issues",
        codes(
            (none_allowed & (F.col("cited") > 0), "spans_not_allowed"),
            (~none_allowed & (F.col("cited") == 0), "spans_required"),
        ),
    )


def coverage_evidence_issues(df: DataFrame) -> DataFrame:
    """Coverage rows: absent needs checked articles and no spans; the others need evidence."""
    absent = F.col("status") == "absent"
    return df.withColumn(
        "issues",
        codes(
            (absent & ((F.col("cited") > 0) | (F.col("checked") == 0)), "absent_needs_checked_only"),
            (~absent & ((F.col("cited") == 0) | (F.col("evidence") == 0)), "evidence_required"),
        ),
    )


def contribution_evidence_issues(df: DataFrame) -> DataFrame:
    """Contributions: none needs overlaps and no spans; the others need spans."""
    nothing = F.col("level") == "none"
    return df.withColumn(
        "issues",
        codes(
            (nothing & ((F.col("cited") > 0) | (F.col("overlap_count") == 0)), "none_needs_overlap_only"),
            (~nothing & (F.col("cited") == 0), "evidence_required"),
        ),
    )


def rubric_cover(criteria: DataFrame, rubric: DataFrame) -> DataFrame:
    """Articles whose criteria are not exactly their rubric, with what is wrong.

    ``criteria`` holds article_id, study_type and criterion_id.  One aggregation
    per article and no outer join of the corpus with the rubric: known criteria
    are counted and compared with the rubric's size.
    """
    sizes = rubric.groupBy("study_type").agg(F.count("*").alias("expected"))
    known = rubric.select("study_type", "criterion_id", F.lit(True).alias("_known"))
    rows = criteria.join(known, ["study_type", "criterion_id"], "left")
    per = rows.groupBy("article_id", "study_type").agg(
        F.count("*").alias("given"),
        F.count_distinct("criterion_id").alias("distinct_ids"),
        F.count_distinct(F.when(F.col("_known"), F.col("criterion_id"))).alias("known_ids"),
    )
    per = per.join(sizes, "study_type", "left")
    issues = codes(
        (F.col("expected").isNull(), "unknown_type"),
        (F.col("given") > F.col("distinct_ids"), "repeated"),
        (F.col("distinct_ids") > F.col("known_ids"), "not_in_rubric"),
        (F.col("known_ids") < F.col("expected"), "missing"),
    )
    return per.withColumn("issues", issues)


def preliminary_quality(criteria: DataFrame, keys: Sequence[str] = ("article_id",)) -> DataFrame:
    """5 + 5 * mean of the applicable criterion scores, with issue codes.

    No applicable criterion, or a score that is none of the legal three, gives
    an issue and no quality score.
    """
    score = status_score(F.col("status")) if "score" not in criteria.columns else F.col("score")
    illegal = score.isNotNull() & ~score.isin(*LEGAL_SCORES)
    got = criteria.groupBy(*keys).agg(
        F.avg(score).alias("_mean"),
        F.count(score).alias("applicable"),
        F.count_if(illegal).alias("_illegal"),
    )
    issues = codes(
        (F.col("applicable") == 0, "nothing_applicable"), (F.col("_illegal") > 0, "illegal_score")
    )
    out = got.withColumn("issues", issues)
    quality = F.when(F.size("issues") == 0, F.lit(5.0) + F.lit(5.0) * F.col("_mean"))
    return out.select(*keys, "applicable", quality.alias("quality_score"), "issues")


def composite(
    df: DataFrame,
    weights: Weights = Weights(),
    journal: Column | None = None,
    recency: Column | None = None,
) -> DataFrame:
    """Add journal_score, recency_score and composite_score.

    Journal and recency are neutral unless a signal column is given.  A part
    outside 0..10 leaves no composite.
    """
    out = df.withColumn(
        "journal_score", F.lit(NEUTRAL_SIGNAL) if journal is None else journal
    ).withColumn("recency_score", F.lit(NEUTRAL_SIGNAL) if recency is None else recency)
    parts = {
        "relevance_score": weights.relevance,
        "quality_score": weights.quality,
        "answerability_score": weights.answerability,
        "journal_score": weights.journal,
        "recency_score": weights.recency,
    }
    total, legal = F.lit(0.0), F.lit(True)
    for name, w in parts.items():
        total = total + F.col(name) * F.lit(w)
        legal = legal & F.col(name).between(0, 10)
    return out.withColumn("composite_score", F.when(legal, total))


def partition_by_threshold(
    df: DataFrame, threshold: float = THRESHOLD, col: str = "composite_score"
) -> tuple[DataFrame, DataFrame]:
    """Rows strictly above the threshold, and all others."""
    above = F.coalesce(F.col(col) > threshold, F.lit(False))
    return df.filter(above), df.filter(~above)


def pair_assessments(relevance: DataFrame, quality: DataFrame, batch: DataFrame) -> DataFrame:
    """One relevance and one quality row per batch article; anything else is an issue."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("article_id").agg(F.count("*").alias(name))

    rows = (
        counted(batch, "in_batch")
        .join(counted(relevance, "relevance_rows"), "article_id", "full_outer")
        .join(counted(quality, "quality_rows"), "article_id", "full_outer")
        .na.fill(0, ["in_batch", "relevance_rows", "quality_rows"])
    )
    return rows.withColumn(
        "issues",
        codes(
            (F.col("in_batch") == 0, "not_in_batch"),
            (F.col("in_batch") > 1, "repeated_in_batch"),
            (F.col("relevance_rows") == 0, "no_relevance"),
            (F.col("relevance_rows") > 1, "repeated_relevance"),
            (F.col("quality_rows") == 0, "no_quality"),
            (F.col("quality_rows") > 1, "repeated_quality"),
        ),
    )


def rollup_verdicts(verdicts: DataFrame, by: str = "batch_id") -> DataFrame:
    """Batch verdict: disagree, then insufficient evidence, then partially agree, else agree."""

    def seen(value: str) -> Column:
        return F.bool_or(F.col("verdict") == value)

    return verdicts.groupBy(by).agg(
        F.when(seen("disagree"), F.lit("disagree"))
        .when(seen("insufficient_evidence"), F.lit("insufficient_evidence"))
        .when(seen("partially_agree"), F.lit("partially_agree"))
        .otherwise(F.lit("agree"))
        .alias("batch_verdict")
    )


def rescore(verdicts: DataFrame, criteria: DataFrame) -> DataFrame:
    """Quality score with the judge's status where it disagrees; null if any is undeterminable."""
    keys = ["article_id", "criterion_id"]
    rows = verdicts.join(criteria.select(*keys, "status"), keys, "left")
    final = F.when(F.col("verdict") == "disagree", F.col("expected_status")).otherwise(F.col("status"))
    rows = rows.withColumn("_status", final)
    known = F.coalesce(F.col("_status").isin(*STATUSES), F.lit(False))
    got = rows.groupBy("article_id").agg(
        F.bool_and(known).alias("_known"), F.avg(status_score(F.col("_status"))).alias("_mean")
    )
    return got.select(
        "article_id",
        F.when(F.col("_known"), F.lit(5.0) + F.lit(5.0) * F.col("_mean")).alias("expected_quality"),
    )


def apart(a: Column, b: Column, tolerance: float = SCORE_TOLERANCE, relative: float = 1e-9) -> Column:
    """True if two scores differ by more than the tolerance and by more than the relative one."""
    return F.abs(a - b) > F.greatest(F.lit(tolerance), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def drift(stored: DataFrame, fresh: DataFrame, tolerance: float = SCORE_TOLERANCE) -> DataFrame:
    """Articles whose stored quality score differs from the recomputed one."""
    both = stored.select("article_id", F.col("quality_score").alias("stored_score")).join(
        fresh.select("article_id", F.col("quality_score").alias("fresh_score")), "article_id"
    )
    return both.filter(apart(F.col("stored_score"), F.col("fresh_score"), tolerance))


def flatten_assessments(packed: DataFrame, col: str = "payload") -> DataFrame:
    """JSON assessments to one row per (article, criterion)."""
    schema = (
        "struct<article_id:bigint,study_type:string,"
        "criteria:array<struct<criterion_id:string,status:string,score:double>>>"
    )
    parsed = packed.select(F.from_json(F.col(col), schema).alias("p"))
    rows = parsed.select("p.article_id", "p.study_type", F.explode("p.criteria").alias("c"))
    return rows.select("article_id", "study_type", "c.criterion_id", "c.status", "c.score")


def criterion_questions(criteria: DataFrame, mapping: DataFrame, questions: DataFrame) -> DataFrame:
    """Each criterion with the atomic questions and dimensions it stands for.

    The composite score is not copied down; only coverage and status travel.
    """
    dims = mapping.join(questions, "question_id")
    return criteria.join(dims, "criterion_id").drop("score")


def dimension_rollup(with_questions: DataFrame) -> DataFrame:
    """Status counts per dimension and study type, with subtotals."""
    return with_questions.rollup("dimension_id", "study_type").agg(
        F.count("*").alias("answers"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
    )


def fallback_summary(df: DataFrame) -> DataFrame:
    """Summary built from the assessment itself when no summariser answers."""
    parts = F.concat("strengths", "limitations", "evidence_gaps")
    joined = F.array_join(parts, "；")
    reasons = F.array_compact(
        F.array(
            *[
                F.when(
                    F.trim(F.coalesce(c, F.lit(""))) != "",
                    F.concat_ws(":", F.lit(d), F.trim(F.col(c))),
                )
                for d, c in (
                    ("relevance", "relevance_reason"),
                    ("answerability", "answerability_reason"),
                )
            ]
        )
    )
    return df.withColumn("summary_status", F.lit("fallback")).withColumn(
        "dimension_reasons", reasons
    ).withColumn(
        "summary_text", F.when(joined != "", joined).otherwise(F.lit("评分理由概括暂不可用。"))
    )


def table_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): all row rules of a table in one pass."""
    counts = df.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()]
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]
    )
    return counts.select(F.inline(pairs))


def unique_rule(df: DataFrame, name: str, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Number of key values that occur more than once (null keys are not keys)."""
    rows = df if where is None else df.filter(where)
    rows = rows.dropna(subset=list(keys))
    many = rows.groupBy(*keys).count().filter("count > 1")
    return many.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def reference_rule(df: DataFrame, name: str, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Number of rows whose non-null reference has no parent row."""
    parents = parent.select(F.col(parent_col).alias(col)).distinct()
    # Distinct references are checked first, so a hot parent costs one row.
    refs = df.dropna(subset=[col]).groupBy(col).agg(F.count("*").alias("n"))
    lost = refs.join(parents, col, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("rule"), "violations"
    )


