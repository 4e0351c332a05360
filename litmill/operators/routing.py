"""Study design inference and routing to the supported assessment types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import text
from litmill.operators.rubrics import STUDY_TYPES

# Markers looked for in the source metadata, first match wins.
METADATA_MARKERS = (
    ("meta-analysis", "meta_analysis"),
    ("meta analysis", "meta_analysis"),
    ("qualitative systematic", "qualitative_systematic_review"),
    ("umbrella review", "umbrella_review"),
    ("systematic review", "systematic_review"),
    ("narrative review", "narrative_review"),
    ("case-control", "case_control"),
    ("case control", "case_control"),
    ("cohort", "cohort"),
    ("cross-sectional", "cross_sectional_analytical"),
    ("cross sectional", "cross_sectional_analytical"),
    ("randomized controlled trial", "randomized_controlled_trial"),
    ("randomised controlled trial", "randomized_controlled_trial"),
)
# Method phrases looked for in the abstract, first match wins.
REVIEW_PHRASE = r"\b(meta[- ]analysis|systematic review)\b"
META_PHRASE = r"\bmeta[- ]analysis\b"
ABSTRACT_PHRASES = (
    (r"\b(umbrella review|review of reviews)\b", "umbrella_review"),
    (r"\b(narrative review|literature review)\b", "narrative_review"),
    (r"\brandomi[sz]ed.{0,120}\btrial\b", "randomized_controlled_trial"),
    (
        r"\bparticipants?\s+were\s+randomi[sz]ed\b|\brandomly assigned\b",
        "randomized_controlled_trial",
    ),
    (r"\b(case[- ]control(?:led)? study|case[- ]control study)\b", "case_control"),
    (r"\b(prospective|retrospective|population[- ]based) cohort\b", "cohort"),
    (r"\b(cross[- ]sectional|prevalence survey)\b", "cross_sectional_analytical"),
)
# Aliases of registered types, tried when nothing was inferred.
ALIASES = (
    ("qualitative_systematic", "qualitative_systematic_review"),
    ("qualitative_evidence_synthesis", "qualitative_systematic_review"),
    ("umbrella_review", "umbrella_review"),
    ("review_of_reviews", "umbrella_review"),
    ("meta_analysis", "meta_analysis"),
    ("metaanalysis", "meta_analysis"),
    ("systematic_review", "systematic_review"),
    ("randomized", "randomized_controlled_trial"),
    ("randomised", "randomized_controlled_trial"),
    ("case_control", "case_control"),
    ("cohort", "cohort"),
)


def infer_design(
    types: Column, design: Column, abstract: Column, strict_meta: bool = False
) -> Column:
    """Study design from metadata, then from method phrases in the abstract, else null.

    Review phrases come before trial phrases.  By default any "meta" in a text
    that names a systematic review makes it a meta-analysis; ``strict_meta``
    asks for the word itself.
    """
    parts = F.transform(
        F.concat(F.array(design), F.coalesce(types, F.array().cast("array<string>"))),
        lambda x: F.coalesce(text.collapse(x), F.lit("")),
    )
    meta = F.lower(F.array_join(parts, " "))

    def by_metadata(m: Column) -> Column:
        return F.coalesce(*[F.when(m.contains(mark), F.lit(v)) for mark, v in METADATA_MARKERS])

    def by_abstract(body: Column) -> Column:
        is_meta = body.rlike(META_PHRASE) if strict_meta else body.contains("meta")
        review = F.when(
            body.rlike(REVIEW_PHRASE),
            F.when(is_meta, F.lit("meta_analysis")).otherwise(F.lit("systematic_review")),
        )
        return F.coalesce(review, *[F.when(body.rlike(p), F.lit(v)) for p, v in ABSTRACT_PHRASES])

    return F.coalesce(
        text.let(meta, by_metadata),
        text.let(F.lower(F.coalesce(abstract, F.lit(""))), by_abstract),
    )


def group_token(c: Column) -> Column:
    """Folded value with everything but letters, digits and CJK as underscores."""
    s = F.regexp_replace(text.fold(text.strip(c)), r"[^A-Za-z0-9\x{4e00}-\x{9fff}]+", "_")
    return text.null_if_empty(F.regexp_replace(s, "^_+|_+$", ""))


def study_group(
    types: Column, design: Column, abstract: Column, strict_meta: bool = False
) -> Column:
    """Assessment type of a record: inferred, registered as is, by alias, or ``unknown``."""
    listed = F.coalesce(types, F.array().cast("array<string>"))

    def route(own: Column) -> Column:
        tokens = F.array_join(
            F.transform(listed, lambda x: F.coalesce(group_token(x), F.lit(""))), "_"
        )
        joined = F.concat_ws("_", text.null_if_empty(own), text.null_if_empty(tokens))
        return F.coalesce(
            infer_design(listed, text.null_if_empty(own), abstract, strict_meta),
            F.when(own.isin(*STUDY_TYPES), own),
            text.let(joined, by_alias),
        )

    def by_alias(joined: Column) -> Column:
        cross = F.when(
            joined.contains("cross_sectional"),
            F.when(joined.contains("prevalence"), F.lit("cross_sectional_prevalence")).otherwise(
                F.lit("cross_sectional_analytical")
            ),
        )
        return F.coalesce(
            *[F.when(joined.contains(n), F.lit(v)) for n, v in ALIASES],
            cross,
            F.when(joined.contains("review"), F.lit("narrative_review")),
            F.lit("unknown"),
        )

    return text.let(F.coalesce(group_token(design), F.lit("")), route)


def split_supported(df: DataFrame, by: str = "study_group") -> tuple[DataFrame, DataFrame]:
    """Rows of a registered type, and the others marked as not evaluated."""
    known = F.coalesce(F.col(by).isin(*STUDY_TYPES), F.lit(False))
    other = df.filter(~known).select(
        "*",
        F.lit("not_evaluated").alias("status"),
        F.lit("unsupported_study_design").alias("reason"),
    )
    return df.filter(known), other
