"""Rubric and question dimension tables (ids only): small and fixed, parts of the plan; joins leave the choice to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Study type -> criterion -> atomic questions it stands for.
RUBRICS: dict[str, dict[str, tuple[str, ...]]] = {
    "randomized_controlled_trial": {
        "rct_pico_clarity": ("Q-COM-002", "Q-EXP-001", "Q-EXP-002", "Q-CMP-001", "Q-OUT-001"),
        "rct_multicenter_setting": ("Q-COM-003",),
        "rct_intervention_timing": ("Q-EXP-001", "Q-EXP-002", "Q-EXP-005", "Q-OUT-003", "Q-TIM-002"),
        "rct_statistical_reporting": ("Q-STA-001", "Q-STA-002", "Q-STA-003", "Q-STA-004"),
        "rct_recruitment_period": ("Q-SMP-004", "Q-TIM-003"),
    },
    "cohort": {
        "cohort_pico_and_population": ("Q-COM-002", "Q-COM-003", "Q-COM-004", "Q-OUT-001"),
        "cohort_exposure_assignment": ("Q-EXP-001", "Q-EXP-002", "Q-EXP-003", "Q-EXP-004"),
        "cohort_comparator_confounding": ("Q-CMP-001", "Q-CMP-002", "Q-CMP-003", "Q-CMP-004"),
        "cohort_outcome_and_time": ("Q-OUT-001", "Q-OUT-002", "Q-OUT-003", "Q-TIM-001", "Q-TIM-002"),
        "cohort_statistical_reporting": ("Q-STA-001", "Q-STA-002", "Q-STA-003", "Q-STA-004", "Q-STA-005"),
    },
    "case_control": {
        "case_definition": ("Q-OUT-001", "Q-STA-002"),
        "control_source": ("Q-CMP-001",),
        "case_control_comparability": ("Q-CMP-002", "Q-CMP-003", "Q-CMP-004"),
        "case_control_exposure": ("Q-EXP-001", "Q-EXP-002", "Q-EXP-003", "Q-EXP-004", "Q-TIM-001"),
        "case_control_statistics": ("Q-STA-001", "Q-STA-002", "Q-STA-003", "Q-STA-004", "Q-STA-005"),
    },
    "cross_sectional_analytical": {
        "cross_sectional_population_sampling": ("Q-COM-002", "Q-COM-003", "Q-SMP-001", "Q-SMP-002"),
        "cross_sectional_exposure_measurement": ("Q-EXP-001", "Q-EXP-002", "Q-EXP-003", "Q-EXP-004"),
        "cross_sectional_outcome_measurement": ("Q-OUT-001", "Q-OUT-002", "Q-OUT-003"),
        "cross_sectional_confounding_control": ("Q-CMP-002", "Q-CMP-003", "Q-CMP-004"),
        "cross_sectional_statistical_reporting": ("Q-STA-001", "Q-STA-002", "Q-STA-003", "Q-STA-004", "Q-STA-005"),
    },
    "cross_sectional_prevalence": {
        "prevalence_sampling_frame": ("Q-COM-002", "Q-POP-002", "Q-SMP-001"),
        "prevalence_recruitment_coverage": ("Q-SMP-002", "Q-SMP-003", "Q-SMP-005"),
        "prevalence_sample_size_precision": ("Q-SMP-004", "Q-PRE-002"),
        "prevalence_condition_measurement": ("Q-OUT-001", "Q-OUT-002"),
        "prevalence_statistics": ("Q-PRE-001", "Q-PRE-002", "Q-STA-002"),
    },
    "systematic_review": {
        "systematic_question_inclusion": ("Q-COM-001", "Q-COM-015"),
        "systematic_search_coverage": ("Q-COM-008", "Q-COM-009", "Q-COM-010"),
        "systematic_appraisal_extraction": ("Q-COM-011", "Q-COM-012", "Q-COM-016"),
        "systematic_synthesis_method": ("Q-COM-013", "Q-COM-014"),
        "systematic_conclusion_support": ("Q-COM-006", "Q-COM-007"),
    },
    "meta_analysis": {
        "meta_question_inclusion": ("Q-COM-001", "Q-COM-015"),
        "meta_search_coverage": ("Q-COM-008", "Q-COM-009", "Q-COM-010"),
        "meta_appraisal_extraction": ("Q-COM-011", "Q-COM-012", "Q-COM-016"),
        "meta_synthesis_method": ("Q-COM-013",),
        "meta_conclusion_support": ("Q-COM-006", "Q-COM-007"),
        "meta_effect_measure_model": ("Q-MTA-001", "Q-MTA-005"),
        "meta_heterogeneity": ("Q-MTA-002",),
        "meta_sensitivity_subgroup": ("Q-MTA-003", "Q-MTA-006"),
        "meta_publication_bias": ("Q-MTA-004", "Q-MTA-007"),
    },
    "qualitative_systematic_review": {
        "qualitative_systematic_question_inclusion": ("Q-COM-001", "Q-COM-015"),
        "qualitative_systematic_search_coverage": ("Q-COM-008", "Q-COM-009", "Q-COM-010"),
        "qualitative_systematic_appraisal_extraction": ("Q-COM-011", "Q-COM-012", "Q-COM-016"),
        "qualitative_systematic_thematic_synthesis": ("Q-QUA-001",),
        "qualitative_systematic_conclusion_support": ("Q-QUA-002", "Q-QUA-003"),
    },
    "umbrella_review": {
        "umbrella_question_inclusion": ("Q-COM-001", "Q-COM-015"),
        "umbrella_search_coverage": ("Q-COM-008", "Q-COM-009", "Q-COM-010"),
        "umbrella_review_appraisal": ("Q-UMB-001",),
        "umbrella_synthesis_method": ("Q-COM-013", "Q-COM-014"),
        "umbrella_conclusion_support": ("Q-COM-006", "Q-COM-007"),
        "umbrella_overlap_management": ("Q-UMB-002",),
        "umbrella_conflicting_evidence": ("Q-UMB-003",),
    },
    "narrative_review": {
        "narrative_topic_scope": ("Q-NAR-001",),
        "narrative_evidence_selection": ("Q-NAR-002",),
        "narrative_balanced_discussion": ("Q-NAR-003",),
        "narrative_conclusion_support": ("Q-COM-006", "Q-COM-007", "Q-NAR-004"),
    },
}
STUDY_TYPES = tuple(RUBRICS)

# Evaluation dimension -> its atomic questions, in catalogue order.
DIMENSIONS: dict[str, tuple[str, ...]] = {
    "D01": ("Q-COM-001", "Q-COM-015", "Q-NAR-001"),
    "D02": ("Q-DSN-001", "Q-DSN-002", "Q-DSN-003"),
    "D03": ("Q-SMP-001", "Q-SMP-002", "Q-SMP-003", "Q-SMP-005", "Q-SMP-004"),
    "D04": ("Q-COM-002", "Q-COM-003", "Q-COM-004", "Q-POP-001", "Q-POP-002"),
    "D05": ("Q-EXP-001", "Q-EXP-002", "Q-EXP-003", "Q-EXP-004", "Q-EXP-005"),
    "D06": ("Q-CMP-001", "Q-CMP-002", "Q-CMP-003", "Q-CMP-004"),
    "D07": ("Q-COM-005", "Q-OUT-001", "Q-OUT-002", "Q-OUT-003"),
    "D08": ("Q-TIM-001", "Q-TIM-002", "Q-TIM-003"),
    "D09": (
        "Q-STA-001", "Q-STA-002", "Q-STA-003", "Q-STA-004", "Q-STA-005", "Q-PRE-001", "Q-PRE-002",
        "Q-MTA-001", "Q-MTA-005", "Q-MTA-002", "Q-MTA-003", "Q-MTA-006", "Q-MTA-004", "Q-MTA-007",
    ),
    "D10": (
        "Q-COM-008", "Q-COM-009", "Q-COM-010", "Q-COM-011", "Q-COM-012", "Q-COM-016", "Q-COM-013",
        "Q-COM-014", "Q-NAR-002", "Q-QUA-001", "Q-UMB-001", "Q-UMB-002",
    ),
    "D11": (
        "Q-COM-006", "Q-COM-007", "Q-NAR-003", "Q-NAR-004", "Q-QUA-002", "Q-QUA-003", "Q-UMB-003",
    ),
}


def rubric_rows() -> list[tuple[str, int, str]]:
    return [
        (t, i, c) for t, criteria in RUBRICS.items() for i, c in enumerate(criteria, 1)
    ]


def question_rows() -> list[tuple[str, str]]:
    return [(q, d) for d, questions in DIMENSIONS.items() for q in questions]


def mapping_rows() -> list[tuple[str, str]]:
    return [(c, q) for criteria in RUBRICS.values() for c, qs in criteria.items() for q in qs]


def _inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small fixed table as part of the plan, so that Catalyst knows its size."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {values} as t({columns})")


def rubric_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rubric, questions, mapping) as small frames."""
    return (
        _inline(spark, rubric_rows(), "study_type, position, criterion_id"),
        _inline(spark, question_rows(), "question_id, dimension_id"),
        _inline(spark, mapping_rows(), "criterion_id, question_id"),
    )
