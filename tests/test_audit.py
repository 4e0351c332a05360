"""Checks of batches whose tables disagree."""

from litmill.operators import audit


def test_batches_whose_tables_disagree(spark):
    kind = "batch_id long, article_id long"
    batches = spark.createDataFrame(
        [(i, 1, "g", "cohort", "completed", True, True, 1, "g", "cohort") for i in range(1, 6)],
        "batch_id long, task_id long, group_id string, study_type string, status string, has_assessment boolean, has_scores boolean, "
        "assessment_task_id long, assessment_group_id string, assessment_study_type string")
    listed = [(1, 1), (2, 1), (2, 1), (3, 9), (4, None), (5, 1)]
    given = [(1, 1), (1, 1), (2, 1), (3, 9), (4, None)]
    scores = [(1, 1, 10.0), (2, 1, 10.0), (2, 1, None), (3, 9, 7.0), (4, None, 10.0), (5, 2, 10.0)]
    criteria = [(1, 1, 1.0), (1, 1, None), (2, 1, 1.0), (3, 9, 1.0), (4, None, 1.0), (5, 3, 1.0)]
    out = audit.check_batches(
        batches, spark.createDataFrame(listed, kind), spark.createDataFrame([(1,), (2,)], "article_id long"), spark.createDataFrame(given, kind),
        spark.createDataFrame(scores, f"{kind}, quality_score double"), spark.createDataFrame(criteria, f"{kind}, score double"))
    got = {r.batch_id: (r.article_count, r.issues) for r in out.collect()}
    assert got == {
        1: (1, []),
        2: (2, ["duplicate_article_ids", "invalid_score_payload", "duplicate_score_articles"]),
        3: (1, ["missing_articles", "quality_score_mismatch"]),
        4: (1, ["missing_articles", "assessment_articles_mismatch", "invalid_score_payload", "score_articles_mismatch"]),
        5: (1, ["assessment_articles_mismatch", "invalid_score_payload", "score_articles_mismatch"]),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
