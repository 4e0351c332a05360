"""A batch ledger with JSON payloads made from orders; every defect is known by its key."""

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.operators import audit, payloads, rubrics
from litmill.operators.quality import NOT_REPORTED_QUOTE

_CRITERIA = list(rubrics.RUBRICS["case_control"])

# Kind of each order's batch and what is wrong with it; 31 and above are sound.
_LEDGER = """select o_orderkey as batch_id, o_custkey as task_id, o_orderkey % 7 = 6 as portfolio, cast(o_orderkey % 41 as int) as d from orders"""


def _uuid(c):
    return F.concat(F.lit("0000000a-0000-4000-8000-"), F.lpad(c.cast("string"), 12, "0"))


def ledger(spark, sf_dir):
    """(ledger, articles)."""
    lines = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        F.array_sort(F.collect_set(_uuid(F.col("l_partkey")))).alias("ids"))
    b = A.spark_sql(spark, _LEDGER, orders=A.table(spark, sf_dir, "orders")).join(lines, "batch_id")
    d, ids, other = F.col("d"), F.col("ids"), F.lit("0000000b-0000-4000-8000-000000000000")
    first = ids[0]
    is_first = lambda x: x == first
    arr = lambda *x: F.array(*x)
    none = F.array().cast("array<string>")
    case = lambda when, then, rest: F.when(d == when, then).otherwise(rest)
    span = lambda x, n=0: F.concat(x, F.lit(f":abstract:{n}"))

    # Article batches.
    about = case(3, none, case(5, F.concat(ids, arr(other)), ids))
    listed = case(3, none, case(4, F.concat(ids, arr(first)), case(5, about, case(21, F.concat(ids, arr(other)), ids))))
    about = case(3, ids, about)

    def relevance(x):
        hit = is_first(x)
        spans = F.when(hit & (d == 23), arr(span(x, 9))).when(hit & (d == 24), arr(span(x), span(x))).when(
            hit & (d == 25), arr(span(other))).otherwise(arr(span(x)))
        return F.struct(
            x.alias("article_id"), F.when(hit & (d == 10), 11.0).otherwise(8.5).alias("score"),
            F.when(hit & (d == 11), "low").otherwise("high").alias("level"), F.lit("fits").alias("reason"),
            F.lit(5).alias("answerability_score"), F.lit(" some ").alias("answerability_reason"), spans.alias("evidence_span_ids"))

    def criterion(k, name):
        bad = lambda n: (d == n) & (k == 0)
        last = lambda n: (d == n) & (k == len(_CRITERIA) - 1)
        quiet = F.lit(k == 1) & (d != 30)
        status = F.when(d == 30, "not_applicable").when(F.lit(k == 1), "not_reported").otherwise("favorable")
        return F.struct(
            F.when(bad(13), _CRITERIA[1]).when(last(12), "unknown").otherwise(name).alias("criterion_id"), status.alias("status"),
            F.when(bad(14), 0.5).when(d == 30, F.lit(None)).when(F.lit(k == 1), -1.0).otherwise(F.lit(None)).alias("score"),
            F.when(quiet & (d != 15), NOT_REPORTED_QUOTE).otherwise("as said").alias("evidence_quote"),
            F.when(bad(16), F.repeat(F.lit("r"), 201)).otherwise("reason").alias("reason"), F.lit("abstract").alias("evidence_source"))

    rating = lambda x: F.struct(
        x.alias("article_id"), F.when(d == 18, "cohort").otherwise("case_control").alias("study_type"),
        F.array(*[criterion(k, n) for k, n in enumerate(_CRITERIA)]).alias("criteria"), F.lit(0.5).alias("confidence"))
    rated = case(17, F.concat(about, arr(other)), about)
    assessment = F.to_json(F.struct(
        case(19, F.lit("none"), F.col("task_id").cast("string")).alias("task_id"), case(20, F.lit("gx"), F.lit("g1")).alias("group_id"),
        F.lit("case_control").alias("study_type"), about.alias("article_ids"), F.transform(about, relevance).alias("relevance_assessments"),
        F.transform(rated, rating).alias("quality_assessments"), F.lit("extra").alias("unknown_field")))
    # One criterion of five is not reported, the others are favorable: a mean of 0.6.
    score = lambda x: F.struct(
        x.alias("article_id"), F.when(is_first(x) & (d == 26), 7.5).when(is_first(x) & (d == 27), F.lit(None)).otherwise(8.0).alias("quality_score"))
    scored = case(28, F.concat(about, arr(first)), case(29, F.slice(about, 2, 100), about))
    frozen = lambda x: F.struct(
        x.alias("article_id"),
        F.struct(arr(F.struct(F.concat(x, F.lit(":title:0")).alias("span_id"))).alias("title"),
                 arr(F.struct(span(x).alias("span_id")), F.struct(span(x, 1).alias("span_id"))).alias("abstract")).alias("evidence_spans"))
    kept = F.when(d == 22, F.concat(F.slice(ids, 2, 100), arr(other))).otherwise(F.concat(about, arr(other)))
    batch_input = F.to_json(F.struct(F.struct(F.transform(kept, frozen).alias("articles")).alias("batch")))

    # Portfolio batches.
    offered = case(3, none, case(5, none, case(11, F.concat(ids, arr(other)), ids)))
    offer = F.to_json(F.struct(F.struct(F.transform(offered, frozen).alias("candidate_articles")).alias("input")))

    def covered(name, k):
        gone = F.lit(k == 1)
        return F.struct(
            F.lit(name).alias("concept"), F.when(gone, "absent").otherwise("direct").alias("status"),
            F.when(gone, none).otherwise(arr(first)).alias("evidence_article_ids"), F.lit("seen").alias("reason"),
            F.when(gone & (d != 8), ids).otherwise(none).alias("checked_article_ids"),
            F.when(gone, none).when(d == 7, arr(span(other))).otherwise(arr(span(first))).alias("evidence_span_ids"))

    by_first = F.create_map(first, F.when(d == 12, arr(span(first, 7))).otherwise(arr(span(first), span(first, 1))))
    contribution = lambda x: F.struct(
        x.alias("article_id"), F.lit("core_evidence").alias("role"),
        F.when(is_first(x) & (d == 9), "none").otherwise("high").alias("contribution_level"), F.lit("adds").alias("reason"),
        F.when(is_first(x) & (d == 9), none).otherwise(arr(span(x))).alias("evidence_span_ids"))
    evaluation = F.to_json(F.struct(
        ids.alias("candidate_article_ids"),
        F.struct(
            case(10, arr(F.lit("a"), F.lit("b"), F.lit("c")), arr(F.lit("a"), F.lit("b"))).alias("required_concepts"),
            F.array(covered("a", 0), covered("b", 1)).alias("keyword_coverage")).alias("query_coverage"),
        F.struct(F.lit("direct").alias("status"), arr(first).alias("evidence_article_ids"), F.lit("both").alias("reason"),
                 by_first.alias("evidence_by_article")).alias("joint_query_coverage"),
        F.transform(case(6, F.concat(ids, arr(first)), ids), contribution).alias("article_contributions"),
        F.lit("read them").alias("recommendation")))
    port = F.col("portfolio")
    missing = lambda *n: d.isin(*n)
    rows = b.select(
        "batch_id", "task_id", F.lit("g1").alias("group_id"),
        F.when(port, payloads.PORTFOLIO).otherwise(case(6, F.lit("mystery"), F.lit("case_control"))).alias("study_type"),
        case(0, F.lit("odd"), case(1, F.lit("failed"), case(2, F.lit("pending"), F.lit("completed")))).alias("status"),
        F.when(port, ids).otherwise(listed).alias("article_ids"), F.when(port, offer).otherwise(batch_input).alias("input_payload"),
        F.when(port, F.when(~missing(4, 5), evaluation)).otherwise(
            # A text cut in the middle is no JSON.
            F.when(~missing(7), case(9, F.substring(assessment, 1, 200), assessment))).alias("assessment_payload"),
        F.when(~port & ~missing(8), F.to_json(F.transform(scored, score))).alias("score_payload"))
    arts = A.table(spark, sf_dir, "part").select(_uuid(F.col("p_partkey")).alias("article_id"))
    return rows, arts


_CODES = {
    0: "unsupported_status", 3: "empty_article_ids,assessment_articles_mismatch,score_articles_mismatch", 4: "duplicate_article_ids",
    5: "missing_articles", 6: "unknown_study_type", 7: "missing_assessment_payload", 8: "missing_score_payload,score_articles_mismatch",
    **{k: "invalid_assessment_payload" for k in range(9, 19)}, 19: "task_id_mismatch", 20: "group_id_mismatch",
    21: "missing_articles,assessment_articles_mismatch,score_articles_mismatch", 22: "missing_frozen_spans",
    **{k: "invalid_evidence_span" for k in (23, 24, 25)}, 26: "quality_score_mismatch", 27: "invalid_score_payload,score_articles_mismatch",
    28: "duplicate_score_articles", 29: "score_articles_mismatch", 30: "invalid_score_payload,score_articles_mismatch",
}
_PORTFOLIO_CODES = {
    0: "unsupported_status", 3: "missing_portfolio_input", 4: "missing_portfolio_payload", 5: "missing_portfolio_input,missing_portfolio_payload",
    **{k: "invalid_portfolio_payload" for k in (6, 7, 8, 9, 10, 12)}, 11: "portfolio_articles_mismatch",
}


# What stays to be said of a batch whose payload rates more articles than the ten that are allowed.
_LARGE_CODES = {
    0: "unsupported_status", 3: "empty_article_ids", 4: "duplicate_article_ids", 5: "missing_articles", 8: "missing_score_payload",
    21: "missing_articles",
}


def _case(found):
    return "case d " + " ".join(f"when {k} then '{v}'" for k, v in found.items()) + " else '' end"


_DUCK_LEDGER = f"""l as ({_LEDGER}), n as (select l_orderkey as batch_id, count(distinct l_partkey) as n from lineitem group by 1),
 c as (select l.*, n.n, case when portfolio then 'portfolio' when d = 6 then 'mystery' else 'case_control' end as study_type,
  case when d in (1, 2) then '' when portfolio then {_case(_PORTFOLIO_CODES)}
   when n.n + case when d in (5, 17) then 1 else 0 end > 10 and d not in (6, 7) then concat_ws(',', nullif({_case(_LARGE_CODES)}, ''), 'invalid_assessment_payload') else {_case(_CODES)} end as issues from l join n on l.batch_id = n.batch_id),
 classed as (select batch_id, task_id, study_type, cast(case when portfolio then n when d = 3 then 0 when d in (4, 5, 21) then n + 1 else n end as int) as article_count, issues,
  case when d = 1 then 'failed' when d = 2 then 'pending' when issues <> '' then 'invalid' else 'eligible' end as class from c)"""


def checked(spark, sf_dir):
    rows, arts = ledger(spark, sf_dir)
    return payloads.check_ledger(rows, arts)


@query("p22_payload_eligibility", f"with {_DUCK_LEDGER} select * from classed")
def payload_eligibility(spark, sf_dir):
    return checked(spark, sf_dir).withColumn("issues", F.array_join("issues", ","))


@query(
    "a15_payload_summary",
    f"""with {_DUCK_LEDGER} select task_id, count(*) filter (where class = 'eligible') as eligible, count(*) filter (where class = 'failed') as failed, count(*) filter (where class = 'pending') as pending,
 count(*) filter (where class = 'invalid') as invalid, cast(coalesce(sum(article_count) filter (where class = 'eligible'), 0) as bigint) as eligible_articles, 3 * count(*) filter (where class = 'eligible') as planned_calls,
 true as within_budget, concat_ws(',', case when count(*) filter (where class = 'eligible' and study_type = 'case_control') > 0 then 'case_control:' || count(*) filter (where class = 'eligible' and study_type = 'case_control') end,
 case when count(*) filter (where class = 'eligible' and study_type = 'portfolio') > 0 then 'portfolio:' || count(*) filter (where class = 'eligible' and study_type = 'portfolio') end) as eligible_by_type from classed group by 1""",
)
def payload_summary(spark, sf_dir):
    return audit.checks_summary(checked(spark, sf_dir))
