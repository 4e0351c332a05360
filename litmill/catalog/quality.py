"""Assessment scoring, audits and verdicts."""

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.catalog.rules import CRIT, DUCK_QUALITY, Q_SCORE, comp, crit
from litmill.operators import audit, portfolio, quality, rubrics

_TYPES = "case article_id % 4 when 0 then 'cohort' when 1 then 'randomized_controlled_trial' when 2 then 'narrative_review' else 'unregistered' end"
_RUBRIC = "rubric(study_type, position, criterion_id) as (values " + ", ".join(str(r) for r in rubrics.rubric_rows()) + ")"
_MAPPING = "mapping(criterion_id, question_id) as (values " + ", ".join(str(r) for r in rubrics.mapping_rows()) + ")"
_QUESTIONS = "questions(question_id, dimension_id) as (values " + ", ".join(str(r) for r in rubrics.question_rows()) + ")"
# Criterion rows named after the rubric of the article's type (the cohort and trial
# rubrics have five criteria), with faults put in by id.
DUCK_NAMED = f"""{_RUBRIC}, crit as ({CRIT}), named as (select c.article_id, {_TYPES} as study_type, c.status, {Q_SCORE} as score,
 case when c.article_id % 7 = 0 and criterion_no = 2 then 'stray' else coalesce(r.criterion_id, 'free_' || cast(criterion_no as varchar)) end as criterion_id
 from crit c left join rubric r on r.study_type = {_TYPES} and r.position = case when c.article_id % 11 = 0 and criterion_no = 3 then 1 else criterion_no end)"""


def named(spark, sf_dir):
    rub, _, _ = rubrics.rubric_tables(spark)
    c = crit(spark, sf_dir).withColumn("study_type", F.expr(_TYPES))
    c = c.withColumn("position", F.expr("cast(case when article_id % 11 = 0 and criterion_no = 3 then 1 else criterion_no end as int)"))
    c = c.join(rub, ["study_type", "position"], "left")
    name = F.expr("case when article_id % 7 = 0 and criterion_no = 2 then 'stray' else coalesce(criterion_id, 'free_' || cast(criterion_no as string)) end")
    return c.select("article_id", "study_type", "status", quality.status_score(F.col("status")).alias("score"), name.alias("criterion_id"))


@query(
    "s12_scan_rubrics",
    f"""with {_RUBRIC}, {_MAPPING}, {_QUESTIONS}, t as (select study_type, count(*) as articles from (select {_TYPES.replace('article_id', 'doc_id')} as study_type from documents) group by 1)
 select r.study_type, r.position, r.criterion_id, count(distinct m.question_id) as questions, count(distinct q.dimension_id) as dimensions, max(coalesce(t.articles, 0)) as articles
 from rubric r join mapping m on r.criterion_id = m.criterion_id join questions q on m.question_id = q.question_id left join t on r.study_type = t.study_type group by 1, 2, 3""",
)
def scan_rubrics(spark, sf_dir):
    rub, questions, mapping = rubrics.rubric_tables(spark)
    d = A.table(spark, sf_dir, "documents").select(F.expr(_TYPES.replace("article_id", "doc_id")).alias("study_type"))
    counts = d.groupBy("study_type").agg(F.count("*").alias("articles"))
    full = rub.join(mapping, "criterion_id").join(questions, "question_id")
    got = full.groupBy("study_type", "position", "criterion_id").agg(
        F.count_distinct("question_id").alias("questions"), F.count_distinct("dimension_id").alias("dimensions"))
    return got.join(counts, "study_type", "left").na.fill(0, ["articles"])


@query(
    "j11_rubric_cover",
    f"""with {DUCK_NAMED}, sizes as (select study_type, count(*) as expected from rubric group by 1),
 per as (select n.article_id, n.study_type, count(*) as given, count(distinct n.criterion_id) as distinct_ids, count(distinct r.criterion_id) as known_ids
  from named n left join rubric r on n.study_type = r.study_type and n.criterion_id = r.criterion_id group by 1, 2)
 select p.article_id, p.study_type, given, distinct_ids, known_ids, expected, concat_ws(',', case when expected is null then 'unknown_type' end, case when given > distinct_ids then 'repeated' end,
 case when distinct_ids > known_ids then 'not_in_rubric' end, case when known_ids < expected then 'missing' end) as issues from per p left join sizes s on p.study_type = s.study_type""",
)
def rubric_cover(spark, sf_dir):
    rub, _, _ = rubrics.rubric_tables(spark)
    return quality.rubric_cover(named(spark, sf_dir), rub).withColumn("issues", F.array_join("issues", ","))


@query("a02_preliminary_quality", f"with {DUCK_QUALITY} select article_id, applicable, round(quality_score, 6) as quality_score from qual")
def preliminary_quality(spark, sf_dir):
    return quality.preliminary_quality(crit(spark, sf_dir)).select(
        "article_id", "applicable", F.round("quality_score", 6).alias("quality_score"))


@query("a03_composite_score", f"with {DUCK_QUALITY} select article_id, round(composite_score, 6) as composite_score from comp")
def composite_score(spark, sf_dir):
    return comp(spark, sf_dir).select("article_id", F.round("composite_score", 6).alias("composite_score"))


@query(
    "j09_relevance_x_quality",
    """with b as (select doc_id as article_id from documents where doc_id % 10 <> 9 union all select doc_id from documents where doc_id % 50 = 0),
 r as (select doc_id as article_id from documents where doc_id % 7 <> 0), q as (select doc_id as article_id from documents union all select doc_id from documents where doc_id % 13 = 0),
 c as (select coalesce(b.article_id, r.article_id, q.article_id) as article_id, coalesce(b.n, 0) as in_batch, coalesce(r.n, 0) as relevance_rows, coalesce(q.n, 0) as quality_rows
  from (select article_id, count(*) n from b group by 1) b full join (select article_id, count(*) n from r group by 1) r on b.article_id = r.article_id
  full join (select article_id, count(*) n from q group by 1) q on coalesce(b.article_id, r.article_id) = q.article_id)
 select article_id, in_batch, relevance_rows, quality_rows, concat_ws(',', case when in_batch = 0 then 'not_in_batch' end, case when in_batch > 1 then 'repeated_in_batch' end,
 case when relevance_rows = 0 then 'no_relevance' end, case when quality_rows = 0 then 'no_quality' end, case when quality_rows > 1 then 'repeated_quality' end) as issues from c""",
)
def relevance_x_quality(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"))
    b = d.filter("article_id % 10 <> 9").unionByName(d.filter("article_id % 50 = 0"))
    q = d.unionByName(d.filter("article_id % 13 = 0"))
    return quality.pair_assessments(d.filter("article_id % 7 <> 0"), q, b).withColumn("issues", F.array_join("issues", ","))


_VERDICTS = """select article_id, criterion_no as criterion_id, case (article_id + criterion_no) % 6 when 0 then 'disagree' when 1 then 'partially_agree' when 2 then 'insufficient_evidence' else 'agree' end as verdict,
 case (article_id * 3 + criterion_no) % 5 when 0 then 'favorable' when 1 then 'unclear' when 2 then null when 3 then 'not_applicable' else 'not_reported' end as expected_status, article_id % 100 as batch_id from crit"""


def verdicts(spark, sf_dir):
    return A.spark_sql(spark, _VERDICTS, crit=crit(spark, sf_dir))


@query(
    "a17_verdict_rollup",
    f"""with crit as ({CRIT}), v as ({_VERDICTS.replace(' from crit', ' from crit where article_id % 3 > 0 or criterion_no = 1')}), b as (select batch_id * 5 + criterion_id as batch_id, verdict from v)
 select batch_id, case max(case verdict when 'disagree' then 3 when 'insufficient_evidence' then 2 when 'partially_agree' then 1 else 0 end)
 when 3 then 'disagree' when 2 then 'insufficient_evidence' when 1 then 'partially_agree' else 'agree' end as batch_verdict from b group by 1""",
)
def verdict_rollup(spark, sf_dir):
    v = verdicts(spark, sf_dir).filter("article_id % 3 > 0 or criterion_id = 1")
    return quality.rollup_verdicts(v.select((F.col("batch_id") * 5 + F.col("criterion_id")).alias("batch_id"), "verdict"))


@query(
    "a18_judge_rescore",
    f"""with crit as ({CRIT}), v as ({_VERDICTS}), j as (select v.article_id, case when verdict = 'disagree' then expected_status else status end as status
  from v join crit c on v.article_id = c.article_id and v.criterion_id = c.criterion_no)
 select article_id, round(case when bool_and(status is not null) then 5 + 5 * avg({Q_SCORE}) end, 6) as expected_quality from j group by 1""",
)
def judge_rescore(spark, sf_dir):
    c = crit(spark, sf_dir).withColumnRenamed("criterion_no", "criterion_id")
    return quality.rescore(verdicts(spark, sf_dir), c).select(
        "article_id", F.round("expected_quality", 6).alias("expected_quality"))


@query(
    "a19_score_drift",
    f"""with {DUCK_QUALITY} select article_id, round(quality_score + 0.5, 6) as stored_score, round(quality_score, 6) as fresh_score from qual where article_id % 9 = 4""",
)
def score_drift(spark, sf_dir):
    fresh = quality.preliminary_quality(crit(spark, sf_dir))
    nudge = F.when(F.col("article_id") % 9 == 4, 0.5).when(F.col("article_id") % 9 == 5, 1e-12).otherwise(0.0)
    stored = fresh.withColumn("quality_score", F.col("quality_score") + nudge)
    return quality.drift(stored, fresh).select(
        "article_id", F.round("stored_score", 6).alias("stored_score"), F.round("fresh_score", 6).alias("fresh_score"))


@query(
    "f11_assessment_flatten",
    f"with {DUCK_NAMED} select article_id, study_type, criterion_id, status, cast(score as double) as score from named",
)
def assessment_flatten(spark, sf_dir):
    # Five criteria per article, so the packed list is bounded by the rubric.
    n = named(spark, sf_dir).groupBy("article_id", "study_type").agg(
        F.collect_list(F.struct("criterion_id", "status", "score")).alias("criteria"))
    return quality.flatten_assessments(n.select(F.to_json(F.struct("*")).alias("payload")))


@query(
    "j20_criterion_to_question",
    f"""with {DUCK_NAMED}, {_MAPPING}, {_QUESTIONS} select n.article_id, n.criterion_id, m.question_id, q.dimension_id, n.status
 from named n join mapping m on n.criterion_id = m.criterion_id join questions q on m.question_id = q.question_id""",
)
def criterion_to_question(spark, sf_dir):
    _, questions, mapping = rubrics.rubric_tables(spark)
    return quality.criterion_questions(named(spark, sf_dir), mapping, questions).select(
        "article_id", "criterion_id", "question_id", "dimension_id", "status")


@query(
    "a28_dimension_rollup",
    f"""with {DUCK_NAMED}, {_MAPPING}, {_QUESTIONS} select q.dimension_id, n.study_type, count(*) as answers, count(*) filter (where status = 'favorable') as favorable,
 count(*) filter (where status = 'unclear') as unclear, count(*) filter (where status = 'not_reported') as not_reported, count(*) filter (where status = 'not_applicable') as not_applicable
 from named n join mapping m on n.criterion_id = m.criterion_id join questions q on m.question_id = q.question_id group by rollup (q.dimension_id, n.study_type)""",
)
def dimension_rollup(spark, sf_dir):
    _, questions, mapping = rubrics.rubric_tables(spark)
    return quality.dimension_rollup(quality.criterion_questions(named(spark, sf_dir), mapping, questions))


@query(
    "f13_rubric_fingerprint",
    f"""with {_RUBRIC}, doc as (select study_type, string_agg(criterion_id, ',' order by position) as body from rubric group by 1),
 t as (select {_TYPES.replace('article_id', 'doc_id')} as study_type, count(*) as articles from documents group by 1)
 select t.study_type, t.articles, sha256('{{"study_type":"' || d.study_type || '","criteria":"' || d.body || '"}}') as fingerprint from t left join doc d on t.study_type = d.study_type""",
)
def rubric_fingerprint(spark, sf_dir):
    rub, _, _ = rubrics.rubric_tables(spark)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "criterion_id"))), lambda x: x["criterion_id"])
    doc = rub.groupBy("study_type").agg(F.array_join(lines, ",").alias("criteria"))
    doc = doc.select("study_type", F.sha2(F.to_json(F.struct("study_type", "criteria")), 256).alias("fingerprint"))
    d = A.table(spark, sf_dir, "documents").select(F.expr(_TYPES.replace("article_id", "doc_id")).alias("study_type"))
    counts = d.groupBy("study_type").agg(F.count("*").alias("articles"))
    return counts.join(doc, "study_type", "left")


# Batches from orders: status, payload presence and faults by key.
_BATCHES = """select o_orderkey as batch_id, o_custkey as task_id, 'g' || cast(o_custkey % 10 as string) as group_id,
 case o_orderkey % 17 when 0 then 'mystery' when 1 then 'cohort' else 'case_control' end as study_type,
 case o_orderstatus when 'O' then 'completed' when 'F' then case when o_orderkey % 2 = 0 then 'failed' else 'completed' end else case when o_orderkey % 3 = 0 then 'pending' when o_orderkey % 3 = 1 then 'odd' else 'completed' end end as status,
 o_orderkey % 13 <> 0 as has_assessment, o_orderkey % 19 <> 0 as has_scores, case when o_orderkey % 23 = 0 then -1 else o_custkey end as assessment_task_id,
 case when o_orderkey % 29 = 0 then 'gx' else 'g' || cast(o_custkey % 10 as string) end as assessment_group_id,
 case when o_orderkey % 31 = 0 then 'umbrella_review' else case o_orderkey % 17 when 0 then 'mystery' when 1 then 'cohort' else 'case_control' end end as assessment_study_type from orders"""
_LINES = "select l_orderkey as batch_id, l_partkey as article_id, cast(l_quantity as bigint) as qty from lineitem"
# A calculated score of 5 + 5 * 1 = 10 unless the quantity says otherwise.
_SCORES = "select batch_id, article_id, case when qty % 11 = 0 then null when qty % 7 = 0 then 9.5 else 10.0 end as quality_score from lines where qty <> 3"
_ARTS = "select p_partkey as article_id from part where p_partkey % 37 <> 5"
_DUCK_CHECK = f"""b as ({_BATCHES}), lines as ({_LINES}), arts as ({_ARTS}), scores as ({_SCORES}),
 assessed as (select distinct batch_id, article_id from lines where qty <> 5),
 listed as (select batch_id, article_id, count(*) as times from lines group by 1, 2),
 stored as (select batch_id, article_id, count(*) as scored, min(quality_score) as low, max(quality_score) as high, count(*) filter (where quality_score is null) as nos from scores group by 1, 2),
 rws as (select l.batch_id, l.times, a.article_id is not null as known, s.scored, s.low, s.high, s.nos, g.article_id is not null as given from listed l left join arts a on l.article_id = a.article_id
  left join assessed g on l.batch_id = g.batch_id and l.article_id = g.article_id left join stored s on l.batch_id = s.batch_id and l.article_id = s.article_id),
 per as (select batch_id, sum(times) as n, bool_or(times > 1) as rep, bool_or(not known) as lost, bool_or(not given) as a1, bool_or(scored is null) as s1, bool_or(scored > 1) as s3,
  bool_or(scored is not null and nos > 0) as bad, bool_or(abs(low - 10) > 1e-9 or abs(high - 10) > 1e-9) as off from rws group by 1),
 flags as (select b.*, p.n, coalesce(rep, false) as rep, coalesce(lost, false) as lost, coalesce(a1, false) as a1, coalesce(s1, false) as s1, coalesce(s3, false) as s3, coalesce(bad, false) as bad, coalesce(off, false) as off,
  study_type <> 'mystery' as kt from b left join per p on b.batch_id = p.batch_id),
 checked as (select batch_id, task_id, study_type, cast(coalesce(n, 0) as bigint) as article_count, status, case when status in ('failed', 'pending') then '' else concat_ws(',', case when status <> 'completed' then 'unsupported_status' end,
 case when n is null then 'empty_article_ids' end, case when rep then 'duplicate_article_ids' end, case when lost then 'missing_articles' end, case when not kt then 'unknown_study_type' end,
 case when not has_assessment then 'missing_assessment_payload' end, case when not has_scores then 'missing_score_payload' end,
 case when has_assessment and kt and assessment_task_id <> task_id then 'task_id_mismatch' end, case when has_assessment and kt and assessment_group_id <> group_id then 'group_id_mismatch' end,
 case when has_assessment and kt and assessment_study_type <> study_type then 'study_type_mismatch' end, case when has_assessment and kt and a1 then 'assessment_articles_mismatch' end,
 case when has_assessment and kt and bad then 'invalid_score_payload' end, case when has_assessment and kt and off then 'quality_score_mismatch' end,
 case when has_assessment and kt and s3 then 'duplicate_score_articles' end, case when has_assessment and kt and s1 then 'score_articles_mismatch' end) end as issues from flags),
 classed as (select *, case when status = 'failed' then 'failed' when status = 'pending' then 'pending' when issues <> '' then 'invalid' else 'eligible' end as class from checked)"""


def checked_batches(spark, sf_dir):
    o, li, p = (A.table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    lines = A.spark_sql(spark, _LINES, lineitem=li)
    scores = A.spark_sql(spark, _SCORES, lines=lines)
    ones = lines.select("batch_id", "article_id", F.lit(1.0).alias("score"))
    return audit.check_batches(
        A.spark_sql(spark, _BATCHES, orders=o), lines, A.spark_sql(spark, _ARTS, part=p),
        lines.filter("qty <> 5"), scores, ones)


@query(
    "p22_batch_eligibility",
    f"with {_DUCK_CHECK} select batch_id, task_id, study_type, article_count, issues, class from classed",
)
def batch_eligibility(spark, sf_dir):
    return checked_batches(spark, sf_dir).withColumn("issues", F.array_join("issues", ","))


Q_BY_TYPE = ", ".join(
    f"case when count(*) filter (where class = 'eligible' and study_type = '{t}') > 0 then '{t}:' || count(*) filter (where class = 'eligible' and study_type = '{t}') end"
    for t in sorted(rubrics.STUDY_TYPES)
)


@query(
    "a15_quality_checks_summary",
    f"""with {_DUCK_CHECK} select task_id, count(*) filter (where class = 'eligible') as eligible, count(*) filter (where class = 'failed') as failed, count(*) filter (where class = 'pending') as pending,
 count(*) filter (where class = 'invalid') as invalid, cast(coalesce(sum(article_count) filter (where class = 'eligible'), 0) as bigint) as eligible_articles, 3 * count(*) filter (where class = 'eligible') as planned_calls,
 3 * count(*) filter (where class = 'eligible') <= 6 as within_budget, concat_ws(',', {Q_BY_TYPE}) as eligible_by_type from classed group by 1""",
)
def quality_checks_summary(spark, sf_dir):
    return audit.checks_summary(checked_batches(spark, sf_dir), 6)


CONTRIB = "select doc_id as article_id, case doc_id % 4 when 0 then 'none' when 1 then 'low' when 2 then 'medium' else 'high' end as level from documents"
Q_CONTRIB = "cast(case level when 'high' then 3.0 when 'medium' then 2.0 when 'low' then 1.0 when 'none' then 0.0 end as double)"
PUB = "select doc_id as article_id, case when doc_id % 9 = 0 then null else make_date(cast(2000 + doc_id % 25 as int), 1, 1) end as publication_date from documents"


def contrib(spark, sf_dir):
    c = A.spark_sql(spark, CONTRIB, documents=A.table(spark, sf_dir, "documents"))
    return c.withColumn("contribution_score", portfolio.contribution_score(F.col("level")))


def publication(spark, sf_dir):
    return A.spark_sql(spark, PUB, documents=A.table(spark, sf_dir, "documents"))


@query("a25_contribution_score", f"with c as ({CONTRIB}) select article_id, level, {Q_CONTRIB} as contribution_score from c")
def contribution_score(spark, sf_dir):
    return contrib(spark, sf_dir)


@query(
    "j10_score_x_contribution_x_date",
    f"""with {DUCK_QUALITY}, c as ({CONTRIB}), p as ({PUB}) select coalesce(s.article_id, c.article_id, p.article_id) as article_id, round(s.composite_score, 6) as composite_score, {Q_CONTRIB} as contribution_score, p.publication_date,
 concat_ws(',', case when s.article_id is null then 'no_score' end, case when c.article_id is null then 'no_contribution' end, case when p.article_id is null then 'no_date_row' end) as issues
 from (select * from comp where article_id % 5 <> 0) s full join (select * from c where article_id % 7 <> 0) c on s.article_id = c.article_id
 full join (select * from p where article_id % 11 <> 0) p on coalesce(s.article_id, c.article_id) = p.article_id""",
)
def score_x_contribution_x_date(spark, sf_dir):
    j = portfolio.join_scores(
        comp(spark, sf_dir).select("article_id", "composite_score").filter("article_id % 5 <> 0"),
        contrib(spark, sf_dir).select("article_id", "contribution_score").filter("article_id % 7 <> 0"),
        publication(spark, sf_dir).filter("article_id % 11 <> 0"))
    return j.withColumn("issues", F.array_join("issues", ",")).withColumn("composite_score", F.round("composite_score", 6))


# Retained set: everything above the threshold, scores rounded so both engines order alike.
DUCK_RETAINED = f"""{DUCK_QUALITY}, c as ({CONTRIB}), p as ({PUB}), retained as (select s.article_id, round(s.composite_score, 6) as composite_score, {Q_CONTRIB} as contribution_score, p.publication_date
 from comp s join c on s.article_id = c.article_id join p on s.article_id = p.article_id where round(s.composite_score, 6) > 3.0)"""


def retained(spark, sf_dir):
    rows = comp(spark, sf_dir).select("article_id", F.round("composite_score", 6).alias("composite_score"))
    kept, _ = quality.partition_by_threshold(rows)
    c = contrib(spark, sf_dir).select("article_id", "contribution_score")
    return kept.join(c, "article_id").join(publication(spark, sf_dir), "article_id")


_Q_ORDER = "contribution_score desc, composite_score desc, publication_date desc nulls last, article_id"


@query("l03_rank_retained", f"with {DUCK_RETAINED} select article_id, row_number() over (order by {_Q_ORDER}) as position from retained")
def rank_retained(spark, sf_dir):
    return portfolio.rank_retained(retained(spark, sf_dir)).select("article_id", "position")


@query("l04_fallback_rank", f"with {DUCK_RETAINED} select article_id, row_number() over (order by composite_score desc, article_id) as position from retained")
def fallback_rank(spark, sf_dir):
    return portfolio.rank_fallback(retained(spark, sf_dir)).select("article_id", "position")


@query(
    "l05_conditional_truncate",
    f"""with {DUCK_RETAINED}, r as (select article_id, row_number() over (order by {_Q_ORDER}) as rn, count(*) over () as n from retained)
 select article_id, case when n <= 50 or rn <= 25 then 'kept' else 'truncated' end as "window" from r""",
)
def conditional_truncate(spark, sf_dir):
    return portfolio.truncate(retained(spark, sf_dir), portfolio.retained_order(), 50).select("article_id", "window")


_DUCK_CHUNKS = f"""{DUCK_RETAINED}, r as (select article_id, row_number() over (order by {_Q_ORDER}) as position from retained), k as (select *, (position - 1) // 3 as chunk, article_id % 3 = 0 as selected from r)"""


@query("w13_chunks_of_three", f"with {_DUCK_CHUNKS} select article_id, position, chunk from k where selected")
def chunks_of_three(spark, sf_dir):
    c = portfolio.chunks(retained(spark, sf_dir), portfolio.retained_order())
    return portfolio.keep_selected(c.withColumn("selected", F.col("article_id") % 3 == 0)).select("article_id", "position", "chunk")


@query(
    "j17_pairwise_inversions",
    """with r as (select p_brand as batch_id, case when p_partkey % 15 = 0 then null else p_size end as tier, case when p_partkey % 16 = 0 then null else p_retailprice end as score from part),
 f as (select a.batch_id, count(*) as conflicts from r a join r b on a.batch_id = b.batch_id and a.score > b.score and a.tier > b.tier group by 1)
 select distinct r.batch_id, coalesce(f.conflicts, 0) as conflicts, coalesce(f.conflicts, 0) = 0 as is_consistent from r left join f on r.batch_id = f.batch_id""",
)
def pairwise_inversions(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return audit.inversions(p.select(
        F.col("p_brand").alias("batch_id"),
        F.when(F.col("p_partkey") % 15 != 0, F.col("p_size")).alias("tier"),
        F.when(F.col("p_partkey") % 16 != 0, F.col("p_retailprice")).alias("score")))


_GAPS = """select doc_id % 40 as evaluation_id, cast(doc_id as string) as concept, case doc_id % 5 when 0 then 'direct' when 1 then 'absent' when 2 then 'partial' when 3 then 'indirect' else 'conflicting' end as status from documents"""


@query("a22_coverage_gaps", f"with g as ({_GAPS}) select evaluation_id, concept || ':' || status as gap from g where status <> 'direct'")
def coverage_gaps(spark, sf_dir):
    g = A.spark_sql(spark, _GAPS, documents=A.table(spark, sf_dir, "documents"))
    return portfolio.coverage_gaps(g).select("evaluation_id", "gap")


