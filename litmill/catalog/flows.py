"""The composite jobs, end to end over the test tables."""

from pyspark.sql import functions as F

from litmill import scale
from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.catalog.joins import RES, resources
from litmill.catalog.quality import (
    CONTRIB, DUCK_NAMED, DUCK_RETAINED, Q_BY_TYPE, _DUCK_CHECK, _Q_ORDER, checked_batches, named, retained,
)
from litmill.catalog.rules import rel
from litmill.operators import portfolio, rubrics
from litmill.plans import corpus


@query(
    "resolve_corpus",
    f"""with recursive {A.DUCK_CLUSTERS} select record_id as canonical_id, cluster, source, title, (select count(*) from ranked) as records from ranked where pos = 1""",
)
def resolve_corpus(spark, sf_dir):
    rec = A.records(spark, sf_dir)
    out = corpus.resolve_corpus(rec)
    n = rec.agg(F.count("*")).scalar()
    return out.articles.select("canonical_id", "cluster", "source", "title").withColumn("records", n)


_GROUP = "case article_id % 4 when 0 then 'cohort' when 1 then 'randomized_controlled_trial' when 2 then 'narrative_review' else 'unknown' end"
_DUCK_SCREEN = f"""{DUCK_NAMED}, sizes as (select study_type, count(*) as expected from rubric group by 1),
 cover as (select n.article_id, count(*) as given, count(distinct n.criterion_id) as d, count(distinct r.criterion_id) as k, max(s.expected) as expected, avg(n.score) as mean, count(n.score) as applicable
  from named n left join rubric r on n.study_type = r.study_type and n.criterion_id = r.criterion_id left join sizes s on n.study_type = s.study_type group by 1),
 fine as (select article_id, cast(5 + 5 * mean as double) as quality_score from cover where expected is not null and given = d and d = k and k = expected and applicable > 0 and article_id % 4 <> 3),
 rel as (select doc_id as article_id, cast(doc_id * 13 % 101 / 10.0 as double) as relevance_score, cast(doc_id * 29 % 101 / 10.0 as double) as answerability_score from documents),
 sc as (select f.article_id, round(0.5 * relevance_score + 0.25 * quality_score + 0.15 * answerability_score + 0.5, 6) as composite_score from fine f join rel r on f.article_id = r.article_id)"""


@query(
    "screen_quality",
    f"with {_DUCK_SCREEN} select article_id, composite_score, composite_score > 3.0 as retained from sc",
)
def screen_quality(spark, sf_dir):
    arts = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"))
    arts = arts.withColumn("study_group", F.expr(_GROUP))
    rub, _, _ = rubrics.rubric_tables(spark)
    crit = named(spark, sf_dir).drop("score")
    s = corpus.screen_quality(arts, crit, rel(spark, sf_dir), rub)
    cols = ["article_id", F.round("composite_score", 6).alias("composite_score")]
    yes = s.retained.select(*cols, F.lit(True).alias("retained"))
    return yes.unionByName(s.excluded.select(*cols, F.lit(False).alias("retained")))


_DUCK_PORT = f"{DUCK_RETAINED}, r as (select article_id, composite_score, row_number() over (order by {_Q_ORDER}) as position, count(*) over () as n from retained)"


@query(
    "rank_portfolio",
    f"with {_DUCK_PORT} select article_id, position, case when n <= 50 or position <= 25 then 'kept' else 'truncated' end as \"window\" from r",
)
def rank_portfolio(spark, sf_dir):
    c = A.spark_sql(spark, CONTRIB, documents=A.table(spark, sf_dir, "documents"))
    rows = retained(spark, sf_dir).drop("contribution_score")
    return corpus.rank_portfolio(rows, c, 50).select("article_id", "position", "window")


@query(
    "recommend",
    f"""with {_DUCK_PORT}, top as (select article_id, position, cast((position - 1) // 3 as integer) as chunk from r where position <= case when n > 50 then 25 else n end),
 res as ({RES}), best as (select * from (select *, row_number() over (partition by page_id % 97 order by case lower(format) when 'pdf' then 0 when 'xml' then 1 when 'html' then 2 when 'epub' then 3 when 'text' then 4 when 'other' then 5 else 99 end,
  case when is_preferred then 0 else 1 end, resource_id) as rn from res where is_downloadable and is_open_access) where rn = 1)
 select t.article_id, t.position, t.chunk, b.resource_id, lower(b.format) as format from top t left join best b on t.article_id = b.page_id % 97""",
)
def recommend(spark, sf_dir):
    ranked = scale.stage(portfolio.truncate(retained(spark, sf_dir), portfolio.retained_order(), 50), "portfolio")
    kept = ranked.filter("window = 'kept'").withColumn("has_summary", F.lit(True)).withColumn("summary_article_id", F.col("article_id"))
    res = resources(spark, sf_dir).withColumn("article_id", F.col("page_id") % 97)
    out = corpus.recommend(kept, res, portfolio.retained_order())
    return out.select("article_id", "position", "chunk", "resource_id", "format")


@query(
    "audit_batches",
    f"""with {_DUCK_CHECK} select task_id, count(*) filter (where class = 'eligible') as eligible, count(*) filter (where class = 'failed') as failed, count(*) filter (where class = 'pending') as pending,
 count(*) filter (where class = 'invalid') as invalid, cast(coalesce(sum(article_count) filter (where class = 'eligible'), 0) as bigint) as eligible_articles, 3 * count(*) filter (where class = 'eligible') as planned_calls, true as within_budget, concat_ws(',', {Q_BY_TYPE}) as eligible_by_type from classed group by 1""",
)
def audit_batches(spark, sf_dir):
    return corpus.audit_batches(checked_batches(spark, sf_dir))
