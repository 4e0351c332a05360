"""Keyword scoring, coarse filter, candidate ranking and selection."""

import datetime as dt

from pyspark.sql import functions as F

from litmill import scale
from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.catalog.rules import DOC_TEXTS, DUCK_DESIGN, _TYPES, design, doc_texts
from litmill.catalog.scalars import Q_RECENCY
from litmill.functions import dates, values
from litmill.operators import rank, routing
from litmill.operators.search import Concept
from litmill.plans import corpus

REF = dt.date(2025, 1, 1)
# Literal research profile: frequent tokens of the test texts.
PROFILE = (
    Concept("drug", "thble", ("Thble", "from the")),
    Concept("population", "this", ("this",)),
    Concept("outcome", "from", ("from",)),
    Concept("other", "tion", ("tion", "en")),
)


def _has(field, terms):
    return " or ".join(f"contains(' ' || {field} || ' ', ' {t} ')" for t in terms)


def _concept(terms):
    return f"case when {_has('title_n', terms)} then 100.0 when {_has('body_n', terms)} then 70.0 else 0.0 end"


_S = [_concept([t.lower() for t in c.terms]) for c in PROFILE]
DUCK_KW = f"""{DOC_TEXTS}, dts as (select doc_id, case when doc_id % 6 = 0 then null else make_date(cast(2000 + doc_id % 25 as int), cast(1 + doc_id % 12 as int), 1) end as d, case when doc_id % 12 = 0 then null else cast(2000 + doc_id % 25 as int) end as y from documents),
 con as (select doc_id, cast({_S[0]} as double) as s0, cast({_S[1]} as double) as s1, cast({_S[2]} as double) as s2, cast({_S[3]} as double) as s3 from docs),
 kw as (select c.doc_id as article_id, round(0.9 * ((0.45 * s0 + 0.30 * s1 + 0.25 * s2) / 1.0) + 0.1 * s3, 6) as keyword_score, s0 > 0 as core_matched,
  concat_ws(',', case when s0 > 0 then 'thble' end, case when s1 > 0 then 'this' end, case when s2 > 0 then 'from' end, case when s3 > 0 then 'tion' end) as matched,
  d as publication_date, y as publication_year, round({Q_RECENCY.format(d='d', y='y')}, 6) as recency_score from con c join dts t on c.doc_id = t.doc_id)"""
_DATES = """select doc_id, case when doc_id % 6 = 0 then null else make_date(cast(2000 + doc_id % 25 as int), cast(1 + doc_id % 12 as int), 1) end as publication_date,
 case when doc_id % 12 = 0 then null else cast(2000 + doc_id % 25 as int) end as publication_year from documents"""


def keyword_rows(spark, sf_dir):
    """Scores rounded, so that both engines order alike."""
    t = doc_texts(spark, sf_dir)
    d = A.spark_sql(spark, _DATES, documents=A.table(spark, sf_dir, "documents"))
    m = rank.match_concepts(t, PROFILE, F.col("title_n"), F.col("body_n")).drop("title_n", "body_n")
    rows = m.join(d, "doc_id").withColumnRenamed("doc_id", "article_id")
    return rows.withColumn("keyword_score", F.round("keyword_score", 6)).withColumn(
        "recency_score", F.round(dates.recency(F.col("publication_date"), F.col("publication_year"), REF), 6))


@query("a01_weighted_keyword_score", f"with {DUCK_KW} select article_id, keyword_score, core_matched, matched from kw")
def weighted_keyword_score(spark, sf_dir):
    return keyword_rows(spark, sf_dir).select(
        "article_id", "keyword_score", "core_matched", F.array_join("matched_concepts", ",").alias("matched"))


_Q_COARSE = "core_matched desc, (keyword_score > 0) desc, 0.85 * keyword_score + 0.15 * recency_score desc, coalesce(publication_year, 0) desc, article_id desc"


def _coarse(table, out):
    """Coarse filter over a table of keyword rows, oracle side."""
    return f"""st as (select count(*) as total, count(*) filter (where core_matched and keyword_score > 0) as both_n, count(*) filter (where keyword_score > 0) as hits from {table}),
 o as (select *, row_number() over (order by {_Q_COARSE}) as place from {table}),
 {out} as (select o.*, case when case when total <= 200 then true when total > 400 then place <= 200 when both_n >= least(50, total) then core_matched and keyword_score > 0
  when hits >= least(50, total) then keyword_score > 0 else place <= 200 end then 'passed' else 'below_coarse_cut' end as coarse_status from o, st)"""


@query("l02_coarse_filter", f"with {DUCK_KW}, {_coarse('kw', 'c')} select article_id, keyword_score, coarse_status from c")
def coarse_filter(spark, sf_dir):
    rows = scale.stage(keyword_rows(spark, sf_dir), "scored")
    return rank.coarse_filter(rows, 200).select("article_id", "keyword_score", "coarse_status")


# The same with the upper bound out of reach, so that the whole table falls in the middle band.
_Q_MIDDLE = _coarse("kw", "c").replace("when total > 400 then place <= 200 ", "")


@query("l02_coarse_filter_middle", f"with {DUCK_KW}, {_Q_MIDDLE} select article_id, keyword_score, coarse_status from c")
def coarse_filter_middle(spark, sf_dir):
    rows = scale.stage(keyword_rows(spark, sf_dir), "scored")
    return rank.coarse_filter(rows, 200, 10**12).select("article_id", "keyword_score", "coarse_status")


DUCK_CAND = f"""{DUCK_KW}, q as (select embedding as e from embeddings where vec_id = 0), sem as (select k.*, round(list_cosine_similarity(cast(v.embedding as double[]), cast(q.e as double[])), 5) as cosine
  from kw k left join embeddings v on k.article_id = v.vec_id, q), cand as (select *, (cosine + 1) / 2 * 100 as semantic_score, round(0.5 * keyword_score + 0.4 * ((cosine + 1) / 2 * 100) + 0.1 * recency_score, 4) as candidate_score from sem)"""


def candidates(spark, sf_dir):
    """Scored candidates, written once: ranking and decision read them several times."""
    e = A.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    rows = keyword_rows(spark, sf_dir).join(e.select(F.col("vec_id").alias("article_id"), "embedding"), "article_id", "left")
    out = rank.candidate_score(rows, F.round(values.cosine_to(F.col("embedding"), q), 5)).drop("embedding")
    return scale.stage(out.withColumn("candidate_score", values.rounded(F.col("candidate_score"), 4)), "candidates")


@query("a04_candidate_score", f"with {DUCK_CAND} select article_id, cosine, round(semantic_score, 4) as semantic_score, candidate_score from cand")
def candidate_score(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "article_id", "cosine", F.round("semantic_score", 4).alias("semantic_score"), "candidate_score")


_Q_RANK = "candidate_score desc, core_matched desc, article_id"


@query("l01_rank_candidates", f"with {DUCK_CAND} select article_id, row_number() over (order by {_Q_RANK}) as selection_rank from cand")
def rank_candidates(spark, sf_dir):
    return rank.rank(candidates(spark, sf_dir)).select("article_id", "selection_rank")


_DUCK_DECIDE = f"""{DUCK_CAND}, {DUCK_DESIGN}, j as (select c.*, g.study_group from cand c join grouped g on c.article_id = g.article_id),
 adm as (select *, study_group in ({_TYPES}) as supported, sum(case when core_matched and study_group in ({_TYPES}) and candidate_score is not null then 1 else 0 end) over (order by {_Q_RANK} rows unbounded preceding) as taken from j),
 decided as (select article_id, study_group, case when not core_matched then 'core_intervention_not_matched' when not supported then 'unsupported_study_design' when candidate_score is null then 'no_vector' when taken > 50 then 'global_candidate_limit_reached' end as exclusion_reason,
  case when candidate_score is null then 'no_vector' when core_matched and supported and taken <= 50 then 'selected' else 'not_selected' end as selection_status from adm)"""


def decided(spark, sf_dir):
    g = design(spark, sf_dir)
    groups = g.select("article_id", routing.study_group(
        F.col("publication_types"), F.col("stated"), F.col("abstract")).alias("study_group"))
    return rank.decide(candidates(spark, sf_dir).join(groups, "article_id"), 50)


@query("p21_selection_decision", f"with {_DUCK_DECIDE} select article_id, study_group, selection_status, exclusion_reason from decided")
def selection_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("article_id", "study_group", "selection_status", "exclusion_reason")


@query(
    "a20_selection_summary",
    f"""with {_DUCK_DECIDE}, t as (select study_group, count(*) as n from decided where selection_status = 'selected' group by 1)
 select count(*) as scored, count(*) filter (where selection_status = 'selected') as selected, count(*) filter (where exclusion_reason = 'core_intervention_not_matched') as core_not_matched,
 count(*) filter (where exclusion_reason = 'unsupported_study_design') as unsupported_design, count(*) filter (where exclusion_reason = 'global_candidate_limit_reached') as limit_reached,
 (select string_agg(study_group || ':' || cast(n as varchar), ',' order by study_group || ':' || cast(n as varchar)) from t) as selected_by_type from decided""",
)
def selection_summary(spark, sf_dir):
    return rank.selection_summary(decided(spark, sf_dir))


@query(
    "l09_top_k_similar",
    """with q as (select embedding as e from embeddings where vec_id = 0), s as (select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(q.e as double[])), 4) as cosine,
 list_cosine_similarity(cast(embedding as double[]), cast(q.e as double[])) as c from embeddings, q) select vec_id, cosine, row_number() over (order by c desc, vec_id) as position from s order by c desc, vec_id limit 20""",
)
def top_k_similar(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    return rank.nearest(e, q, 20, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 4))


@query(
    "l09_nearest_many",
    """with v as (select vec_id, cast(embedding as double[]) as e from embeddings), p as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) as cosine from v q, v where q.vec_id % 50 = 0)
 select query_id, vec_id, round(cosine, 4) as cosine, cast(row_number() over (partition by query_id order by p.cosine desc, vec_id) as int) as position from p qualify position <= 20""",
)
def nearest_many(spark, sf_dir):
    """Every vector whose id is divisible by 50 against all vectors."""
    e = A.table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rank.nearest_many(e, asked, 20, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 4))


# ---- the flagship: resolve, score and rank the corpus ---------------------------

_TYPES_OF = "case canonical_id % 5 when 0 then 'Cohort Study' when 1 then 'Randomized Controlled Trial' when 2 then 'Letter' when 3 then 'Systematic Review' else 'Case-Control Study' end"


@query(
    "rank_corpus",
    f"""with recursive {A.DUCK_CLUSTERS}, art as (select cluster, list(record_id order by pos)[1] as canonical_id, list(title order by pos)[1] as title,
  list(abstract order by length(abstract) desc, pos) filter (where abstract <> '')[1] as abstract, list(publication_year order by pos) filter (where publication_year is not null)[1] as y,
  cast(list(publication_date order by pos) filter (where publication_date <> '')[1] as date) as d from ranked group by cluster),
 docs as (select canonical_id as doc_id, {A.q_match('title')} as title_n, {A.q_match("coalesce(abstract, '')")} as body_n from art),
 con as (select doc_id, cast({_S[0]} as double) as s0, cast({_S[1]} as double) as s1, cast({_S[2]} as double) as s2, cast({_S[3]} as double) as s3 from docs),
 kw as (select c.doc_id as article_id, 0.9 * ((0.45 * s0 + 0.30 * s1 + 0.25 * s2) / 1.0) + 0.1 * s3 as keyword_score, s0 > 0 as core_matched, y as publication_year, {Q_RECENCY.format(d='d', y='y')} as recency_score, {_TYPES_OF} as tp from con c join art on c.doc_id = art.canonical_id),
 cf as (select * from kw), q as (select embedding as e from embeddings where vec_id = 0),
 cand as (select cf.*, 0.5 * keyword_score + 0.4 * ((list_cosine_similarity(cast(v.embedding as double[]), cast(q.e as double[])) + 1) / 2 * 100) + 0.1 * recency_score as candidate_score
  from cf left join embeddings v on cf.article_id = v.vec_id, q),
 grp as (select *, case tp when 'Cohort Study' then 'cohort' when 'Randomized Controlled Trial' then 'randomized_controlled_trial' when 'Systematic Review' then 'systematic_review' when 'Case-Control Study' then 'case_control' else 'unknown' end as study_group from cand),
 adm as (select *, sum(case when core_matched and study_group <> 'unknown' and candidate_score is not null then 1 else 0 end) over (order by candidate_score desc, core_matched desc, article_id rows unbounded preceding) as taken from grp)
 select article_id, row_number() over (order by candidate_score desc, core_matched desc, article_id) as selection_rank, round(candidate_score, 2) as candidate_score, round(keyword_score, 2) as keyword_score, study_group,
 case when candidate_score is null then 'no_vector' when core_matched and study_group <> 'unknown' and taken <= 50 then 'selected' else 'not_selected' end as selection_status,
 case when not core_matched then 'core_intervention_not_matched' when study_group = 'unknown' then 'unsupported_study_design' when candidate_score is null then 'no_vector' when taken > 50 then 'global_candidate_limit_reached' end as exclusion_reason from adm""",
)
def rank_corpus(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    from litmill.operators.resolve import merge_clusters

    merged = scale.stage(
        merge_clusters(rec, clusters), "articles")
    arts = merged.select(
        F.col("canonical_id").alias("article_id"), "title", "abstract",
        dates.iso_date(F.col("publication_date")).alias("publication_date"), "publication_year",
        F.array(F.expr(_TYPES_OF)).alias("publication_types"), F.lit(None).cast("string").alias("study_design"))
    e = A.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    vectors = e.select(F.col("vec_id").alias("article_id"), "embedding")
    out = corpus.rank_corpus(arts, PROFILE, REF, vectors, q)
    return out.select(
        "article_id", "selection_rank", F.round("candidate_score", 2).alias("candidate_score"),
        F.round("keyword_score", 2).alias("keyword_score"), "study_group", "selection_status", "exclusion_reason")
