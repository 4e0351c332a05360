"""Aggregations over records, events and batches."""

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.catalog.rules import DOC_TEXTS, doc_texts
from litmill.operators import audit, resolve, search


def members(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    return resolve.assign(rec, clusters).withColumn("_o", resolve.member_order())


@query(
    "a05_first_non_blank",
    f"""with recursive {A.DUCK_CLUSTERS} select cluster, list(first_author order by pos) filter (where first_author <> '')[1] as first_author, list(issn order by pos) filter (where issn <> '')[1] as issn,
 list(citation_count order by pos) filter (where citation_count is not null)[1] as citation_count from ranked group by 1""",
)
def first_non_blank(spark, sf_dir):
    o = F.col("_o")
    return members(spark, sf_dir).groupBy("cluster").agg(
        resolve.first_filled("first_author", o).alias("first_author"), resolve.first_filled("issn", o).alias("issn"),
        resolve.first_value("citation_count", o).alias("citation_count"))


@query(
    "a06_longest_text",
    f"with recursive {A.DUCK_CLUSTERS} select cluster, md5(list(abstract order by length(abstract) desc, pos) filter (where abstract <> '')[1]) as longest_md5 from ranked group by 1",
)
def longest_text(spark, sf_dir):
    return members(spark, sf_dir).groupBy("cluster").agg(
        F.md5(resolve.longest_text("abstract", F.col("_o"))).alias("longest_md5"))


@query(
    "a08_tri_state_or",
    """select source, bool_or(case when d.doc_id % 3 = 0 then null else toxic = 1 end) as toxic, bool_or(case when l.doc_id is null then null else quality > 5 end) as never
 from documents d left join labels l on d.doc_id = l.doc_id group by 1""",
)
def tri_state_or(spark, sf_dir):
    d, lab = A.table(spark, sf_dir, "documents").select("doc_id", "source"), A.table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left").select(
        "source", F.when(F.col("doc_id") % 3 != 0, F.col("toxic") == 1).alias("toxic"), (F.col("quality") > 5).alias("never"))
    return j.groupBy("source").agg(resolve.tri_state_or("toxic").alias("toxic"), resolve.tri_state_or("never").alias("never"))


@query(
    "a09_max_any",
    f"""with recursive {A.DUCK_CLUSTERS} select cluster, max(preprint_version) as preprint_version, max(citation_count) as citation_count, bool_or(is_retracted) as is_retracted,
 bool_or(can_download_full_text) as can_download from ranked group by 1""",
)
def max_any(spark, sf_dir):
    return members(spark, sf_dir).groupBy("cluster").agg(
        F.max("preprint_version").alias("preprint_version"), F.max("citation_count").alias("citation_count"),
        resolve.any_flag("is_retracted").alias("is_retracted"), resolve.any_flag("can_download_full_text").alias("can_download"))


@query(
    "a10_review_status_merge",
    f"""with recursive {A.DUCK_CLUSTERS} select cluster, case max(case peer_review_status when 'peer_reviewed' then 2 when 'unknown' then 1 else 0 end) when 2 then 'peer_reviewed' when 1 then 'unknown' else 'preprint' end as status from ranked group by 1""",
)
def review_status_merge(spark, sf_dir):
    return members(spark, sf_dir).groupBy("cluster").agg(resolve.best_review_status().alias("status"))


@query(
    "a11_merge_resources",
    """with r as (select regexp_extract(url, '://([^/]+)', 1) as host, page_id, case page_id % 2 when 0 then 'pdf' else 'html' end as format, case when page_id % 3 = 0 then upper(regexp_replace(url, '[?#].*$', '')) else regexp_replace(url, '[?#].*$', '') end as url from pages)
 select host, url, format from (select *, row_number() over (partition by host, format, lower(url) order by page_id) as rn from r) where rn = 1""",
)
def merge_resources(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "[?#].*$", "")
    rows = p.select(
        F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id",
        F.array(F.struct(
            F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("html").alias("format"),
            F.when(F.col("page_id") % 3 == 0, F.upper(bare)).otherwise(bare).alias("url"))).alias("full_text_resources"))
    got = resolve.union_resources(rows, "host", F.col("page_id"))
    return got.select("host", "resource.url", "resource.format")


@query("a12_group_articles", "select lang as group_id, doc_id as article_id, row_number() over (partition by lang order by doc_id) as seq from documents")
def group_articles(spark, sf_dir):
    from litmill import scale

    d = A.table(spark, sf_dir, "documents").select(F.col("lang").alias("group_id"), F.col("doc_id").alias("article_id"))
    return scale.running_sum(d, ["group_id"], [F.asc("article_id")], name="seq")


_RUNS = "select distinct source as search_run_id, source = 'src3' as failed from documents union all select 'src-none', false union all select 'src-down', true"


@query(
    "a14_run_metrics",
    f"""with runs as ({_RUNS}), g as (select source, count(*) as n, count(*) filter (where doc_id % 9 = 0 and source <> 'src1') as bad from documents group by 1)
 select search_run_id, coalesce(n, 0) as retrieved, coalesce(bad, 0) as invalid_records, case when failed then 'failed' when coalesce(bad, 0) > 0 then 'partial_success' when coalesce(n, 0) = 0 then 'success_empty' else 'success_with_results' end as status
 from runs left join g on runs.search_run_id = g.source""",
)
def run_metrics(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    recs = d.select(F.col("source").alias("search_run_id"), ((F.col("doc_id") % 9 == 0) & (F.col("source") != "src1")).alias("invalid"))
    return audit.run_metrics(A.spark_sql(spark, _RUNS, documents=d), recs).drop("failed")


@query(
    "a16_progress_counts",
    """select o_custkey as task_id, count(*) as planned, count(*) filter (where o_orderstatus = 'P') as pending, count(*) filter (where o_orderstatus = 'O' and o_orderkey % 2 = 0) as processing,
 count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus = 'O' and o_orderkey % 2 = 1) as failed, 0 as cancelled from orders where o_orderpriority <> '5-LOW' group by 1""",
)
def progress_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    status = F.when(s == "P", "pending").when(s == "F", "completed").when(F.col("o_orderkey") % 2 == 0, "processing").otherwise("failed")
    b = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), status.alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "portfolio").otherwise("article").alias("kind"))
    return audit.progress(b, "task_id")


@query(
    "a21_search_overview",
    f"""with recursive {A.DUCK_CLUSTERS} select count(distinct search_run_id) as sources, count(*) as provider_records, count(distinct cluster) as unique_records, count(*) - count(distinct cluster) as duplicates,
 count(*) filter (where pos = 1 and record_id % 3 = 0) as retained, count(*) filter (where pos = 1 and record_id % 30 = 0) as recommended from ranked""",
)
def search_overview(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    dedup = resolve.dedup_metrics(rec, clusters)
    runs = rec.agg(F.count_distinct("search_run_id").alias("n")).scalar()
    best = resolve.canonical(rec, clusters).agg(F.struct(
        F.count_if(F.col("canonical_id") % 3 == 0).alias("a"), F.count_if(F.col("canonical_id") % 30 == 0).alias("b"))).scalar()
    return dedup.withColumn("_b", best).select(
        runs.alias("sources"), F.col("input_count").alias("provider_records"), F.col("unique_count").alias("unique_records"),
        F.col("duplicate_count").alias("duplicates"), F.col("_b.a").alias("retained"), F.col("_b.b").alias("recommended"))


@query(
    "a23_concept_coverage",
    """with r as (select item_id as query_id, unnest(string_split(text, ' ')) as concept from benchmark), c as (select doc_id % 40 as query_id, unnest(string_split(text, ' ')) as concept from documents),
 a as (select query_id, concept, count(*) n from r group by 1, 2), b as (select query_id, concept, count(*) n from c group by 1, 2)
 select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.concept, b.concept) as concept, coalesce(a.n, 0) as required_rows, coalesce(b.n, 0) as covered_rows,
 case when b.n is null then 'not_covered' when a.n is null then 'not_required' when a.n > 1 or b.n > 1 then 'repeated' end as issue from a full join b on a.query_id = b.query_id and a.concept = b.concept""",
)
def concept_coverage(spark, sf_dir):
    r = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", " ")).alias("concept"))
    c = A.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 40).alias("query_id"), F.explode(F.split("text", " ")).alias("concept"))
    return search.concept_cover(r, c)


@query(
    "a24_joint_coverage",
    f"""with {DOC_TEXTS}, t(group_id, term) as (values (1, 'this'), (2, 'thble'), (3, 'from'), (3, 'en')), h as (select distinct d.doc_id, t.group_id from docs d join t on contains(' ' || d.body_n || ' ', ' ' || t.term || ' ')),
 per as (select doc_id, count(*) as n from h group by 1) select (select count(*) from per where n = 3) as covering_docs, (select count(distinct group_id) from h) as covered_concepts,
 case when (select count(*) from per where n = 3) > 0 then 'joint' when (select count(distinct group_id) from h) = 3 then 'union_only' else 'incomplete' end as cover""",
)
def joint_coverage(spark, sf_dir):
    terms = spark.createDataFrame([(1, "this"), (2, "thble"), (3, "from"), (3, "en")], "group_id int, term string")
    hits = search.phrase_match(doc_texts(spark, sf_dir), terms, "doc_id", ["body_n"], max_words=1)
    return search.joint_cover(hits, 3)


@query(
    "a26_result_log_counts",
    f"""with {A.DUCK_REC} select search_run_id, count(*) as records, count(*) filter (where abstract_available) as with_abstract, count(*) filter (where is_open_access) as open_access, count(*) filter (where can_download_full_text) as downloadable from rec group by 1""",
)
def result_log_counts(spark, sf_dir):
    return audit.result_counts(A.records(spark, sf_dir), "search_run_id")


@query(
    "a27_stage_latency",
    "select event_type as stage, count(*) as attempts, round(sum(value), 4) as total_ms, round(avg(value), 6) as mean_ms, max(value) as max_ms, quantile_disc(value, 0.5) as median_ms, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as input_tokens,\n coalesce(cast(sum(case when event_id % 3 = 0 then event_id % 100 end) as bigint), 0) as output_tokens from events group by 1",
)
def stage_latency(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), "value", F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).alias("output_tokens"))
    got = audit.stage_latency(e, "stage", "value", ["input_tokens", "output_tokens"])
    return got.withColumn("total_ms", F.round("total_ms", 4)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(
    "a27_peak_in_flight",
    """with s as (select epoch_ms(ts) // 1000 as a, epoch_ms(ts) // 1000 + cast(floor(value) as bigint) * 10 as b from events), e as (select a as tt, 1 as step from s union all select b, -1 from s),
 d as (select tt, step, sum(step) as delta from e group by 1, 2) select cast(max(opn) as bigint) as peak from (select sum(delta) over (order by tt, step rows unbounded preceding) as opn from d)""",
)
def peak_in_flight(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    s = e.select(start.alias("a"), (start + F.floor("value").cast("long") * 10).alias("b"))
    return audit.peak_in_flight(s, "a", "b")


_PATCH = """select event_id as seq, user_id as task_id, case when event_id % 3 = 0 then event_type end as stage, case event_id % 5 when 0 then 'running' when 1 then 'failed' end as status,
 case when event_id % 5 = 1 then 'E' || cast(event_id as string) end as error, case when event_id % 4 = 2 then value end as result from events"""


@query(
    "a29_apply_patches",
    f"""with p as ({_PATCH}), g as (select task_id, arg_max(stage, seq) filter (where stage is not null) as stage, arg_max(status, seq) filter (where status is not null) as status,
 arg_max(result, seq) filter (where result is not null) as result, arg_max(error, seq) filter (where error is not null) as error, max(case when status = 'running' then seq end) as run, max(case when error is not null then seq end) as err from p group by 1)
 select task_id, stage, status, result, case when coalesce(run > err, false) then null else error end as error from g""",
)
def apply_patches(spark, sf_dir):
    p = A.spark_sql(spark, _PATCH, events=A.table(spark, sf_dir, "events"))
    return audit.apply_patches(p, "task_id", "seq", ["stage", "status", "result"], "error", "status")


