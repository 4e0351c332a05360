"""Writers: each query writes a table and returns what is read back."""

from pyspark.sql import functions as F

from litmill import scale
from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.catalog.joins import DUCK_SPANS, DUCK_STORED, RES, UP, duck_upsert, halves, resources
from litmill.catalog.quality import DUCK_RETAINED, retained
from litmill.operators import portfolio, spans, store
from litmill.sources import sinks


@query(
    "k01_write_provenance",
    f"""with k as (select source, 'run-' || source as search_run_id, md5(text) as source_record_id, min(doc_id) as pos from documents group by 1, 2, 3)
 select search_run_id, source_record_id, k.source, row_number() over (partition by search_run_id order by pos) as source_rank, case when pos % 5 <> 0 then 'success' else 'failed' end as normalization_status,
 sha256('{{"lang":"' || d.lang || '","search_run_id":"' || search_run_id || '","source":"' || k.source || '","source_record_id":"' || source_record_id || '"}}') as payload_hash from k join documents d on d.doc_id = k.pos""".replace("{{", "{").replace("}}", "}"),
)
def write_provenance(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    raw = d.select(
        F.col("doc_id").alias("pos"), "source", F.concat(F.lit("run-"), F.col("source")).alias("search_run_id"),
        F.md5("text").alias("source_record_id"), "lang")
    firsts = raw.groupBy("search_run_id", "source_record_id").agg(F.min("pos").alias("pos"))
    out = sinks.write_provenance(raw, firsts.filter("pos % 5 <> 0"), scale.new_path(spark, "provenance"))
    return out.select("search_run_id", "source_record_id", "source", "source_rank", "normalization_status", "payload_hash")


_REQ = "select distinct source as search_run_id, 'query of ' || source as compiled_query, source = 'src3' as failed from documents union all select 'src-none', 'nothing', false"


@query(
    "k02_write_run_ledger",
    f"""with r as ({_REQ}), g as (select source, count(*) as n from documents where source <> 'src3' group by 1) select search_run_id, sha256(compiled_query) as query_hash, coalesce(n, 0) as retrieved_count,
 case when failed then 'failed' when coalesce(n, 0) = 0 then 'success_empty' else 'success_with_results' end as status from r left join g on r.search_run_id = g.source""",
)
def write_run_ledger(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    got = d.filter("source <> 'src3'").select(F.col("source").alias("search_run_id"))
    out = sinks.write_runs(A.spark_sql(spark, _REQ, documents=d), got, scale.new_path(spark, "runs"))
    return out.select("search_run_id", "query_hash", "retrieved_count", "status")


_COLS = ("article_id", "title", *UP, "publication_year", "is_retracted")


@query(
    "k03_upsert_articles",
    f"""with recursive {DUCK_STORED}, {duck_upsert('stored', 'inc')}
 select {", ".join(_COLS)}, array_to_string(publication_types, '|') as publication_types from after""",
)
def upsert_articles(spark, sf_dir):
    stored, inc = halves(spark, sf_dir)
    after = store.upsert_articles(stored, inc, store.match_existing(inc, stored))
    out = sinks.write_snapshot(after.select(*_COLS, "publication_types"), scale.new_path(spark, "articles"))
    return out.withColumn("publication_types", F.array_join("publication_types", "|"))


@query(
    "k04_upsert_resources",
    f"""with r as ({RES}), old as (select article_id, url, format, 'L' as landing_url, is_open_access, is_downloadable, is_preferred and is_downloadable as was, -1 as seq from r where page_id % 2 = 0 and page_id % 3 <> 0),
 new as (select article_id, url, format, '' as landing_url, page_id % 3 = 0 as is_open_access, page_id % 4 = 0 as is_downloadable, false as was, page_id as seq from r where page_id % 2 = 1 or page_id % 4 = 0),
 allr as (select * from old union all select * from new),
 m as (select article_id, url, arg_min(format, seq) as format, arg_min(landing_url, seq) filter (where landing_url <> '') as landing_url, coalesce(case when bool_or(is_open_access) then true end, arg_min(is_open_access, seq)) as is_open_access,
  coalesce(case when bool_or(is_downloadable) then true end, arg_min(is_downloadable, seq)) as is_downloadable, bool_or(was) as was from allr group by 1, 2),
 ch as (select article_id, url from (select *, row_number() over (partition by article_id order by seq desc) as rn from new where is_downloadable) where rn = 1)
 select m.article_id, m.url, m.format, m.landing_url, m.is_open_access, m.is_downloadable, case when ch.url is null then m.was else m.url = ch.url end as is_preferred from m left join ch on m.article_id = ch.article_id""",
)
def upsert_resources(spark, sf_dir):
    r = resources(spark, sf_dir)
    old = r.filter("page_id % 2 = 0 and page_id % 3 <> 0").select(
        "article_id", "url", "format", F.lit("L").alias("landing_url"), "is_open_access", "is_downloadable",
        (F.col("is_preferred") & F.col("is_downloadable")).alias("is_preferred"), F.col("page_id").alias("record_seq"))
    new = r.filter("page_id % 2 = 1 or page_id % 4 = 0").select(
        "article_id", "url", "format", F.lit("").alias("landing_url"), (F.col("page_id") % 3 == 0).alias("is_open_access"),
        (F.col("page_id") % 4 == 0).alias("is_downloadable"), F.lit(False).alias("is_preferred"),
        F.col("page_id").alias("seq"), F.col("page_id").alias("record_seq"))
    after = store.upsert_resources(old, new)
    return sinks.write_snapshot(after, scale.new_path(spark, "resources"))


@query(
    "k05_put_embeddings_if_absent",
    "select vec_id, label, 64 as dimension, true as normalized, vec_id % 3 = 0 as stored_before from embeddings",
)
def put_embeddings_if_absent(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    path = scale.new_path(spark, "vectors")
    old = store.checked_vectors(e.filter("vec_id % 3 = 0")).withColumn("stored_before", F.lit(True))
    old.write.parquet(f"{path}/batch=first")
    new = e.withColumn("stored_before", F.lit(False))
    sinks.put_embeddings(path, new.filter("vec_id % 3 = 1"), ["vec_id"], "second")
    return sinks.put_embeddings(path, new, ["vec_id"], "second").select("vec_id", "label", "dimension", "normalized", "stored_before")


@query(
    "k06_register_plan",
    """select o_custkey as task_id, o_orderkey as batch_id, o_orderstatus as status from orders where o_orderkey % 4 = 0 union all select o_custkey, o_orderkey, 'pending' from orders where o_orderkey % 4 <> 0""",
)
def register_plan(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("batch_id"), F.col("o_orderstatus").alias("status"))
    plan = o.withColumn("status", F.lit("pending"))
    return sinks.register_plan(o.filter("batch_id % 4 = 0"), plan, ["task_id", "batch_id"])


@query(
    "k07_write_ranking_audit",
    f"""with {DUCK_RETAINED} select article_id, row_number() over (order by composite_score desc, article_id) as position, 'written' as sink_status from retained""",
)
def write_ranking_audit(spark, sf_dir):
    ranked = portfolio.rank_fallback(retained(spark, sf_dir)).select("article_id", "position")
    path = scale.new_path(spark, "audit")
    status, where, _ = sinks.write_ranking_audit(ranked, ranked.agg(F.count("*").alias("scored")), path)
    back = spark.read.schema(ranked.schema).json(f"{where}/ranking")
    return back.withColumn("sink_status", F.lit(status))


@query(
    "k08_backfill_spans",
    f"""with {DUCK_SPANS}, c as (select article_id, count(*) as n from spans group by 1) select a.article_id, case when a.article_id % 3 = 0 then 0 else coalesce(c.n, 0) end as span_count,
 case when a.article_id % 3 = 0 then 'old' else '{spans.SEGMENTER_VERSION}' end as span_version from arts a left join c on a.article_id = c.article_id""",
)
def backfill_spans(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    kept = F.col("doc_id") % 3 == 0
    arts = d.select(
        F.col("doc_id").alias("article_id"), F.expr("split_part(text, chr(10), 1)").alias("title"), F.col("text").alias("abstract"),
        F.when(kept, F.array().cast(spans.SPAN_TYPE)).alias("spans"), F.when(kept, F.lit("old")).alias("span_version"))
    out = sinks.write_snapshot(spans.backfill(arts), scale.new_path(spark, "spans"))
    return out.select("article_id", F.size("spans").alias("span_count"), "span_version")


@query(
    "k09_write_summary_doc",
    f"""with {DUCK_RETAINED} select article_id, cast(article_id % 7 as varchar) as task_id, composite_score from retained""",
)
def write_summary_doc(spark, sf_dir):
    rows = retained(spark, sf_dir).select("article_id", "composite_score")
    path = scale.new_path(spark, "summaries")
    task = (F.col("article_id") % 7).cast("string")
    sinks.write_summary(rows, path, task, "2025-01-01")
    back = sinks.write_summary(rows, path, task, "2025-01-02")
    doc = F.from_json("document", "article_id long, composite_score double")
    return back.select(doc.alias("d"), F.col("task_id").cast("string").alias("task_id")).select("d.article_id", "task_id", "d.composite_score")


@query(
    "k10_append_messages",
    """with s as (select conv_id, max(turn) as last from conversations where turn < 2 group by 1) select c.conv_id, coalesce(s.last, -1) + row_number() over (partition by c.conv_id order by c.turn) as sequence_no, c.role, substr(c.text, 1, 160) as preview
 from conversations c left join s on c.conv_id = s.conv_id where c.turn >= 2 and c.conv_id % 6 <> 0""",
)
def append_messages(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    stored = c.filter("turn < 2").withColumnRenamed("turn", "sequence_no")
    new = c.filter("turn >= 2").select("conv_id", "turn", "role", "text")
    got = sinks.append_messages(stored, c.filter("conv_id % 6 <> 0"), new).select("conv_id", "sequence_no", "role", "preview")
    return sinks.write_snapshot(got, scale.new_path(spark, "messages"))


@query("k11_write_bench_report", "select event_type as stage, count(*) as n, max(value) as max_ms from events group by 1")
def write_bench_report(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.max("value").alias("max_ms"))
    path = scale.new_path(spark, "bench")
    sinks.write_bench(e, path)
    return spark.read.schema("stage string, n long, max_ms double").json(path)
