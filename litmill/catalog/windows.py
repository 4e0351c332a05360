"""Order within groups, batches and listings."""

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.functions import text
from litmill.operators import ordering as O


@query("w01_source_rank", "select doc_id, source, row_number() over (partition by source order by doc_id) as source_rank from documents")
def source_rank(spark, sf_dir):
    return O.source_rank(A.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query(
    "w02_first_per_key",
    """with k as (select source, md5(text) as source_record_id, min(doc_id) as doc_id, count(*) - 1 as dropped from documents group by 1, 2) select d.doc_id, d.lang, k.source, k.source_record_id, k.dropped from k join documents d on k.doc_id = d.doc_id""",
)
def first_per_key(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("source_record_id"))
    kept, lost = O.first_per_key(d, ["source", "source_record_id"], "doc_id")
    return kept.join(lost, ["source", "source_record_id"])


@query(
    "w03_ordered_distinct",
    f"""with w as (select doc_id, unnest(string_split(text, ' ')) as item, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents),
 k as (select *, {A.q_fold(A.q_collapse('item'))} as f, row_number() over (partition by doc_id, {A.q_fold(A.q_collapse('item'))} order by pos) as rn from w) select doc_id, item, cast(pos as integer) as pos from k where rn = 1 and f <> ''""",
)
def ordered_distinct(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    out = O.ordered_distinct_lists(d, ["doc_id"], F.split("text", " "), "item", "pos", text.list_key(F.col("item")))
    return out.select("doc_id", "item", "pos")


@query("w04_latest_by_key", "select user_id, event_type, arg_max(event_id, event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2")
def latest_by_key(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return O.latest_by_key(e, ["user_id", "event_type"], ["event_id"])


@query(
    "u02_union_latest",
    """with u as (select user_id, event_id as seq, value, 0 as part from events where event_id % 2 = 0 union all select user_id, event_id // 2 * 2, value, 1 from events where event_id % 3 = 0)
 select user_id, seq, value from (select *, row_number() over (partition by user_id order by seq desc, part desc) as rn from u) where rn = 1""",
)
def union_latest(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    a = e.filter("event_id % 2 = 0").select("user_id", F.col("event_id").alias("seq"), "value")
    b = e.filter("event_id % 3 = 0").select("user_id", F.expr("event_id div 2 * 2").alias("seq"), "value")
    return O.union_latest(["user_id"], ["seq"], a, b)


@query(
    "w05_quota_running_count",
    """select doc_id, source, cast(sum(case when doc_id % 3 = 0 then 1 else 0 end) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) as bigint) as admitted from documents""",
)
def quota_running_count(spark, sf_dir):
    from litmill import scale

    d = A.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return scale.running_sum(
        d, ["source"], [F.desc("n_chars"), F.asc("doc_id")], name="admitted",
        value=F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).drop("n_chars")


@query(
    "w06_latest_version",
    f"""with {A.DUCK_REC}, v as (select doi, record_id, coalesce(preprint_version, 0) as version from rec where doi is not null) select doi, arg_max(record_id, version * 100000000 - record_id) as record_id, max(version) as version from v group by 1""",
)
def latest_version(spark, sf_dir):
    from litmill.sources.bibliographic import latest_version as best

    v = A.records(spark, sf_dir).filter("doi is not null").select(
        "doi", "record_id", F.coalesce("preprint_version", F.lit(0)).alias("version"), F.col("record_id").alias("_place"))
    return best(v, "doi", "version").select("doi", "record_id", "version")


@query(
    "w11_balanced_batches",
    """with n as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as p, count(*) over (partition by lang) as n from documents),
 k as (select *, cast(ceil(n / 7.0) as bigint) as k from n), b as (select *, n // k as b, n % k as r from k),
 x as (select doc_id, lang, cast(case when p < r * (b + 1) then p // (b + 1) else r + (p - r * (b + 1)) // b end as integer) as batch_index from b)
 select doc_id, lang, batch_index, lang || ':batch-' || lpad(cast(batch_index + 1 as varchar), 3, '0') as batch_id from x""",
)
def balanced_batches(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return O.balanced_batches(d, "lang", 7, [F.asc("doc_id")])


@query(
    "w12_round_robin",
    """with t as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as turn from documents) select doc_id, lang, turn, row_number() over (order by turn, lang) as dispatch from t""",
)
def round_robin(spark, sf_dir):
    return O.round_robin(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", [F.asc("doc_id")], "lang")


@query(
    "w14_next_sequence",
    """with s as (select conv_id, max(turn) as last from conversations where turn < 2 and conv_id % 5 <> 0 group by 1) select c.conv_id, c.turn, coalesce(s.last, -1) + row_number() over (partition by c.conv_id order by c.turn) as sequence_no
 from conversations c left join s on c.conv_id = s.conv_id where c.turn >= 2""",
)
def next_sequence(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    stored = c.filter("turn < 2 and conv_id % 5 <> 0").withColumnRenamed("turn", "sequence_no")
    return O.next_sequence(stored, c.filter("turn >= 2").select("conv_id", "turn"), "conv_id", [F.asc("turn")])


@query(
    "w15_stage_changes",
    """with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) select * from l where previous is null or previous <> event_type""",
)
def stage_changes(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return O.stage_changes(e, "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", "event_type", "previous")


@query("w16_tier_rank", "select p_partkey, p_brand, p_size, dense_rank() over (partition by p_brand order by p_size desc) as tier from part")
def tier_rank(spark, sf_dir):
    return O.tiers(A.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size")


@query(
    "l06_source_cap",
    "select doc_id, source, source_rank from (select doc_id, source, row_number() over (partition by source order by doc_id) as source_rank from documents) where source_rank <= 20",
)
def source_cap(spark, sf_dir):
    return O.cap_per_source(A.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20)


@query("l07_latest_listing", "select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey desc limit 50")
def latest_listing(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return O.latest(o, 50, [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey")


@query(
    "l08_latest_task_for_query",
    "select o_orderpriority as query, arg_max(o_orderkey, epoch_ms(o_orderdate) * 1000 + o_orderkey) as task_id from orders group by 1".replace("epoch_ms(o_orderdate) * 1000", "(epoch_ms(o_orderdate) // 1000) * 10000000"),
)
def latest_task_for_query(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("task_id"), "o_orderdate")
    return O.latest_by_key(o, ["query"], ["o_orderdate", "task_id"]).select("query", "task_id")


@query(
    "s11_recent_sample",
    f"""with {A.DUCK_REC} select record_id, publication_date from rec where peer_review_status = 'unknown' and abstract_available and publication_date is not null order by publication_date desc, record_id limit 25""",
)
def recent_sample(spark, sf_dir):
    from litmill.sources.snapshots import recent

    rec = A.records(spark, sf_dir).filter("publication_date is not null")
    return recent(rec, F.col("peer_review_status") == "unknown", 25).select("record_id", "publication_date")


@query(
    "s10_scan_task_snapshot",
    """with t as (select c_custkey as task_id from customer where c_mktsegment = 'BUILDING') select o.o_orderkey as batch_id, o.o_custkey as task_id, count(l.l_orderkey) as articles, count(distinct l.l_partkey) as distinct_articles
 from orders o join t on o.o_custkey = t.task_id left join lineitem l on o.o_orderkey = l.l_orderkey group by 1, 2""",
)
def scan_task_snapshot(spark, sf_dir):
    from litmill.operators.audit import task_snapshot

    o, li, c = (A.table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    return task_snapshot(
        c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("task_id")),
        o.select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("task_id")),
        li.select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("article_id")))
