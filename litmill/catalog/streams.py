"""Streaming queries, driven to completion over the event files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill import scale
from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.catalog.joins import UP, duck_upsert
from litmill.operators import logstore, resolve
from litmill.streaming import jobs

KINDS = ("view", "click", "signup", "purchase", "error")
_STAGE = "case event_type when 'signup' then 'started' when 'purchase' then 'completed' when 'error' then 'failed' else 'working' end"
_WORK = "case event_type when 'view' then 'processing' when 'click' then 'processing' when 'error' then 'failed' else 'completed' end"


def stream_session(spark, rocksdb=False):
    """Own session for a stream's settings; the caller's session is left as it is.

    On a local master there is one state partition per core; a cluster keeps its
    own setting.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    if rocksdb:
        own.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    sc = spark.sparkContext
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    own.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism) if sc.master.startswith("local") else parts)
    return own


def events(spark, sf_dir, rocksdb=False):
    spark = stream_session(spark, rocksdb)
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
        ]
    )
    return jobs.read_events(spark, sf_dir, "events.parquet", schema)


def batch_events(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream, mode):
    """Run a stream over all available input into files, and read them back."""
    spark = stream.sparkSession
    root = scale.new_path(spark, "stream")
    if mode == "append":
        q = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/v{number:09d}")

    q = (
        stream.writeStream.foreachBatch(put).outputMode("complete")
        .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{root}/out/v{last:09d}")


@query(
    "t01_progress_stream",
    "select user_id, count(*) as planned, " + ", ".join(f"count(*) filter (where event_type = '{k}') as \"{k}\"" for k in KINDS) + " from events group by 1",
)
def progress_stream(spark, sf_dir):
    return drained(jobs.progress(events(spark, sf_dir), "user_id", "event_type", KINDS), "complete")


def shuffled_arrival(spark, sf_dir):
    """A folder that event files reach out of order: two lots by day, every third event two days late.

    A last row far in the future, of no user, closes all time slices.
    """
    e = batch_events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    first = e.agg(F.min("ts")).scalar()
    day = F.datediff("ts", first) + F.when(F.col("event_id") % 3 == 0, 2).otherwise(0)
    end = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(
        "event_id", "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    lots = [e.filter(F.floor(day / 16) == k) for k in range(2)] + [end]
    return e.schema, lots


def replayed(spark, sf_dir, job):
    """Rows that a stream in append mode puts out over the lots of :func:`shuffled_arrival`, one run a lot."""
    spark = stream_session(spark, rocksdb=True)
    schema, lots = shuffled_arrival(spark, sf_dir)
    root = scale.new_path(spark, "stream")
    for lot in lots:
        lot.write.mode("append").parquet(f"{root}/in")
        out = job(spark.readStream.schema(schema).parquet(f"{root}/in"))
        out.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query(
    "t02_stage_change_stream",
    """with l as (select cast(user_id as varchar) as task, event_id, event_type as stage, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) select * from l where previous is null or previous <> stage""",
)
def stage_change_stream(spark, sf_dir):
    """Events arrive out of order over several runs; the changes are those of event order."""
    out = replayed(spark, sf_dir, lambda e: jobs.stage_changes(
        e.withColumnRenamed("user_id", "task").withColumnRenamed("event_type", "stage"), late="4 days"))
    return out.filter("task <> '-1'").select("task", "event_id", "stage", "previous")


@query(
    "t03_terminal_replay",
    f"""with e as (select user_id as task, event_id, ts, {_STAGE} as stage from events), d as (select task, max(event_id) as id, arg_max(stage, event_id) as terminal from e where stage in ('completed', 'failed') group by 1),
 s as (select task, max(event_id) as id from e where stage = 'started' group by 1) select d.task, d.terminal, d.id as event_id from d left join s on d.task = s.task where s.id is null or s.id < d.id""",
)
def terminal_replay(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("task"), "event_id", "ts", F.expr(_STAGE).alias("stage"))
    return drained(jobs.terminal(e), "complete")


@query(
    "t04_ttl_state",
    """with recursive e as (select user_id || '-' || event_type as key, event_id, ts from events),
 r as (select key, min(ts) as ts from e group by 1 union all
  select r.key, min(e.ts) over (partition by r.key) from r join e on e.key = r.key and e.ts >= r.ts + interval 36 hour qualify row_number() over (partition by r.key) = 1)
 select e.key, min(e.event_id) as event_id from r join e on r.key = e.key and r.ts = e.ts group by e.key, e.ts""",
)
def ttl_state(spark, sf_dir):
    """Keys live 36 hours of 30 days, so most are let in many times."""
    out = replayed(spark, sf_dir, lambda e: jobs.ttl_ids(
        e.withColumn("key", F.concat_ws("-", "user_id", "event_type")), "key", 36 * 3_600_000, late="4 days"))
    return out.filter("event_id >= 0").select("key", "event_id")


@query(
    "t05_stale_work",
    f"""with e as (select user_id as item, event_id, ts, {_WORK} as stage from events), p as (select item, arg_max(stage, event_id) as last, max(ts) as t, count(*) filter (where stage = 'processing') as attempts from e group by 1)
 select item, attempts, case when attempts >= 30 then 'failed' else 'stale' end as status from p where last = 'processing' and epoch_ms((select max(ts) from e)) - epoch_ms(t) > 3600000""",
)
def stale_work(spark, sf_dir):
    e = batch_events(spark, sf_dir).select(F.col("user_id").alias("item"), "event_id", "ts", F.expr(_WORK).alias("stage"))
    return jobs.stale_batch(e, "item", 3_600_000, 30)


@query(
    "t05_stale_stream",
    f"""with e as (select cast(user_id as varchar) as item, event_id, ts, {_WORK} as stage from events), p as (select item, arg_max(stage, event_id) as last, max(ts) as t, count(*) filter (where stage = 'processing') as attempts from e group by 1)
 select item, attempts, case when attempts >= 30 then 'failed' else 'stale' end as status from p where last = 'processing' and epoch_ms((select max(ts) from e)) - epoch_ms(t) > 3600000""",
)
def stale_stream(spark, sf_dir):
    e = events(spark, sf_dir, rocksdb=True).select(F.col("user_id").alias("item"), "event_id", "ts", F.expr(_WORK).alias("stage"))
    return drained(jobs.stale_stream(e, "item", 3_600_000, 30), "append").select("item", "attempts", "status")


def _arrivals(parts=3):
    """Records of one arrival after another: those of equal remainder come together."""
    return [f"record_id % {parts} = {k}" for k in range(parts)]


def _arrived(k):
    return f"in{k} as (select * from rec where {_arrivals()[k]})"


@query(
    "t06_incremental_ingest",
    f"""with recursive {A.DUCK_REC}, none as (select '' as article_id, * exclude (record_id) from rec where false), {_arrived(0)}, {_arrived(1)}, {_arrived(2)},
 {duck_upsert("none", "in0", "0")}, {duck_upsert("after0", "in1", "1")}, {duck_upsert("after1", "in2", "2")}
 select article_id, title, {", ".join(UP)}, publication_year, is_retracted, array_to_string(publication_types, '|') as publication_types from after2""",
)
def incremental_ingest(spark, sf_dir):
    """Records arrive in three lots; each run of the stream merges one into the store."""
    rec = A.records(spark, sf_dir)
    root = scale.new_path(spark, "ingest")
    schema = rec.withColumn("article_id", F.lit("")).drop("record_id").schema
    for lot in _arrivals():
        rec.filter(lot).write.mode("append").parquet(f"{root}/arriving")
        arriving = spark.readStream.schema(rec.schema).parquet(f"{root}/arriving")
        jobs.ingest(arriving, f"{root}/store", schema).awaitTermination()
    out = logstore.ArticleStore(f"{root}/store", schema).articles(spark)
    return out.select(
        "article_id", "title", *UP, "publication_year", "is_retracted", F.array_join("publication_types", "|").alias("publication_types"))


@query("t06_incremental_clusters", f"with recursive {A.DUCK_CLUSTERS} select record_id, cluster from clusters")
def incremental_clusters(spark, sf_dir):
    """Clusters kept up over three lots of records equal those of one batch."""
    keys = resolve.identity_keys(A.records(spark, sf_dir))
    root = scale.new_path(spark, "clusters")
    for lot in _arrivals():
        keys.filter(lot).write.mode("append").parquet(f"{root}/arriving")
        arriving = spark.readStream.schema(keys.schema).parquet(f"{root}/arriving")
        jobs.ingest_clusters(arriving, f"{root}/forest", keys.schema["record_id"].dataType).awaitTermination()
    return logstore.ClusterForest(f"{root}/forest", keys.schema["record_id"].dataType).clusters(spark)


@query(
    "t07_windowed_latency",
    """select date_trunc('hour', ts) as window_start, event_type as stage, count(*) as n, round(sum(value), 4) as total_ms, max(value) as max_ms from events group by 1, 2""".replace(
        "select date_trunc('hour', ts) as", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as"),
)
def windowed_latency(spark, sf_dir):
    e = events(spark, sf_dir).select("ts", F.col("event_type").alias("stage"), "value")
    out = drained(jobs.windowed_latency(e, "stage", "value", "1 hour", "1 day"), "complete")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "n",
        F.round("total_ms", 4).alias("total_ms"), "max_ms")


