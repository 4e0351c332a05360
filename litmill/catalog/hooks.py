"""User function hooks and exact text rules."""

import re

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.functions import exact, hooks, markup, text, values
from litmill.operators import quality, spans


@query("x01_exact_text_fold", f"select doc_id, md5({A.q_match('text')}) as folded_md5, true as same from documents")
def exact_text_fold(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    both = d.select("doc_id", exact.match_text(F.col("text")).alias("e"), text.match_text(F.col("text")).alias("b"))
    return both.select("doc_id", F.md5("e").alias("folded_md5"), (F.col("e") == F.col("b")).alias("same"))


@query("x02_embed", "select doc_id, 64 as size, true as unit from documents")
def embed(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = hooks.embed(d, "text", lambda: hooks.hashed_words, 64)
    return out.select("doc_id", F.size("embedding").alias("size"), (F.abs(values.norm(F.col("embedding")) - 1) < 1e-3).alias("unit"))


def _judge(row):
    """Stand-in assessment: counts words, fails for some ids."""
    if row["doc_id"] % 17 == 3:
        raise ValueError("no answer")
    return [{"doc_id": row["doc_id"], "criterion_id": f"c{k}", "status": "favorable" if len(row["text"]) % (k + 2) else "unclear"} for k in range(2)]


@query(
    "x03_assess",
    """select doc_id, 'c' || cast(k as varchar) as criterion_id, case when length(text) % (k + 2) > 0 then 'favorable' else 'unclear' end as status, 1 as attempts, cast(null as varchar) as error_type
 from documents, (values (0), (1)) t(k) where doc_id % 17 <> 3 union all select doc_id, null, null, 2, 'ValueError' from documents where doc_id % 17 = 3""",
)
def assess(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    return hooks.assess(d, _judge, "doc_id long, criterion_id string, status string")


@query(
    "x04_metadata_signals",
    """select doc_id, round(0.5 * 6 + 0.25 * 7 + 0.15 * 8 + 0.05 * (doc_id % 11) + 0.05 * (n_chars % 11), 6) as with_signals, round(cast(0.5 * 6 + 0.25 * 7 + 0.15 * 8 + 0.5 as double), 6) as neutral from documents""".replace(
        "round(0.5 * 6 + 0.25 * 7 + 0.15 * 8 + 0.05 * (doc_id % 11) + 0.05 * (n_chars % 11), 6)",
        "round(cast(0.5 * 6 + 0.25 * 7 + 0.15 * 8 + 0.05 * (doc_id % 11) + 0.05 * (n_chars % 11) as double), 6)"),
)
def metadata_signals(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.lit(6.0).alias("relevance_score"), F.lit(7.0).alias("quality_score"), F.lit(8.0).alias("answerability_score"))
    a = quality.composite(d, journal=F.col("doc_id") % 11, recency=F.col("n_chars") % 11).withColumnRenamed("composite_score", "with_signals")
    journal, recency = hooks.neutral_signals()
    b = quality.composite(a.drop("journal_score", "recency_score"), journal=journal, recency=recency)
    return b.select("doc_id", F.round("with_signals", 6).alias("with_signals"), F.round("composite_score", 6).alias("neutral"))


def _summaries(rows):
    return [f"summary of {r['article_id']}" for r in rows]


@query("x05_summarise", "select doc_id as article_id, 'summary of ' || cast(doc_id as varchar) as summary_text, 'completed' as summary_status from documents")
def summarise(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.lit("none").alias("fallback_text"))
    return hooks.summarise(d, _summaries).select("article_id", "summary_text", "summary_status")


_ABBREVIATIONS = "|".join(re.escape(a) for a in markup.ABBREVIATIONS)


@query(
    "x06_sentence_offsets",
    rf"""with marked as (select doc_id, regexp_replace(regexp_replace(text, '([.!?。！？])([\s\x{{a0}}])', '\1' || chr(1) || '\2', 'g'),
  '(?i)({_ABBREVIATIONS})' || chr(1), '\1', 'g') as m from documents),
 parts as (select doc_id, unnest(string_split(m, chr(1))) as p, generate_subscripts(string_split(m, chr(1)), 1) as i from marked),
 placed as (select *, coalesce(sum(length(p)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as off from parts),
 ends as (select *, off + length(p) - length(ltrim(p, ' ' || chr(10) || chr(9))) as s, off + length(rtrim(p, ' ' || chr(10) || chr(9))) as e from placed)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as sentence, cast(s as integer) as start_offset,
 cast(e as integer) as end_offset from ends where e > s""",
)
def sentence_offsets(spark, sf_dir):
    """The guarded split: abbreviations do not end a sentence."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.sentences(d, "text", guard_abbreviations=True).select("doc_id", "sentence", "start_offset", "end_offset")


@query("x08_latest_reducer", "select user_id, arg_max(event_type, event_id) as stage from events group by 1")
def latest_reducer(spark, sf_dir):
    return A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("stage"))
