"""Preference formatting: the longest common turn prefix becomes the prompt, the rest two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import table
from litmill.llm.registry import query

LEARNED_ROLE = "assistant"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _tail() -> Column:
    return F.lit("<|end|>\n")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], _tail())), "")


def learned_spans(turns: Column) -> Column:
    """[start, end) of what is learned in the rendered turns, in characters: assistant texts with their end mark."""
    state = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    )

    def step(a, t):
        start = a["at"] + F.length(_head(t["role"]))
        end = start + F.length(t["text"]) + F.length(_tail())
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == LEARNED_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, state, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs of turn arrays (struct<role,text>) turned into prompt, completions and learned spans.

    The prompt is the longest run of leading turns equal in role and text,
    rendered once; nothing of it is learned.  What follows on either side is
    that side's completion, of which only assistant turns are learned.  If one
    side is a prefix of the other, or both are equal, the shorter side's
    completion is empty.  Null arrays count as empty.  All other columns stay,
    but for those with the name of a result (n_common, prompt and both
    ..._learned), which give way.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    df = pairs.withColumns({c: F.coalesce(F.col(c), none) for c in (chosen, rejected)})
    same = F.zip_with(
        chosen, rejected,
        lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)),
    )
    first_gap = F.array_position(same, F.lit(False))
    df = df.withColumn("n_common", F.when(first_gap > 0, first_gap - 1).otherwise(F.size(same).cast("long")))
    n = F.col("n_common").cast("int")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c), F.lit(1)))
    df = df.withColumn("prompt", render(F.slice(chosen, F.lit(1), n)))
    df = df.withColumns({chosen: rest(chosen), rejected: rest(rejected)})
    return df.withColumns(
        {
            f"{chosen}_learned": learned_spans(F.col(chosen)),
            f"{rejected}_learned": learned_spans(F.col(rejected)),
            chosen: render(F.col(chosen)),
            rejected: render(F.col(rejected)),
        }
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) from long turns: conversations 2k and 2k+1 are one pair, the even one chosen.

    One shuffle, on the pair.  Turns are ordered by turn number (nulls first),
    then role and text; repeated rows stay.  Null roles and texts count as
    empty.  Rows without a conv_id belong to no conversation and are left out.
    A conversation without partner is paired with no turns at all.
    """
    empty = F.lit("")
    long = turns.filter("conv_id is not null").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.struct(
            F.pmod("conv_id", F.lit(2)).alias("side"), "turn",
            F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
        ).alias("t"),
    )
    both = long.groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    side = lambda k: F.transform(
        F.filter("ts", lambda t: t["side"] == k), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    return both.select("pair_id", side(0).alias("chosen"), side(1).alias("rejected"))


ORACLE = """
with t as (select conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
  from conversations where conv_id is not null),
 sizes as (select pair_id, count(*) filter (where side = 0) as nc, count(*) filter (where side = 1) as nr from t group by 1),
 gap as (select a.pair_id, min(a.p) - 1 as g from t a left join t b
  on a.pair_id = b.pair_id and b.side = 1 - a.side and a.p = b.p where b.p is null or a.role <> b.role or a.text <> b.text group by 1),
 k as (select s.pair_id, cast(coalesce(gap.g, s.nc) as bigint) as n_common from sizes s left join gap on s.pair_id = gap.pair_id),
 r as (select t.*, k.n_common, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body from t join k on t.pair_id = k.pair_id),
 o as (select *, sum(length(head) + length(body)) over (partition by pair_id, side order by p) as e from r where p > n_common)
select k.pair_id, k.n_common,
 coalesce((select string_agg(head || body, '' order by p) from r where r.pair_id = k.pair_id and side = 0 and p <= r.n_common), '') as prompt,
 coalesce((select string_agg(head || body, '' order by p) from r where r.pair_id = k.pair_id and side = 0 and p > r.n_common), '') as chosen,
 coalesce((select string_agg(head || body, '' order by p) from r where r.pair_id = k.pair_id and side = 1 and p > r.n_common), '') as rejected,
 coalesce((select string_agg(cast(e - length(body) as bigint) || ':' || cast(e as bigint), ',' order by p) from o where o.pair_id = k.pair_id and side = 0 and role = 'assistant'), '') as chosen_learned,
 coalesce((select string_agg(cast(e - length(body) as bigint) || ':' || cast(e as bigint), ',' order by p) from o where o.pair_id = k.pair_id and side = 1 and role = 'assistant'), '') as rejected_learned
from k
"""


@query("op1_preference_pairs", ORACLE)
def preference_pairs(spark, sf_dir):
    out = format_pairs(neighbour_pairs(table(spark, sf_dir, "conversations")))
    flat = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return out.select(
        "pair_id", "n_common", "prompt", "chosen", "rejected",
        flat("chosen_learned").alias("chosen_learned"), flat("rejected_learned").alias("rejected_learned"),
    )
