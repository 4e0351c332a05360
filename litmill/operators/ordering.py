"""Order within groups: numbering, first and latest rows, batches, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litmill import scale
from litmill.functions import text


def source_rank(df: DataFrame, run: str, pos: str) -> DataFrame:
    """Provider order within each run, from 1; null positions come first."""
    return scale.running_sum(df, [run], [F.asc_nulls_first(pos)], name="source_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], pos: str) -> tuple[DataFrame, DataFrame]:
    """First row per key by position, and how many rows each key lost.

    ``pos`` must be unique.  Only the least position per key is shuffled; the
    wide rows are then kept by a semi join on the unique position.
    """
    firsts = df.groupBy(*keys).agg(F.min(pos).alias(pos), (F.count("*") - 1).alias("dropped"))
    return df.join(firsts.select(pos), pos, "left_semi"), firsts.select(*keys, "dropped")


def ordered_distinct(df: DataFrame, by: Sequence[str], item: str, pos: str, key: Column) -> DataFrame:
    """First occurrence of each item per group under a folded key; ``pos`` keeps the order."""
    keyed = df.withColumn("_k", key).filter("_k is not null and _k <> ''")
    return (
        keyed.groupBy(*by, "_k")
        .agg(F.min_by(item, pos).alias(item), F.min(pos).alias(pos))
        .drop("_k")
    )


# Fixed value: tasks for each split of the input; a list takes many times its size once its items are rows.
_UNPACKED = 8


def ordered_distinct_lists(df: DataFrame, by: Sequence[str], items: Column, item: str, pos: str, key: Column) -> DataFrame:
    """``ordered_distinct`` over lists: ``items`` of a row become rows with their place from 0 as ``pos``.

    Rows meet by group before their lists are unpacked, so each list is
    shuffled once as it is stored and its items never.
    """
    met = df.repartition(_UNPACKED * df.rdd.getNumPartitions(), *by)
    return ordered_distinct(met.select(*by, F.posexplode(items).alias(pos, item)), by, item, pos, key)


def latest_by_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last row per key: later writes win."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    return last.select(*keys, "_r.*").select(*df.columns)


def union_latest(keys: Sequence[str], seq: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Union of several snapshots, last write wins; on equal ``seq`` the later part wins."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    return latest_by_key(rows, keys, [*seq, "_part"]).drop("_part")


def balanced_batches(df: DataFrame, by: str, size: int, order: Sequence[Column]) -> DataFrame:
    """Contiguous batches per group whose sizes differ by at most one, larger ones first.

    n rows make k = ceil(n/size) batches; with b = n div k and r = n mod k the
    first r batches hold b+1 rows.  The batch of a row follows from its number,
    so no group is gathered.
    """
    if size < 1:
        raise ValueError("size must be positive")
    numbered = scale.running_sum(df, [by], order, name="_p")
    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    rows = scale.join_all(numbered, counts, [by], "inner")
    n, p = F.col("_n"), F.col("_p") - 1
    rows = rows.withColumn("_k", F.ceil(n / size)).withColumn("_b", F.floor(n / F.col("_k")))
    rows = rows.withColumn("_r", n % F.col("_k"))
    b, r = F.col("_b"), F.col("_r")
    batch = F.when(p < r * (b + 1), F.floor(p / (b + 1))).otherwise(
        r + F.floor((p - r * (b + 1)) / b)
    )
    return rows.withColumn("batch_index", batch.cast("int")).withColumn(
        "batch_id", F.format_string("%s:batch-%03d", F.col(by), F.col("batch_index") + 1)
    ).drop("_p", "_n", "_k", "_b", "_r")


def round_robin(df: DataFrame, by: str, order: Sequence[Column], group_order: str) -> DataFrame:
    """Interleave groups one row at a time; ``dispatch`` is the place in the joint queue."""
    turns = scale.running_sum(df, [by], order, name="turn")
    return scale.running_sum(turns, [], [F.asc("turn"), F.asc(group_order)], name="dispatch")


def next_sequence(store: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Sequence numbers for new rows: after the greatest stored one, from 0 in an empty group."""
    last = store.groupBy(key).agg(F.max("sequence_no").alias("_last"))
    rows = scale.running_sum(new, [key], order, name="_rn")
    rows = scale.join_all(rows, last, [key])
    return rows.withColumn(
        "sequence_no", F.coalesce("_last", F.lit(-1)) + F.col("_rn")
    ).drop("_last", "_rn")


def stage_changes(df: DataFrame, key: str, ts: str, tie: str, stage: str) -> DataFrame:
    """Rows whose stage differs from the previous row of their key (order: ts, then tie).

    Keys are cut into ranges of time; the first row of a range takes the last
    stage of the range before it.
    """
    rows = scale.previous(df, key, [ts, tie], stage, "previous")
    return rows.filter(F.col("previous").isNull() | (F.col("previous") != F.col(stage)))


def tiers(df: DataFrame, by: str, score: str) -> DataFrame:
    """Tier of each row: rows with equal scores share one, the best score has tier 1.

    Numbers the distinct scores of a group, not its rows, and looks them up.
    """
    levels = df.select(by, score).distinct()
    numbered = scale.running_sum(levels, [by], [F.desc_nulls_last(score)], name="tier")
    return scale.join_all(df, numbered, [by, score], "inner")


def cap_per_source(df: DataFrame, run: str, pos: str, n: int | None = None) -> DataFrame:
    """At most ``n`` rows per run, in provider order; all of them unless a cut is asked for."""
    ranked = source_rank(df, run, pos)
    return ranked if n is None else ranked.filter(F.col("source_rank") <= n)


def latest(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Newest rows first, ``n`` of them."""
    return df.orderBy(*order).limit(n)


def distinct_terms(values: Column) -> Column:
    """Array without blank and repeated terms (match-text rule), order kept."""
    return text.first_of_each(values, text.strip, text.match_text)
