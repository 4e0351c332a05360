"""Minimax contiguous partition: the least shard capacity that holds the ordered groups in a given number of shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import running_total, stage, table
from litmill.llm.registry import query

PROBES = 512  # capacities tried in one pass of the search


def _fill(ends: DataFrame, capacities: list[int], n_shards: int) -> list[list[int]]:
    """Greedy filling for several capacities at once: end of each shard, as a total of sizes from the start.

    One pass a shard over the sorted ends; the bounds reach the scan, and only
    one number a capacity comes to the driver.
    """
    at = [0] * len(capacities)
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(n_shards):
        # Larger capacities never reach less far, so each end falls between two neighbouring reaches.
        reach = [a + c for a, c in zip(at, capacities)]
        near = ends.filter((F.col("end") > min(at)) & (F.col("end") <= reach[-1]))
        steps = F.expr(f"array({', '.join(f'{r}L' for r in reach)})")
        below = F.size(F.filter(steps, lambda r: r < F.col("end")))
        found = dict(near.groupBy(below.alias("slot")).agg(F.max("end")).collect())
        best = 0
        for i, a in enumerate(at):
            best = max(best, found.get(i, 0))
            at[i] = max(a, best)
            cuts[i].append(at[i])
    return cuts


def least_capacity(ends: DataFrame, total: int, largest: int, n_shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity and the cuts that greedy filling makes with it.

    ``ends`` holds the running total at the end of each group.  The capacity
    lies between the larger of mean shard and largest group, and that plus the
    largest group; each round tries PROBES capacities and keeps the gap between
    the last that fails and the first that holds.
    """
    low = max(-(-total // n_shards), largest)
    high = low + largest
    while True:
        step = max(1, -(-(high - low) // (PROBES - 1)))
        tried = list(range(low, high, step)) + [high]
        cuts = _fill(ends, tried, n_shards)
        fits = next(i for i, c in enumerate(cuts) if c[-1] >= total)
        if step == 1 or fits == 0:
            return tried[fits], cuts[fits]
        low, high = tried[fits - 1] + 1, tried[fits]


def shards(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): contiguous shards of nearly equal bytes.

    Documents of equal text form one group, which no cut divides; a null text
    counts as empty.  Groups are ordered by their least doc_id (nulls first).
    Every input row gets one slot; repeated rows get slots of their own.  Slots
    of a shard follow the groups' order, then doc_id, from 0 without gaps.  An
    empty table gives an empty result.  Only ids, sizes and digests are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    thin = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(body.cast("binary"))).alias("_key"),
        ),
        "shard-rows",
    )
    groups = thin.groupBy("_key").agg(
        F.min("doc_id").alias("_first"), F.sum("size").alias("_bytes"), F.count("*").alias("_rows")
    )
    ends = stage(
        running_total(groups, ["_first", "_key"], F.col("_bytes"), "_before", "shard-groups")
        .withColumn("end", F.col("_before") + F.col("_bytes")),
        "shard-ends",
    )
    whole = ends.agg(F.sum("_bytes").alias("total"), F.max("_bytes").alias("largest")).first()
    cuts: list[int] = []
    if whole["total"] is not None:
        _, cuts = least_capacity(ends.select("end"), int(whole["total"]), int(whole["largest"]), n_shards)
    place = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")
    placed = ends.select("_key", "_first", "_rows", place.alias("shard"))
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("_rows").alias("n")).collect()}
    starts, seen = [], 0
    for s in range(n_shards):
        starts.append(seen)
        seen += counts.get(s, 0)
    rows = thin.join(placed.drop("_rows"), "_key")
    ranked = running_total(rows, ["_first", "_key", "doc_id"], F.lit(1), "_rank", "shard-slots")
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard"))
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - start).alias("slot"))


@query("op8_minimax_shards")
def minimax_shards(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
