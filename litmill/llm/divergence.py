"""Source divergence audit: word shares of the sources of a language, compared over hash-consed segment trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.llm.common import Batches, running_total, stage, table
from litmill.llm.registry import query
from litmill.llm.terms import byte_classes, byte_texts, text_array

LEAST_DOCS = 30  # documents of a language that hold a kept term
ADDED = 5  # added to every count
SCALE = 1_000_000_000
TOP = 50  # terms reported of a group
LEAVES = 4096  # term ids under one tree
SIDE = 64  # groups on one side of a comparison task
HELD = 400_000  # entries that a counting task holds before it passes them on
SENT = 1 << 16  # entries sent at once

_LETTERS = byte_classes(digits=False)
_GROUP, _TERM, _COUNT, _LANG = 0, 1, 2, 3  # kinds of rows that a comparison task gets


def count_terms(docs: DataFrame, most_held: int = HELD) -> DataFrame:
    """(lang, source, term, count, docs), summed within tasks only; the term '' marks that the group occurs."""

    def run(batches: Batches) -> Batches:
        totals: dict[tuple[str, str], Counter] = {}
        holders: dict[tuple[str, str], Counter] = {}

        def passed_on() -> Batches:
            for (lang, source), total in totals.items():
                own = holders[lang, source]
                words = list(total)
                for at in range(0, len(words), SENT):
                    part = words[at : at + SENT]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(lang, len(part)), pa.repeat(source, len(part)), text_array(part),
                            pa.array([total[w] for w in part], pa.int64()), pa.array([own[w] for w in part], pa.int64()),
                        ],
                        names=["lang", "source", "term", "count", "docs"],
                    )

        held = 0
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for key, text in zip(keys, byte_texts(batch.column("text"))):
                if key not in totals:
                    totals[key], holders[key] = Counter({b"": 0}), Counter()
                total, before = totals[key], len(totals[key])
                words = text.translate(_LETTERS).split()
                total.update(words)
                holders[key].update(set(words))
                held += len(total) - before
                if held > most_held:
                    yield from passed_on()
                    totals, holders, held = {}, {}, 0
        yield from passed_on()

    return docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of each count; -1 stands for no term and has the share 0.  Exact in whole numbers of any size."""
    return np.array([0 if c < 0 else 1 + SCALE * (int(c) + ADDED) // (n + ADDED * v) for c in counts], np.int64)


class CountTrees:
    """Segment trees over the same leaves, one for each row of counts, that share equal subtrees.

    Nodes of a level are numbered by what is below them: two nodes with equal
    counts below are one, within a tree, at other places of it, and over all trees.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.values, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.below: list[tuple[np.ndarray, np.ndarray]] = []  # left and right node of each node, leaves' parents first
        self.counted = [self.values > 0]  # by level: whether a node has any count below it
        while ids.shape[1] > 1:
            nodes, named = np.unique(ids[:, ::2] * (ids.max() + 1) + ids[:, 1::2], return_inverse=True)
            left, right = nodes // (ids.max() + 1), nodes % (ids.max() + 1)
            self.below.append((left, right))
            self.counted.append(self.counted[-1][left] | self.counted[-1][right])
            ids = named.reshape(ids.shape[0], -1)
        self.roots = ids[:, 0]

    def leaf_pairs(self, g: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of leaf nodes that two trees have at equal places, each once, and at how many places.

        Both trees are walked down together; a pair of nodes met again is not walked again, its number of places grows.
        """
        a, b, places = self.roots[g : g + 1], self.roots[h : h + 1], np.ones(1, np.int64)
        for left, right in reversed(self.below):
            width = max(int(left.max()), int(right.max())) + 1
            pairs, named = np.unique(
                np.concatenate([left[a] * width + left[b], right[a] * width + right[b]]), return_inverse=True
            )
            places = np.bincount(named, np.concatenate([places, places]), len(pairs)).astype(np.int64)
            a, b = pairs // width, pairs % width
        return a, b, places

    def counted_leaves(self, g: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, leaf node of g, leaf node of h) where g has a count; subtrees without one are not entered."""
        at, a, b = np.zeros(1, np.int64), self.roots[g : g + 1], self.roots[h : h + 1]
        for level in range(len(self.below) - 1, -1, -1):
            left, right = self.below[level]
            at, a, b = np.concatenate([2 * at, 2 * at + 1]), np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            in_use = self.counted[level][a]
            at, a, b = at[in_use], a[in_use], b[in_use]
        return at, a, b


def compare(rows: pa.Table, leaves: int = LEAVES, side: int = SIDE) -> dict[str, list]:
    """Sums over a block of terms for pairs of groups, and the block's first terms of each group."""
    kind, g, at, n = (rows.column(c).to_numpy() for c in ("kind", "g", "at", "n"))
    v = int(rows.column("v")[0].as_py())
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    of = kind == _GROUP
    groups, sizes = g[of].astype(np.int64), [int(x) for x in n[of]]
    order = np.argsort(groups)
    groups, sizes = groups[order], [sizes[k] for k in order]
    lang = len(groups)
    counts = np.full((lang + 1, leaves), -1, np.int64)
    terms = kind == _TERM
    counts[:, at[terms].astype(np.int64)] = 0
    counts[lang, at[terms].astype(np.int64)] = n[terms]
    own = kind == _COUNT
    counts[np.searchsorted(groups, g[own].astype(np.int64)), at[own].astype(np.int64)] = n[own]
    sizes.append(int(n[kind == _LANG][0]))
    trees = CountTrees(counts)
    shares = [share(trees.values, size, v) for size in sizes]
    of_side = groups // side
    out: dict[str, list] = {"g": [], "h": [], "id": [], "value": []}

    def put(*row) -> None:
        for column, value in zip(out.values(), row):
            column.append(value)

    for x in np.flatnonzero(of_side == i):
        for y in np.flatnonzero(of_side == j):
            if i < j or x < y:
                a, b, places = trees.leaf_pairs(x, y)
                put(int(groups[x]), int(groups[y]), None, int((np.abs(shares[x][a] - shares[y][b]) * places).sum()))
        if i == j:
            place, a, b = trees.counted_leaves(x, lang)
            more = shares[x][a] - shares[lang][b]
            for k in np.lexsort((place, -more))[:TOP]:
                if more[k] > 0:
                    put(int(groups[x]), None, int(place[k]), int(more[k]))
    return out


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    leaves: int = LEAVES, side: int = SIDE, most_held: int = HELD,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language differ, and by which words.

    Part ``pair``: the distance to each other source of the language, summed
    over the terms that at least 30 documents of the language hold; part
    ``term``: the 50 terms that a source has most above the language's share.
    Null lang, source and text are empty ones; texts without terms still make
    their group occur; a repeated row counts as often as it comes; equal values
    rank by item.  A language without kept terms has pairs of value 0 and no
    terms.  Other columns are not read; an empty table gives an empty result.

    Terms are numbered in order, cut into blocks of ``leaves`` ids (a power of
    2), and each block's groups compared in sides of ``side``: a task holds two
    sides of one block.  A counting task holds about ``most_held`` entries.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    by_term = W.partitionBy("lang", "term")
    kept = stage(
        count_terms(rows, most_held).repartition("lang", "term").groupBy("lang", "term", "source")
        .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        .withColumn("df", F.sum("docs").over(by_term)).filter((F.col("term") == "") | (F.col("df") >= LEAST_DOCS))
        .select("lang", "source", "term", "count"),
        "kept-terms",
    )
    counts = kept.filter("term <> ''")
    terms = stage(
        running_total(counts.groupBy("lang", "term").agg(F.sum("count").alias("n")), ["lang", "term"], F.lit(1), "id", "term-ids")
        .withColumns({"block": F.expr(f"id div {leaves}"), "at": F.pmod("id", F.lit(leaves)).cast("int")}),
        "terms",
    )
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = stage(
        running_total(kept.filter("term = ''").select("lang", "source"), ["lang", "source"], F.lit(1), "g", "group-ids")
        .join(sizes, ["lang", "source"], "left")
        .select("lang", "source", "g", F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"g div {side}").alias("side")),
        "groups",
    )
    sides = groups.select("lang", "side").distinct()
    tasks = sides.withColumnRenamed("side", "i").join(sides.withColumnRenamed("side", "j"), "lang").filter("i <= j")
    in_tasks = tasks.select("lang", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"))
    blocks = terms.select("lang", "block").distinct()

    def given(df: DataFrame, kind: int, g: Column, at: Column) -> DataFrame:
        return df.select(
            "lang", "block", "i", "j", F.lit(kind).alias("kind"), g.cast("long").alias("g"), at.cast("int").alias("at"), "n"
        )

    none = F.lit(None)
    spread_counts = (
        counts.withColumnRenamed("count", "n").join(terms.drop("n"), ["lang", "term"])
        .join(groups.drop("n"), ["lang", "source"]).join(in_tasks, ["lang", "side"])
    )
    dealt = (
        given(spread_counts, _COUNT, F.col("g"), F.col("at"))
        .unionByName(given(groups.join(in_tasks, ["lang", "side"]).join(blocks, "lang"), _GROUP, F.col("g"), none))
        .unionByName(given(terms.join(tasks, "lang"), _TERM, none, F.col("at")))
        .unionByName(given(langs.join(tasks, "lang").join(blocks, "lang"), _LANG, none, none))
        .join(langs.select("lang", "v"), "lang")
    )

    def priced(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = compare(pa.Table.from_batches(found), leaves, side)
        n = len(out["g"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int64()),
                *(pa.array(c, pa.int64()) for c in out.values()),
            ],
            names=["lang", "block", "g", "h", "at", "value"],
        )

    found = stage(
        dealt.groupBy("lang", "block", "i", "j")
        .applyInArrow(priced, "lang string, block long, g long, h long, at long, value long"),
        "block-sums",
    )
    sums = found.filter("h is not null").groupBy("g", "h").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select(F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    other = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (
        groups.select("lang", "source", "g").join(other, "lang").filter("g <> h").join(both, ["g", "h"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
    )
    first = W.partitionBy("g").orderBy(F.desc("value"), "id")
    most = (
        found.filter("h is null").select("g", (F.col("block") * leaves + F.col("at")).alias("id"), "value")
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= TOP)
        .join(terms.select("id", F.col("term").alias("item")), "id").join(groups.select("lang", "source", "g"), "g")
    )
    return pairs.unionByName(most.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


SQL = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(text, '') as text from documents),
words as (
  select row, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from d),
kept as (select lang, term, count(*) as n from words group by all having count(distinct row) >= 30),
langs as (select lang, count(*) as v, sum(n) as n from kept group by lang),
grp as (select distinct lang, source from d),
cell as (
  select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n
  from grp g join kept k on g.lang = k.lang
  left join (select lang, source, term, count(*) as n from words group by all) c
    on c.lang = g.lang and c.source = g.source and c.term = k.term),
share as (
  select c.lang, c.source, c.term, c.n,
    1 + (1000000000::hugeint * (c.n + 5)) // (sum(c.n) over (partition by c.lang, c.source) + 5 * l.v) as p,
    1 + (1000000000::hugeint * (c.lang_n + 5)) // (l.n + 5 * l.v) as q
  from cell c join langs l on c.lang = l.lang),
pair as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join share x on x.lang = a.lang and x.source = a.source
  left join share y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
top as (
  select lang, source, term as item, p - q as value,
    row_number() over (partition by lang, source order by p - q desc, term) as rank
  from share where n > 0 and p > q)
select lang, source, 'pair' as part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from pair
union all
select lang, source, 'term', item, cast(value as bigint), cast(rank as int) from top where rank <= 50
"""


@query("op11_source_divergence", SQL)
def source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
