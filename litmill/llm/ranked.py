"""Ranked lexical search over a length-stratified index: one impact for each term frequency of a stratum."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.llm.common import Batches, list_array, running_total, stage, table
from litmill.llm.registry import query
from litmill.llm.terms import byte_classes, byte_texts, text_array

TOP = 10
PART_ITEMS, PART_BYTES = 256, 1 << 20  # items searched in one pass over the index
VOCABULARY = 200_000  # terms of all items that are sent to every task; more are joined
BLOCK_DOCS, BLOCK_HITS = 4096, 1 << 17  # documents and hits under one bound: a stratum or a part of one
SLICE_WORDS = 500_000  # words looked up together
SENT_HITS = 1 << 20
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id, which sorts first
EXACT = float(1 << 53)  # sums of whole numbers in doubles are exact below

_LETTERS = byte_classes(digits=True)
HITS = "doc_id long, n long, ids array<int>, tfs array<int>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _slices(batches: Batches) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """Ids and words of some documents at a time; a very long one comes alone."""
    for batch in batches:
        first, held, size = 0, [], 0
        for k, text in enumerate(byte_texts(batch.column("text"))):
            own = words(text)
            if held and size + len(own) > SLICE_WORDS:
                yield batch.column("doc_id").slice(first, len(held)), held
                first, held, size = k, [], 0
            held.append(own)
            size += len(own)
        if held:
            yield batch.column("doc_id").slice(first, len(held)), held


def _counted(ids: list[int], sizes: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, tf) of every id found, by document and id."""
    flat = np.array(ids, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    known = flat >= 0
    key, tf = np.unique(doc[known] * v + flat[known], return_counts=True)
    return key // v, key % v, tf


def _looked_up(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """Hits of each document, and one row a task with doc_id null and ``docs`` set that sums it up: n, ids and df."""
    sent, v = docs.sparkSession.sparkContext.broadcast(ids), max(1, max(ids.values(), default=0) + 1)

    def run(batches: Batches) -> Batches:
        get = sent.value.get
        df, docs_with, length = np.zeros(v, np.int64), 0, 0
        for doc_id, held in _slices(batches):
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            doc, term, tf = _counted([i for own in held for i in map(get, own, repeat(-1))], sizes, v)
            df += np.bincount(term, minlength=v)
            docs_with += int((sizes > 0).sum())
            length += int(sizes.sum())
            hits = np.bincount(doc, minlength=len(held))
            some = np.flatnonzero(hits)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id.take(pa.array(some)), pa.array(sizes[some]), list_array(hits[some], term, pa.int32()),
                        list_array(hits[some], tf, pa.int32()), pa.nulls(len(some), pa.int64()),
                    ],
                    names=["doc_id", "n", "ids", "tfs", "docs"],
                )
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int64()), pa.array([length]), list_array([len(held)], held, pa.int32()),
                list_array([len(held)], df[held], pa.int32()), pa.array([docs_with]),
            ],
            names=["doc_id", "n", "ids", "tfs", "docs"],
        )

    return docs.mapInArrow(run, HITS + ", docs long")


def _joined(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same rows as :func:`_looked_up` for a vocabulary too large to send: terms meet their ids in a join."""

    def run(batches: Batches) -> Batches:
        row = TaskContext.get().partitionId() << 40
        for doc_id, held in _slices(batches):
            for at, own in enumerate(held):
                kinds, tf = np.unique(np.array(own, object), return_counts=True) if own else ([], np.zeros(0, np.int64))
                n = max(1, len(kinds))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row)), doc_id.take(pa.array([at] * n)), pa.array(np.full(n, len(own))),
                        text_array(list(kinds) or [b""]), pa.array(tf if len(kinds) else np.zeros(1, np.int64), pa.int32()),
                    ],
                    names=["row", "doc_id", "n", "term", "tf"],
                )
                row += 1

    found = stage(docs.mapInArrow(run, "row long, doc_id long, n long, term string, tf int"), "document-terms")
    met = found.join(vocabulary, "term")
    hits = met.groupBy("row", "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "tf"))).alias("h"))
    hits = hits.select("doc_id", "n", F.col("h.id").alias("ids"), F.col("h.tf").alias("tfs"), F.lit(None).cast("long").alias("docs"))
    df = met.groupBy("id").agg(F.count("*").cast("int").alias("df")).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.array(F.col("id").cast("int")).alias("ids"),
        F.array("df").alias("tfs"), F.lit(0).cast("long").alias("docs"),
    )
    rows = found.filter("n > 0").groupBy("row").agg(F.max("n").alias("n"))
    sums = rows.agg(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.expr("array() ids").cast("array<int>").alias("ids"),
                    F.expr("array() tfs").cast("array<int>").alias("tfs"), F.count("*").alias("docs"))
    return hits.unionByName(df).unionByName(sums)


def _blocks(batches: Batches, most_docs: int, most_hits: int) -> Batches:
    """Inverted blocks of rows that come in order of m and doc_id: of one m each, terms ascending, tf descending."""
    names = ("m", "docs", "terms", "term_ends", "tfs", "tf_ends", "at")
    out: list[list] = [[] for _ in names]

    def sent() -> pa.RecordBatch:
        m, *lists = out
        kinds = (pa.int64(), *[pa.int32()] * 5)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(m, pa.int64()), *(list_array([len(a) for a in c], np.concatenate(c), k) for c, k in zip(lists, kinds))], names=list(names)
        )
        for c in out:
            c.clear()
        return batch

    held, m_held, n_held, n_out = [], None, 0, 0

    def close() -> None:
        docs = np.concatenate([d for d, _, _, _ in held])
        sizes, ids, tfs = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        at = np.repeat(np.arange(len(docs)), sizes)
        order = np.lexsort((at, -tfs, ids))
        ids, tfs, at = ids[order], tfs[order], at[order]
        last_tf = np.flatnonzero(np.r_[(ids[1:] != ids[:-1]) | (tfs[1:] != tfs[:-1]), True])
        of_term = ids[last_tf]
        last_term = np.flatnonzero(np.r_[of_term[1:] != of_term[:-1], True])
        for c, a in zip(out, (m_held, docs, of_term[last_term], last_term + 1, tfs[last_tf], last_tf + 1, at)):
            c.append(a)
        held.clear()

    for batch in batches:
        m = batch.column("m").to_numpy()
        docs = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy()
        ids, tfs = lists.values.to_numpy(), batch.column("tfs").values.to_numpy()
        sizes = np.diff(ends)
        # A block ends where m changes, after so many documents, or before so many hits.
        cuts, count, hits = [], len(held) and sum(len(h[0]) for h in held), n_held
        for k in range(len(m)):
            if count and (m[k] != (m[k - 1] if k else m_held) or count >= most_docs or hits + sizes[k] > most_hits):
                cuts.append(k)
                count, hits = 0, 0
            count, hits = count + 1, hits + int(sizes[k])
        first = 0
        for cut in [*cuts, len(m)]:
            if cut > first:
                held.append((docs[first:cut], sizes[first:cut], ids[ends[first] : ends[cut]], tfs[ends[first] : ends[cut]]))
                m_held, n_held = int(m[cut - 1]), n_held + int(ends[cut] - ends[first])
            if cut < len(m) or (cuts and cuts[-1] == cut):
                n_out += n_held
                close()
                n_held = 0
                if n_out > SENT_HITS:
                    yield sent()
                    n_out = 0
            first = cut
    if held:
        close()
    if out[0]:
        yield sent()


class Index:
    """A document index for a set of terms: blocks of documents of equal m, and what the weights need."""

    def __init__(
        self, docs: DataFrame, vocabulary: DataFrame, most_sent: int = VOCABULARY,
        block_docs: int = BLOCK_DOCS, block_hits: int = BLOCK_HITS,
    ) -> None:
        """``vocabulary`` holds (term, id); it is sent to the tasks if it has at most ``most_sent`` terms, else joined."""
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if vocabulary.count() <= most_sent:
            hits = _looked_up(own, {t.encode(): i for t, i in vocabulary.select("term", "id").collect()})
        else:
            hits = _joined(own, vocabulary)
        hits = stage(hits, "term-hits")
        sums = hits.filter("docs is not null")
        self.n, self.length = (int(x or 0) for x in sums.agg(F.sum("docs"), F.sum("n")).first())
        self.df = sums.select(F.explode(F.arrays_zip("ids", "tfs")).alias("h")).groupBy(F.col("h.ids").alias("id")).agg(
            F.sum("h.tfs").alias("df")
        )
        m = F.expr(f"25 + cast((cast(75 * n as decimal(25,0)) * {self.n}) div {max(1, self.length)} as bigint)")
        placed = hits.filter("docs is null").drop("docs").withColumn("m", m).repartitionByRange("m", F.col("doc_id").asc_nulls_first())
        self.blocks = stage(
            placed.sortWithinPartitions("m", F.col("doc_id").asc_nulls_first()).select("m", "doc_id", "ids", "tfs").mapInArrow(
                lambda batches: _blocks(batches, block_docs, block_hits),
                "m long, docs array<long>, terms array<int>, term_ends array<int>, tfs array<int>, tf_ends array<int>, at array<int>",
            ),
            "length-strata",
        )


class Best:
    """The best documents of every item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(items)  # score that a further document needs: any above 0, or the last of a full list

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        kept = rank < self.top
        self.item, self.score, self.doc, rank = item[kept], score[kept], doc[kept], rank[kept]
        last = rank == self.top - 1
        self.least[self.item[last]] = np.maximum(1, self.score[last])


def search_blocks(batch: pa.RecordBatch, weights: np.ndarray, known: np.ndarray, best: Best) -> None:
    """Score the documents of the blocks of a batch against all items, blocks with the highest bounds first.

    ``weights`` has a row for each term of ``known`` and a column for each
    item.  An item visits a block only if the block's bound reaches its list.
    """

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(name)
        return column.values.to_numpy(), column.offsets.to_numpy()

    m = batch.column("m").to_numpy()
    parts = {name: lists(name) for name in ("docs", "terms", "term_ends", "tfs", "tf_ends", "at")}

    def part(name: str, k: int) -> np.ndarray:
        values, ends = parts[name]
        return values[ends[k] : ends[k + 1]].astype(np.int64)

    def impact(tf: np.ndarray, k: int) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * int(m[k]))

    def asked(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which terms of a block the items have, and their rows of the weights."""
        terms = part("terms", k)
        row = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        own = np.flatnonzero(known[row] == terms)
        return own, row[own]

    bounds = np.zeros((batch.num_rows, weights.shape[1]), weights.dtype)
    for k in range(batch.num_rows):
        own, row = asked(k)
        first = np.r_[0, part("term_ends", k)[:-1]][own]  # the largest tf of a term comes first
        bounds[k] = impact(part("tfs", k)[first], k).astype(weights.dtype) @ weights[row]
    for k in np.argsort(-bounds.max(1, initial=0), kind="stable"):
        visits = np.flatnonzero(bounds[k] >= best.least)
        if not len(visits):
            continue
        own, row = asked(k)
        docs, tfs, at = part("docs", k), part("tfs", k), part("at", k)
        kinds, kind = np.unique(tfs, return_inverse=True)
        by_tf = impact(kinds, k)[kind]
        postings = np.diff(np.r_[0, part("term_ends", k)])
        term_of_tf = np.repeat(np.arange(len(postings)), postings)
        hits = np.diff(np.r_[0, part("tf_ends", k)])
        dense = np.zeros((int(term_of_tf[-1]) + 1, len(docs)), weights.dtype)
        dense[np.repeat(term_of_tf, hits), at] = np.repeat(by_tf, hits)
        scores = dense[own].T @ weights[np.ix_(row, visits)]
        least = best.least[visits]
        if len(docs) > best.top:
            least = np.maximum(least, np.partition(scores, len(docs) - best.top, axis=0)[len(docs) - best.top])
        doc, item = np.nonzero(scores >= least)
        best.add(visits[item], scores[doc, item].astype(np.int64), docs[doc])


def search(
    items: DataFrame, docs: DataFrame, top: int = TOP, part_items: int = PART_ITEMS, **how: int
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score, equal scores by doc_id.

    Every document is scored over its whole text; fewer rows come only where
    fewer documents hold a term.  Null and empty texts match nothing, on either
    side; each distinct (item_id, text) is an item of its own, so a repeated
    item counts once; a repeated document may rank as often as it comes; a null
    doc_id sorts first.  Other columns are not read.  Empty tables give an
    empty result.  Items are searched in parts of at most ``part_items``, each
    part against the whole index, which ``how`` goes to.
    """
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    own = running_total(own, ["item_id", "text"], F.lit(1), "k", "items")
    own = running_total(own, ["k"], F.octet_length("text"), "bytes", "item-bytes")
    own = own.withColumn("part", F.concat_ws("-", F.expr(f"k div {part_items}"), F.expr(f"bytes div {PART_BYTES}")))

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            held = [words(t) for t in byte_texts(batch.column("text"))]
            which = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(which) for c in ("item_id", "k", "part")), text_array([w for h in held for w in h])],
                names=["item_id", "k", "part", "term"],
            )

    asked = stage(
        own.select("item_id", "k", "part", "text").mapInArrow(cut, "item_id long, k long, part string, term string")
        .groupBy("item_id", "k", "part", "term").agg(F.count("*").alias("q")),
        "item-terms",
    )
    vocabulary = stage(running_total(asked.select("term").distinct(), ["term"], F.lit(1), "id", "vocabulary"), "vocabulary")
    index = Index(docs, vocabulary, **how)
    weighed = stage(asked.join(vocabulary, "term").join(index.df, "id").select("item_id", "k", "part", "id", "q", "df"), "weighed-terms")
    passes = []
    for (name,) in sorted(weighed.select("part").distinct().collect()):
        rows = weighed.filter(F.col("part") == name).select("item_id", "k", "id", "q", "df").collect()
        numbers = sorted({(r["k"], r["item_id"]) for r in rows})
        column = {k: c for c, (k, _) in enumerate(numbers)}
        known = np.unique([r["id"] for r in rows])
        weights = np.zeros((len(known), len(numbers)))
        for r in rows:
            w = math.floor(1000 * math.log((2 * index.n + 2) / (2 * r["df"] + 1)))
            weights[np.searchsorted(known, r["id"]), column[r["k"]]] = w * r["q"]
        if weights.sum(0).max() * 1e6 >= EXACT:
            weights = weights.astype(np.int64)
        sent = spark.sparkContext.broadcast((weights, known, numbers))

        def run(batches: Batches, sent=sent) -> Batches:
            weights, known, numbers = sent.value
            best = Best(len(numbers), top)
            for batch in batches:
                if batch.num_rows:
                    search_blocks(batch, weights, known, best)
            if len(best.item):
                doc = pa.array(best.doc, mask=best.doc == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([numbers[c][x] for c in best.item], pa.int64()) for x in (1, 0)] + [doc, pa.array(best.score)],
                    names=["item_id", "k", "doc_id", "score"],
                )

        passes.append(index.blocks.mapInArrow(run, "item_id long, k long, doc_id long, score long"))
    if not passes:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = reduce(DataFrame.unionByName, passes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


SQL = r"""
with d as (
  select row_number() over () as row, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) as words
  from documents),
n as (select row, doc_id, len(words) as n from d where len(words) > 0),
total as (select count(*) as docs, sum(n)::bigint as length from n),
hit as (select row, term, count(*) as tf from (select row, unnest(words) as term from d) group by all),
df as (select term, count(*) as df from hit group by term),
q as (
  select item_id, term, count(*) as q from (
    select item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark) group by all),
w as (
  select q.item_id, q.term, q.q * cast(floor(1000 * ln((2 * t.docs + 2)::double / (2 * df.df + 1))) as bigint) as w
  from q join df on q.term = df.term, total t),
score as (
  select w.item_id, n.doc_id, h.row,
    cast(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (25 + (75 * n.n * t.docs) // t.length)))) as bigint) as score
  from w join hit h on w.term = h.term join n on n.row = h.row, total t
  group by all)
select item_id, cast(rank as int) as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score where score > 0)
where rank <= 10
"""


@query("op12_ranked_search", SQL)
def ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
