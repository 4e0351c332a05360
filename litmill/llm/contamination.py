"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then overlap checks."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Batches, stage, table, texts
from litmill.llm.registry import query

UNIT = 64  # words of an item that are looked for as one unit
PASSAGE, STRIDE = 128, 64  # any UNIT words in a row lie whole within some passage
K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of the score that a unit gives itself
OVERLAP = 0.6  # of the n-grams of question and of answer
GRAM = 5
POSTINGS = 16  # postings under one bound
BLOCKS = 64  # runs of units with bounds of their own, for the first look at a passage
LOOK = 512  # passages looked at together
INDEX_BYTES = 4 << 20  # item text in one index; more items take more passes

_words = re.compile(r"\w+").findall
_sentence = re.compile(r"(?<=[.!?])\s+|\n+").split


def terms(text: str) -> list[str]:
    return _words(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: the last sentence with a word answers; a lone sentence is halved."""
    parts = [w for w in map(terms, _sentence(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def unit_bags(text: str) -> list[Counter]:
    """Words of each unit of an item, counted."""
    question, answer = question_answer(text)
    whole = question + answer
    return [Counter(whole[at : at + UNIT]) for at in range(0, len(whole), UNIT)]


def gram_set(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


@dataclass
class Counts:
    """What BM25 counts over the units of all items: how many there are, how many words they hold, units by term."""

    units: int
    words: int
    df: Mapping[str, int]

    @classmethod
    def of(cls, bags: list[Counter]) -> Counts:
        return cls(len(bags), sum(sum(b.values()) for b in bags), Counter(t for b in bags for t in b))


@dataclass
class Index:
    """Units of items with postings by term: unit numbers ascending, impacts as shares of the unit's own score.

    Bounds come in two grains: of runs of units for a first look that takes all
    passages of a text at once, and of runs of postings for the search.
    """

    ids: list[int | None] = field(default_factory=list)  # item_id of each row of items; null ids and repeated ones too
    items: list[int] = field(default_factory=list)  # row of each unit
    units: dict[str, list[int]] = field(default_factory=dict)
    impacts: dict[str, list[float]] = field(default_factory=dict)
    bounds: dict[str, list[float]] = field(default_factory=dict)  # largest impact of each run of POSTINGS
    top: dict[str, float] = field(default_factory=dict)
    checks: list[tuple[set, set]] = field(default_factory=list)  # grams of question and answer of each row
    row: dict[str, int] = field(default_factory=dict)
    block_top: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCKS), np.float32))  # by row and block of units

    @classmethod
    def build(cls, rows: list[tuple[int | None, str]], counts: Counts | None = None) -> Index:
        """Index over (item_id, text) rows; ``counts`` are those over all items, where the rows are not all of them."""
        out = cls()
        bags: list[Counter] = []
        for item, text in rows:
            own = unit_bags(text)
            if not own:
                continue
            question, answer = question_answer(text)
            out.checks.append((gram_set(question), gram_set(answer)))
            bags += own
            out.items += [len(out.ids)] * len(own)
            out.ids.append(item)
        counts = counts or Counts.of(bags)
        n, mean, df = counts.units, counts.words / max(1, counts.units), counts.df
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for u, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in bag.items()}
            own = sum(raw.values())
            for t, v in raw.items():
                postings[t].append((u, v / own))
        for t, p in postings.items():
            out.units[t] = [u for u, _ in p]
            out.impacts[t] = [v for _, v in p]
            out.bounds[t] = [max(out.impacts[t][i : i + POSTINGS]) for i in range(0, len(p), POSTINGS)]
            out.top[t] = max(out.bounds[t])
        out.row = {t: i for i, t in enumerate(postings)}
        out.block_top = np.zeros((len(postings), BLOCKS), np.float32)
        for i, p in enumerate(postings.values()):
            for u, v in p:
                b = u * BLOCKS // len(bags)
                out.block_top[i, b] = max(out.block_top[i, b], v)
        return out

    def promising(self, words: list[str], threshold: float) -> list[int]:
        """Starts of the passages where, in some block of units, the bounds of the words reach the threshold."""
        row = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        last = max(0, -(-(len(words) - PASSAGE) // STRIDE))
        out: list[int] = []
        for low in range(0, last + 1, LOOK):
            high = min(low + LOOK, last + 1)
            place = low * STRIDE + np.flatnonzero(row[low * STRIDE : (high - 1) * STRIDE + PASSAGE] >= 0)
            # A word stands in the passage that starts in its stride and in those that reach into it.
            held = np.concatenate(
                [(place // STRIDE - k) * len(self.row) + row[place] for k in range(PASSAGE // STRIDE)]
            )
            held = np.unique(held[(held >= low * len(self.row)) & (held < high * len(self.row))])
            if not len(held):
                continue
            passage = held // len(self.row)
            first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            bound = np.add.reduceat(self.block_top[held % len(self.row)], first, axis=0).max(1)
            out += [int(p) * STRIDE for p in passage[first][bound >= threshold - 1e-4]]
        return out

    def search(self, query_terms: set[str], threshold: float) -> list[tuple[int, float]]:
        """All (unit, score) at the threshold or above: block-max WAND, document at a time.

        Cursors stand in order of unit; the pivot is the first unit whose
        terms' largest impacts reach the threshold.  If the bounds of the
        pivot's own blocks do not, all cursors up to it jump behind the
        shortest of those blocks; else the unit is scored.
        """
        # unit, number, place, and the postings of the term
        cursors = [
            [self.units[t][0], k, 0, self.units[t], self.impacts[t], self.bounds[t], self.top[t]]
            for k, t in enumerate(sorted(query_terms)) if t in self.units
        ]
        least = threshold - 1e-9
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[6]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            block, score, behind = 0.0, 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for _, _, place, units, impacts, bounds, _ in cursors[: pivot + 1]:
                at = bisect_left(units, unit, place)
                if at < len(units):
                    block += bounds[at // POSTINGS]
                    end = units[min(len(units), (at // POSTINGS + 1) * POSTINGS) - 1]
                    if end < behind:
                        behind = end + 1
                    if units[at] == unit:
                        score += impacts[at]
            if block >= least:
                if score >= least:
                    out.append((unit, score))
                behind = unit + 1
            behind = max(behind, unit + 1)
            for c in cursors[: pivot + 1]:
                at = c[2] = bisect_left(c[3], behind, c[2])
                c[0] = c[3][at] if at < len(c[3]) else math.inf
            cursors = [c for c in cursors if c[0] != math.inf]
        return out

    def held(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """Row of an item to (best score, question overlap, answer overlap) of the rows that the text holds."""
        words = terms(text)
        if not words:
            return {}
        best: dict[int, float] = {}
        near: dict[int, list[int]] = defaultdict(list)
        for start in self.promising(words, threshold):
            for unit, score in self.search(set(words[start : start + PASSAGE]), threshold):
                row = self.items[unit]
                best[row] = max(best.get(row, 0.0), score)
                near[row].append(start)
        out = {}
        for row, score in best.items():
            question, answer = self.checks[row]
            length = STRIDE + PASSAGE + 2 * (len(question) + len(answer))
            seen: set = set()
            for start in near[row]:
                around = words[max(0, start - length) : start + PASSAGE + length]
                for n in {len(g) for s in (question, answer) for g in s}:
                    seen |= set(zip(*(around[i:] for i in range(n))))
            q = len(question & seen) / len(question) if question else 1.0
            a = len(answer & seen) / len(answer) if answer else 1.0
            if q >= overlap and a >= overlap:
                out[row] = score, q, a
        return out

    def leaks(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
        """(item_id, row, score, question overlap, answer overlap): the best row of each id, every row without id."""
        best: dict[tuple, tuple] = {}
        for row, found in self.held(text, threshold, overlap).items():
            item = self.ids[row]
            key = (item, row if item is None else None)
            best[key] = max(best.get(key, (*found, row)), (*found, row))
        return sorted(((k[0], f[3], *f[:3]) for k, f in best.items()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def unit_counts(items: DataFrame) -> DataFrame:
    """(part, term, units, words): units of the part's items that hold the term; a null term counts all units and words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            parts: dict[int, list[Counter]] = defaultdict(list)
            for part, text in zip(batch.column("part").to_pylist(), texts(batch, "text")):
                parts[part] += unit_bags(text)
            rows = []
            for part, bags in parts.items():
                own = Counts.of(bags)
                rows.append((part, None, own.units, own.words))
                rows += [(part, t, n, 0) for t, n in own.df.items()]
            if rows:
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "term", "units", "words"]
                )

    found = items.select("part", "text").mapInArrow(run, "part int, term string, units long, words long")
    return found.groupBy("part", "term").agg(F.sum("units").alias("units"), F.sum("words").alias("words"))


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", most_bytes: int = INDEX_BYTES):
    """Indexes over all items, each over at most about ``most_bytes`` of text, so each may be sent to every task.

    Scores do not depend on the cut: terms, units and words are counted once
    over all items, and each index gets the counts of its own terms.
    """
    own = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-int(total) // most_bytes) or 1
    own = own.distinct().withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    counts = stage(unit_counts(own), "unit-counts")
    units, words = counts.filter("term is null").agg(F.sum("units"), F.sum("words")).first()
    df = counts.filter("term is not null").groupBy("term").agg(F.sum("units").alias("df"))
    for part in range(parts):
        mine = counts.filter((F.col("part") == part) & F.col("term").isNotNull()).join(df, "term")
        rows = own.filter(F.col("part") == part).orderBy("item_id", "text").select("item_id", "text").collect()
        yield Index.build([tuple(r) for r in rows], Counts(units or 0, words or 0, dict(mine.select("term", "df").collect())))


FOUND = ("score", "question_overlap", "answer_overlap")


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
    doc_id: str = "doc_id", text: str = "text", most_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item that a document holds.

    Every passage of every whole text is a query; every item whose BM25 score
    reaches the threshold's share of its own is retrieved, none is cut off, and
    kept if enough of the n-grams of its question and of its answer stand
    around the passages.  Repeated item ids give the best of their texts; null
    and empty texts hold nothing, on either side; of items without id each
    text counts for itself, with a null item_id.  A repeated document is
    reported as often as it comes.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest string, item_id long, lone string, score double, question_overlap double, answer_overlap double"

    def pass_over(at: int, index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Batches) -> Batches:
            for batch in batches:
                place, rows = [], []
                for k, body in enumerate(texts(batch, "text")):
                    found = sent.value.leaks(body, threshold, overlap)
                    digest = hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest() if found else ""
                    for item, row, *scores in found:
                        place.append(k)
                        rows.append((digest, item, f"{at}:{row}" if item is None else None, *scores))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), *[pa.float64()] * 3)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(place, pa.int64())),
                            *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)),
                        ],
                        names=["doc_id", "digest", "item_id", "lone", *FOUND],
                    )

        return own.mapInArrow(run, schema).withColumn("index", F.lit(at))

    passes = [pass_over(at, index) for at, index in enumerate(indexes(items, most_bytes=most_bytes))]
    if len(passes) == 1:
        return passes[0].select("doc_id", "item_id", *FOUND)
    # Texts of one id may stand in several indexes: the best of them, as often as the document itself comes.
    keys = ["doc_id", "digest", "item_id", "lone"]
    by_index = reduce(DataFrame.unionByName, passes).groupBy(*keys, "index").agg(
        F.max(F.struct(*FOUND)).alias("best"), F.count("*").cast("int").alias("times")
    )
    best = by_index.groupBy(*keys).agg(F.max("best").alias("best"), F.max("times").alias("times"))
    return best.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that hold no item, with or without id; one pass for each index."""
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(series, sent=sent):
            return series.map(lambda t: not sent.value.held(t or "", **how)).astype(bool)

        docs = docs.filter(F.pandas_udf(clean, "boolean")(F.col(text)))
    return docs


@query("op9_benchmark_leaks")
def benchmark_leaks(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
