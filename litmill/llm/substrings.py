"""Repeated passages: seeds on winnowed anchors, extended both ways, kept where they reach the window length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Batches, WordHashes, find_words, mixed, stage, table, texts, window_hashes, worker_cache
from litmill.llm.registry import query

WINDOW = 50
SEED = 10  # words in an anchor; each window of WINDOW words chooses one of its WINDOW - SEED + 1 seeds

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Spans:
    """Hashes of any run of words of one document, from prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.full(n, _BASE, np.uint64)
        inverse = np.full(n, _BASE_INVERSE, np.uint64)
        if n:
            power[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(power), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start..end, end not included."""
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mixed(value + (end - start).astype(np.uint64))


def anchors(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Winnowing: (seed hash, first and last start of the windows that choose it) of each chosen anchor.

    A window chooses its least seed (the first of equals), so equal windows
    choose alike wherever they stand, and each window belongs to one anchor.
    """
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    seeds = window_hashes(words, seed)
    view = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)
    chosen = view.argmin(1) + np.arange(len(view))
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:] - 1, len(chosen) - 1]
    return seeds[chosen[first]], first, last


def _hashes(words: list[str]) -> np.ndarray:
    return worker_cache("words", WordHashes)(words)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _tag(digest: bytes) -> int:
    """Tells texts of one doc_id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def seeds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per document: digest of all its words, their number, and its anchors as parallel lists.

    ``block`` hashes all words that the anchor's windows cover: the match
    extended both ways as far as its windows reach.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in texts(batch, "text"):
                words = find_words(text)
                h = _hashes(words)
                anchor, first, last = anchors(h, window, seed)
                block = Spans(h)(first, last + window)
                digest = _digest(words)
                row = (digest, _tag(digest), len(words), anchor.view(np.int64), block.view(np.int64), first, last)
                for o, v in zip(out, row):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64())),
                    pa.array(out[5], pa.list_(pa.int32())), pa.array(out[6], pa.list_(pa.int32())),
                ],
                names=["doc_id", "digest", "tag", "n_words", "anchor", "block", "first", "last"],
            )

    return docs.mapInArrow(
        run,
        f"doc_id {kind}, digest binary, tag long, n_words long, anchor array<long>, block array<long>, "
        "first array<int>, last array<int>",
    )


def _windows(pairs: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, doc_id, tag, start) of every window of the anchors listed with each text."""
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("todo").to_pylist()
            for k, text in enumerate(texts(batch, "text")):
                words = find_words(text)
                tag, h = _tag(_digest(words)), _hashes(words)
                todo = [x for x in lists[k] if x["tag"] == tag]
                if not todo:
                    continue
                start = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in todo])
                anchor = np.repeat([x["anchor"] for x in todo], [x["last"] + 1 - x["first"] for x in todo])
                value = Spans(h)(start, start + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor, pa.int64()), pa.array(value.view(np.int64)),
                        ids.take(pa.array(np.full(len(start), k))), pa.array(np.full(len(start), tag)),
                        pa.array(start.astype(np.int32)),
                    ],
                    names=["anchor", "hash", "doc_id", "tag", "start"],
                )

    return pairs.mapInArrow(run, f"anchor long, hash long, doc_id {kind}, tag long, start int")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Where documents repeat what starts in a document with a smaller id.

    Returns (doc_id, tag, first, last): runs of starts of windows that repeat, and
    (doc_id, digest, n_words, copy): whether all words stand, in the same
    order, in a smaller document.  No pairs of occurrences are formed: an
    anchor's occurrences are matched to the least document by what their
    windows hold.  First the whole reach of the anchor is compared; only where
    an anchor stands in differing reaches are its single windows compared.
    """
    found = stage(seeds(docs, window, seed), "anchors")
    least = found.groupBy("digest").agg(F.min("doc_id").alias("least"))
    whole = found.select("doc_id", "digest", "n_words").join(least, "digest").select(
        "doc_id", "digest", "n_words", (F.col("doc_id") > F.col("least")).alias("copy")
    )
    # Copies repeat their first text word by word, so only first texts go on.
    first_texts = found.filter("doc_id is not null and size(anchor) > 0").join(least, "digest").filter("doc_id = least")
    each = first_texts.select(
        "doc_id", "tag", F.explode(F.arrays_zip("anchor", "block", "first", "last")).alias("a")
    ).select("doc_id", "tag", "a.*")
    blocks = each.groupBy("anchor", "block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = (
        blocks.groupBy("anchor")
        .agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.count("*").alias("n"))
        .filter("_low < _high")
        .select("anchor", (F.col("n") > 1).alias("differ"))
    )
    known = stage(blocks.join(shared, "anchor").select("anchor", "block", "low", "differ"), "shared-anchors")
    met = stage(each.join(known, ["anchor", "block"]), "met-anchors")
    coarse = met.filter("low < doc_id").select("doc_id", "tag", "first", "last")
    # The least document of a reach keeps its windows in the comparison, so each window meets its first place.
    todo = (
        met.filter("low = doc_id and differ")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("tag", "anchor", "first", "last")).alias("todo"))
    )
    single = stage(_windows(docs.join(todo, "doc_id"), window), "windows")
    origin = single.groupBy("anchor", "hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    fine = (
        single.join(origin.filter("low < high").select("anchor", "hash", "low"), ["anchor", "hash"])
        .filter("low < doc_id")
        .select("doc_id", "tag", F.col("start").alias("first"), F.col("start").alias("last"))
    )
    return coarse.unionByName(fine), whole


def maximal(starts: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal repeats as [start, end) of words, from runs of window starts."""
    out: list[list[int]] = []
    for first, last in sorted(starts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + window)
        else:
            out.append([first, last + window])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats): each text without the passages that a smaller document holds.

    A word goes if a window of ``window`` words over it also starts in a
    document with a smaller doc_id; ``repeats`` lists the maximal passages as
    [start, end) of words, ``kept`` joins what is left by one blank.  Null
    texts have no words.  Rows without a doc_id keep all words and are no
    source for others.  Rows that share a doc_id do not repeat each other.
    Windows are compared within an anchor by 64-bit hashes of their words.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    runs, whole = repeats(own, window)
    kind = own.schema["doc_id"].dataType.simpleString()
    gone = runs.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "first", "last")).alias("runs"))
    copies = whole.filter(f"copy and n_words >= {window}").select("doc_id", "digest").distinct()
    copies = copies.groupBy("doc_id").agg(F.collect_list("digest").alias("copies"))
    marks = gone.join(copies, "doc_id", "full_outer")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = zip(texts(batch, "text"), batch.column("runs").to_pylist(), batch.column("copies").to_pylist())
            n_words, n_removed, kept, spans = [], [], [], []
            for text_, starts, whole_copies in rows:
                words = find_words(text_)
                n = len(words)
                found = []
                if starts or whole_copies:
                    digest = _digest(words)
                    tag = _tag(digest)
                    found = maximal([(r["first"], r["last"]) for r in starts or () if r["tag"] == tag], window)
                    if digest in (whole_copies or ()):
                        found = [(0, n)]
                left, at = [], 0
                for a, b in found:
                    left += words[at : min(a, n)]
                    at = min(b, n)
                left += words[at:]
                n_words.append(n)
                n_removed.append(n - len(left))
                kept.append(" ".join(left))
                spans.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", "repeats"],
            )

    return own.join(marks, "doc_id", "left").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept string, repeats array<struct<start:int,end:int>>"
    )


@query("op4_repeated_passages")
def repeated_passages(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        F.size("repeats").cast("long").alias("n_repeats"),
    )
