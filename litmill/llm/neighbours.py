"""Quality by nearest neighbours: labelled latent-semantic vectors vote on every document, weighted by cosine."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Batches, find_words, table, texts, window_hashes, worker_cache
from litmill.llm.registry import query

WORDS, SHAPES = 3072, 1008  # hashed features; the rest are counts in steps
STEPS = 16
FEATURES = WORDS + SHAPES + STEPS
LABELLED_ROWS = 4096  # labelled rows that vote, at most
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8  # power of the cosine in a vote's weight
BLOCK = 256
KEPT_SCORE = 0.7

_letters, _digits = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")


def _shape(word: str) -> str:
    """Runs of letters, of capitals and of digits by class; other characters as they are."""
    word = _letters.sub(lambda m: "U" if len(m.group()) > 1 and m.group().isupper() else "a", word)
    return _digits.sub("0", word)


class _Slots:
    """Features of each word, remembered for frequent words up to a bound."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > self.LIMIT:
            seen.clear()
        found = list(map(seen.get, words))
        if None in found:
            for w in {w for w, f in zip(words, found) if f is None}:
                lower = w.lower().encode("utf-8", "surrogatepass")
                shape = _shape(w).encode("utf-8", "surrogatepass")
                seen[w] = xxhash.xxh3_64_intdigest(lower) % WORDS * 65536 + WORDS + xxhash.xxh3_64_intdigest(shape) % SHAPES
            found = [seen[w] if f is None else f for w, f in zip(words, found)]
        return np.array(found, np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, damped count): words, word shapes, and steps of length and of repetition."""
    words = find_words(text)
    both = worker_cache("slots", _Slots)(words)
    counts = np.bincount(both >> 16, minlength=WORDS + SHAPES) + np.bincount(both & 65535, minlength=WORDS + SHAPES)
    place = np.flatnonzero(counts)
    count = counts[place]
    weight = np.where(place < WORDS, 1.0, 2.0) * np.log1p(count)
    n = len(words)
    # Four steps of length, six of words seen again five words on, six of words that differ.
    fives = np.sort(window_hashes(both.astype(np.uint64), 5))
    again = float((fives[1:] == fives[:-1]).sum()) / (n - 4) if n > 4 else 0.0
    twice = float((both[1:] == both[:-1]).sum()) / max(1, n - 1)
    length = min(3, int(np.log10(n + 1)))
    steps = [length, 4 + min(5, int(again * 12)), 10 + min(5, int(twice * 12))]
    strong = np.array([0.5, 1.0, 1.0]) * max(1.0, np.linalg.norm(weight) / 4)
    return np.r_[place, WORDS + SHAPES + np.array(steps)], np.r_[weight, strong]


def _dense(bodies: list[str]) -> np.ndarray:
    out = np.zeros((len(bodies), FEATURES), np.float32)
    for k, body in enumerate(bodies):
        place, weight = features(body)
        out[k, place] = weight
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    """What every task gets: at most LABELLED_ROWS vectors of RANK numbers, and the map into them."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, bodies: list[str]) -> np.ndarray:
        x = _dense(bodies) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, bodies: list[str]) -> np.ndarray:
        """Weighted share of label 1 among the nearest vectors; without labels the middle, 0.5."""
        if not len(self.labels):
            return np.full(len(bodies), 0.5)
        cosine = self.latent(bodies) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(float) ** SHARPNESS + 1e-6
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs; FEATURES numbers, whatever the table's size."""

    def run(batches: Batches) -> Batches:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for body in texts(batch, "text"):
                total[features(body)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES + 1), pa.int64()), pa.array(np.r_[total, n], pa.int64())], names=["f", "n"]
        )

    rows = docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for f, n in rows:
        out[f] = n
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, rank: int = RANK) -> Model:
    """Latent-semantic vectors of at most ``rows`` labelled documents, weighed by counts over all documents.

    The labelled rows are those of least hash, so the choice does not depend on
    the order of the table; rows without label or document are passed over.  A
    repeated (doc_id, label) is one row; of several texts of a doc_id the one of
    least digest stands for it.
    ``labels`` must hold only rows that may be learned from.
    """
    counts, n = document_counts(docs)
    idf = np.log((n + 1) / (counts + 1)).astype(np.float32) + 0.3
    idf[WORDS + SHAPES :] = 1.0
    few = (
        labels.filter("label is not null and doc_id is not null")
        .select("doc_id", "label")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    # The labelled side is bounded by ``rows``, so it may be broadcast.
    known = docs.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")

    def run(batches: Batches) -> Batches:
        # A task returns a row only if its digest is below all that it returned for the same doc_id and label.
        least: dict[tuple, str] = {}
        for batch in batches:
            at, found = [], []
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist())
            for k, (key, body) in enumerate(zip(keys, texts(batch, "text"))):
                digest = hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest()
                if digest < least.get(key, "g"):
                    least[key] = digest
                    at.append(k)
                    found.append((digest, *features(body)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "label")),
                    pa.array([d for d, _, _ in found], pa.string()),
                    pa.array([p.astype(np.int32) for _, p, _ in found], pa.list_(pa.int32())),
                    pa.array([w.astype(np.float32) for _, _, w in found], pa.list_(pa.float32())),
                ],
                names=["doc_id", "label", "digest", "place", "weight"],
            )

    kind = known.schema["doc_id"].dataType.simpleString()
    got = (
        known.mapInArrow(run, f"doc_id {kind}, label int, digest string, place array<int>, weight array<float>")
        .groupBy("doc_id", "label")
        .agg(F.min(F.struct("digest", "place", "weight")).alias("own"))
        .select("label", "own.place", "own.weight")
        .orderBy("label", "place")
    )
    sparse = got.collect()
    x = np.zeros((len(sparse), FEATURES), np.float32)
    for k, r in enumerate(sparse):
        x[k, r["place"]] = r["weight"]
    y = np.array([r["label"] for r in sparse], float)
    if not len(y):
        return Model(idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    basis = _basis(x, min(rank, *x.shape))
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return Model(idf, basis, z, y, float(y.mean()))


def _basis(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(x.shape[1], rank + 16))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T[:, :rank]).astype(np.float32)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row: cosine products against all labelled vectors, a block of documents at a time.

    Null texts count as empty; an empty text has its length only, and its
    neighbours are short texts.  Rows come out one for one.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                found = sent.value.scores(texts(batch, "text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return own.mapInArrow(run, f"doc_id {kind}, score double")


@query("op2_neighbour_quality")
def neighbour_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(docs.select("doc_id", "text"), labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= KEPT_SCORE, 1).otherwise(0).alias("predicted"),
    )
