"""N-gram Jaccard join: MinHash bands find candidates, whole n-gram sets decide."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Batches, WordHashes, find_words, mixed, stage, table, texts, window_hashes, worker_cache
from litmill.llm.registry import query
from litmill.operators.resolve import components

GRAM = 5
SIMILARITY = 0.8
RECALL = 0.995  # chance that a pair at the threshold shares a band
MOST_HASHES = 128
BLOCK, BLOCK_BYTES = 2048, 16 << 20  # members of a candidate group, and their text, that meet as many others in one task
TILE = 128  # members compared at a time within a task
FEW = 200  # pairs of a tile that are intersected one by one
COLUMNS = 4096  # shared n-grams multiplied at a time


def bands_for(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, that reach the recall at the threshold."""
    best = None
    for rows in range(1, most + 1):
        miss = 1 - similarity**rows
        bands = 1 if miss <= 0 else int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes than allowed")
    return best


def grams(text: str, n: int = GRAM) -> np.ndarray:
    """Sorted set of n-gram hashes of the lower-case words; a shorter text is one gram of all its words."""
    words = find_words(text.lower())
    h = worker_cache("words", WordHashes)(words)
    return np.unique(window_hashes(h, min(n, len(words)))) if words else h


def signature(g: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band: least values of ``rows`` orders of the grams, each a salted multiplication."""
    salt = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factor = mixed(salt) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 512):
        orders = (g[at : at + 512] ^ salt[:, None]) * factor[:, None]
        np.minimum(least, orders.min(1), out=least)
    least = least.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(3) + least[:, k])
    return out


def digest(g: np.ndarray) -> str:
    """128 bits that name a gram set, as hex; empty for a text without words."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(g.tobytes()) if len(g) else ""


def sketches(docs: DataFrame, bands: int, rows: int, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_key, class_key, n_bytes, bands) of each row; class_key is null for a text without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, bands_ = [], []
            for text in texts(batch, "text"):
                g = grams(text, gram)
                keys.append(digest(g) or None)
                bands_.append(signature(g, bands, rows).view(np.int64) if len(g) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row_key"), pa.array(keys, pa.string()), batch.column("n_bytes"),
                    pa.array(bands_, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_key", "class_key", "n_bytes", "bands"],
            )

    sized = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return sized.mapInArrow(run, f"doc_id {kind}, row_key string, class_key string, n_bytes long, bands array<long>")


def overlaps(a: Sequence[np.ndarray], b: Sequence[np.ndarray], n_grams: int) -> np.ndarray:
    """Sizes of all intersections of two lists of sets of gram numbers: products of membership columns, some at a time."""
    owner_a, owner_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    gram_a, gram_b = np.concatenate(a), np.concatenate(b)
    here = np.zeros(n_grams, np.int8)
    here[gram_a] = 1
    here[gram_b] |= 2
    place = np.cumsum(here == 3) - 1
    columns = int(place[-1]) + 1 if n_grams else 0

    def by_column(owner: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = here[gram] == 3
        owner, column = owner[keep], place[gram[keep]]
        order = np.argsort(column, kind="stable")
        return owner[order], column[order]

    owner_a, column_a = by_column(owner_a, gram_a)
    owner_b, column_b = by_column(owner_b, gram_b)
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, columns, COLUMNS):
        parts = []
        for n, owner, column in ((len(a), owner_a, column_a), (len(b), owner_b, column_b)):
            first, last = np.searchsorted(column, [low, low + COLUMNS])
            m = np.zeros((n, COLUMNS), np.float32)
            m[owner[first:last], column[first:last] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


class Roots:
    """Union of numbers, each group named by its least."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.top(i), self.top(j)))
        self.up[b] = a


def linked(
    sets: Sequence[np.ndarray], bands: np.ndarray, weight: np.ndarray, side: np.ndarray | None, similarity: float
) -> tuple[np.ndarray, Roots]:
    """Rows linked to each member, and what links join: over all pairs that share a band, at least.

    With ``side`` only pairs of different sides count.  Members are taken a
    tile at a time; tiles without a shared band between them cost nothing more.
    """
    n = len(sets)
    known, number = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, np.int64))
    ends = np.cumsum([len(s) for s in sets])
    ids = np.split(number, ends[:-1])
    size = np.array([len(s) for s in sets], np.float32)
    links, roots = np.zeros(n, np.int64), Roots(n)
    for low in range(0, n, TILE):
        a = np.arange(low, min(n, low + TILE))
        for high in range(low, n, TILE):
            b = np.arange(high, min(n, high + TILE))
            banded = np.zeros((len(a), len(b)), bool)
            for k in range(bands.shape[1]):
                banded |= bands[a, k][:, None] == bands[b, k][None, :]
            asked = a[:, None] < b[None, :]
            if side is not None:
                asked &= side[a][:, None] != side[b][None, :]
            banded &= asked
            n_banded = int(banded.sum())
            if not n_banded:
                continue
            need = lambda common, i, j: common >= similarity * (size[i] + size[j] - common) - 1e-3
            if n_banded <= FEW < asked.sum():
                near = np.zeros_like(banded)
                for i, j in zip(*np.nonzero(banded)):
                    common = len(np.intersect1d(ids[a[i]], ids[b[j]], assume_unique=True))
                    near[i, j] = need(common, a[i], b[j])
            else:
                # A product takes all pairs of the tile at once, so all of them are judged.
                common = overlaps([ids[i] for i in a], [ids[j] for j in b], len(known))
                near = need(common, a[:, None], b[None, :]) & asked
            links[a] += near @ weight[b]
            links[b] += weight[a] @ near
            for i, j in zip(*np.nonzero(near)):
                roots.join(int(a[i]), int(b[j]))
    return links, roots


def _links(similarity: float, gram: int):
    """Function over one pair of blocks of a candidate group: links per class, and what they join."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, tuple] = {}
        for text, key, block, size, bands in zip(
            rows["text"], rows["class_key"], rows["own_block"], rows["class_size"], rows["bands"]
        ):
            if key not in known:
                known[key] = grams(text or "", gram), block, size, bands
        keys = sorted(known)
        out = []
        if len(keys) > 1:
            apart = rows["low"].iloc[0] != rows["high"].iloc[0]  # pairs within a block are compared where it meets itself
            weight = np.array([known[k][2] for k in keys], np.int64)
            links, roots = linked(
                [known[k][0] for k in keys], np.array([known[k][3] for k in keys]), weight,
                np.array([known[k][1] for k in keys]) if apart else None, similarity,
            )
            out = [(keys[i], int(links[i]), keys[roots.top(int(i))]) for i in np.flatnonzero(links)]
        return pd.DataFrame(out, columns=["class_key", "links", "root"])

    return run


def row_key(doc_id: str, text: str) -> Column:
    """Names a row by id and text; only repeated rows share it."""
    parts = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.md5(parts.cast("binary"))


def near_classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, n_links, set_id), one row per input row; see ``classify``."""
    return classify(docs, **how).select("doc_id", "class_id", "n_links", "set_id")


def classify(
    docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, gram: int = GRAM,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, row_key, cluster, class_id, n_links, set_id), one row per input row.

    ``set_id`` is the least doc_id with the same n-gram set, ``n_links`` counts
    the other rows at the similarity or above, and ``class_id`` is the least
    doc_id that links lead to.  Words are lower-cased; a text of fewer than
    ``gram`` words is one gram; texts without words (null too) link to nothing
    and are classes of their own.  Rows without doc_id are linked as any other;
    a class that holds no doc_id has a null class_id.

    Rows of one n-gram set are one member.  Members that share a band, directly
    or through others, form candidate groups; a group is cut into blocks of at
    most 2048 members and about 16 MB, and each pair of blocks meets in a task,
    where pairs that share a band are compared on whole sets.  Pairs never
    become rows: a task returns a count and one root for each member.  A text is
    sent once for each block of its group, so once in all but huge groups.
    """
    bands, rows = bands_for(similarity, recall)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("row_key"))
    found = stage(sketches(own, bands, rows, gram), "sketches")
    members = stage(
        found.filter("class_key is not null")
        .groupBy("class_key")
        .agg(
            F.min("doc_id").alias("set_id"), F.count("*").alias("class_size"), F.first("bands").alias("bands"),
            F.min(F.struct("row_key", "n_bytes")).alias("rep"),
        )
        .select("class_key", "set_id", "class_size", "bands", "rep.*"),
        "members",
    )
    banded = members.select("class_key", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.min("class_key").alias("a"), F.max("class_key").alias("b"))
    shared = shared.filter("a <> b").select("band", "value")
    keys = banded.join(shared, ["band", "value"]).select(
        F.col("class_key").alias("record_id"), F.col("band").cast("string").alias("kind"), F.col("value").cast("string").alias("value")
    )
    groups = stage(components(keys), "candidate-groups")
    placed = groups.withColumnRenamed("record_id", "class_key").join(members, "class_key")
    sizes = groups.withColumnRenamed("record_id", "class_key").join(members.select("class_key", "n_bytes"), "class_key").groupBy(
        "cluster"
    ).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total"))
    n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    block = F.pmod(F.xxhash64("class_key"), n_blocks).cast("int")
    placed = placed.join(sizes.filter("n > 1"), "cluster").select(
        "class_key", "cluster", "class_size", "bands", "row_key", n_blocks.alias("n_blocks"), block.alias("own_block")
    )
    # Repeated rows share a key and a text: one of them is enough.
    bodies = own.select("row_key", "text").join(placed, "row_key").groupBy(
        "row_key", "class_key", "cluster", "class_size", "n_blocks", "own_block"
    ).agg(F.first("text").alias("text"), F.first("bands").alias("bands"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = bodies.select("cluster", "class_key", "class_size", "own_block", "text", "bands", other).select(
        "cluster", "class_key", "class_size", "own_block", "text", "bands",
        F.least("own_block", "other").alias("low"), F.greatest("own_block", "other").alias("high"),
    )
    links = stage(
        dealt.groupBy("cluster", "low", "high").applyInPandas(
            _links(similarity, gram), "class_key string, links long, root string"
        ),
        "links",
    )
    joined = links.select(
        F.col("class_key").alias("record_id"), F.lit("link").alias("kind"), F.col("root").alias("value")
    ).unionByName(links.select(F.col("root").alias("record_id"), F.lit("link").alias("kind"), F.col("root").alias("value")))
    classes = components(joined.distinct())
    counts = links.groupBy("class_key").agg(F.sum("links").alias("links"))
    named = (
        members.select("class_key", "set_id", "class_size")
        .join(classes.withColumnRenamed("record_id", "class_key"), "class_key", "left")
        .join(counts, "class_key", "left")
        .withColumn("cluster", F.coalesce("cluster", "class_key"))
    )
    ids = named.groupBy("cluster").agg(F.min("set_id").alias("class_id"))
    named = named.join(ids, "cluster").select(
        "class_key", "cluster", "class_id", "set_id", (F.coalesce("links", F.lit(0)) + F.col("class_size") - 1).alias("n_links")
    )
    wordless = found.filter("class_key is null").select(
        "doc_id", "row_key", F.col("row_key").alias("cluster"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("set_id"),
    )
    return (
        found.filter("class_key is not null")
        .join(named, "class_key")
        .select("doc_id", "row_key", "cluster", "class_id", "n_links", "set_id")
        .unionByName(wordless)
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class, all columns as they were: the one with the least doc_id (null last).

    Rows that share class and doc_id are told apart by a digest of id and text,
    the least of which stays; of repeated rows one stays.
    """
    classes = classify(docs, doc_id=doc_id, text=text, **how)
    first = classes.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("f"))
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    kept = first.select(F.col("f.row_key").alias(key))
    return docs.withColumn(key, row_key(doc_id, text)).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)


@query("op6_jaccard_join")
def jaccard_join(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))
