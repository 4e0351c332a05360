"""Token files: ids as Parquet lists in document order, read back whole or by column."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.llm.common import Batches, list_array, table, worker_cache
from litmill.llm.registry import query
from litmill.scale import new_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
SLICE_BYTES = 8 << 20  # text encoded together
BLANK = "\u0120"  # fixed value: what stands for a blank in byte-level tokens

class WordPool:
    """Words to lists of ids, remembered up to a bound and then forgotten all at once."""

    LIMIT = 700_000  # words
    MOST_IDS = 6_000_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.uint32)
        self.size = np.zeros(1 << 14, np.int32)  # -1: the word needs its whole text
        self.n_ids = 0

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, len(a) * 3 // 2), a.dtype)
        out[: len(a)] = a
        return out

    def add(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        n, held = len(self.at), np.maximum(size, 0)
        self.ids = self._room(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.start, self.size = self._room(self.start, n + len(words)), self._room(self.size, n + len(words))
        self.start[n : n + len(words)] = self.n_ids + np.cumsum(held) - held
        self.size[n : n + len(words)] = size
        self.n_ids += len(ids)
        self.at.update(zip(words, range(n, n + len(words))))

    def full(self) -> bool:
        return len(self.at) > self.LIMIT or self.n_ids > self.MOST_IDS


class Encoder:
    """Byte-level encoding with the tokenizers library; text between blanks is encoded once and remembered.

    Cutting before a blank that stands between two other characters cuts where
    the splitter of a byte-level model cuts anyway, so each word, its blank
    included, has the same ids in every text.  Words not met before go to the
    library many at a time, joined by blanks; the ids of a word start where a
    token begins with a blank.  Texts with other white space next to a blank go
    to the library whole, as do texts that hold an added token of the model
    (each is one id there) and all texts of a model of another kind.
    """

    JOINED = 500  # new words in one call text

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        kind = self.whole.pre_tokenizer
        self.plain = isinstance(kind, ByteLevel) and not kind.add_prefix_space and self.whole.normalizer is None
        self.starts = np.zeros(self.whole.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, i in self.whole.get_vocab(with_added_tokens=True).items():
            if i >= len(self.starts):
                self.starts = np.append(self.starts, np.zeros(i + 1 - len(self.starts), bool))
            self.starts[i] = token.startswith(BLANK)
        self.pool = WordPool()

    def _library(self, bodies: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(bodies, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode what follows a blank; words with white space at either end, and empty ones, need their text."""
        alone = [bool(w) and not w[0].isspace() and not w[-1].isspace() for w in new]
        words = [w for w, yes in zip(new, alone) if yes]
        joined = [" " + " ".join(words[at : at + self.JOINED]) for at in range(0, len(words), self.JOINED)]
        parts = [np.array(ids, np.uint32) for ids in self._library(joined)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        first = np.flatnonzero(self.starts[ids])
        size = np.full(len(new), -1, np.int32)
        size[np.flatnonzero(alone)] = np.diff(np.r_[first, len(ids)])
        self.pool.add(new, size, ids)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and the ids of all texts (null as empty), one after another."""
        column = pc.fill_null(column, "")
        apart = np.full(len(column), not self.plain)
        for a in self.added:
            apart |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        if self.plain:
            # A text that goes to the library whole is one long head without words.
            cut = pc.split_pattern(pc.if_else(pa.array(apart), pa.scalar(""), column), " ")
            ends, words = cut.offsets.to_numpy().astype(np.int64), cut.values
        else:
            ends, words = np.arange(len(column) + 1), pa.array([""] * len(column), pa.string())
        ends, words = ends - ends[0], words.slice(ends[0], ends[-1] - ends[0])
        head = ends[:-1]
        heads = words.take(pa.array(head)).to_pylist()
        coded = words.dictionary_encode()
        known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        pool = self.pool
        if pool.full():
            pool.clear()
        row = np.fromiter(map(pool.at.get, known, repeat(-1)), np.int64, len(known))
        after_blank = np.ones(len(code), bool)
        after_blank[head] = False
        wanted = np.zeros(len(known), bool)
        wanted[code[after_blank]] = True
        new = np.flatnonzero(wanted & (row < 0))
        if len(new):
            row[new] = len(pool.at) + np.arange(len(new))
            self._learn([known[k] for k in new])
        row = np.where(row < 0, 0, row)
        size = pool.size[row][code]
        start = pool.start[row][code].astype(np.int64)
        size[head] = 0
        odd = np.add.reduceat(size < 0, head) > 0 if len(head) else np.zeros(0, bool)
        several = np.diff(ends) > 1
        odd |= several & np.fromiter((not h or h[-1].isspace() for h in heads), bool, len(heads))
        apart |= odd
        own = self._library(
            [b if whole else h for b, h, whole in zip(pc.if_else(pa.array(apart), column, pa.scalar("")).to_pylist(), heads, apart)]
        )
        size[np.repeat(apart, np.diff(ends))] = 0
        own_size = np.fromiter(map(len, own), np.int32, len(own))
        size[head], start[head] = own_size, pool.n_ids + np.cumsum(own_size) - own_size
        size = size.astype(np.int64)
        stop = np.cumsum(size)
        ids = np.concatenate([pool.ids[: pool.n_ids], np.fromiter(chain.from_iterable(own), np.uint32, int(own_size.sum()))])
        place = np.repeat(start - (stop - size), size)
        place += np.arange(len(place))
        return (np.add.reduceat(size, head) if len(head) else size[:0]), ids[place]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of rows of at most ``most`` bytes of text each; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            yield first, k - first
            first, held = k, 0
        held += n
    if sizes:
        yield first, len(sizes) - first


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SCHEMA = "doc_id {kind}, part int, row long, n_tokens long, tokens array<int>"


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = END_ID,
    doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Encode every whole text and write the ids in ascending doc_id order.

    Rows are dealt by range of doc_id (nulls first) and sorted; part numbers
    follow the ranges, row numbers the order within.  Each file has small row
    groups with column and page indexes; ids are dictionary encoded while the
    dictionary is small and delta encoded beyond.  A null text is an empty one;
    repeated rows are written as often as they come; rows of one doc_id come in
    any order.  An empty table writes an empty table.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Batches) -> Batches:
        own = vocabulary or default_vocabulary()
        encoder = worker_cache("encoder_" + own, lambda: Encoder(own))
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for first, length in slices(whole.column("text"), SLICE_BYTES):
                batch = whole.slice(first, length)
                sizes, ids = encoder(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(row, row + n)), pa.array(sizes), list_array(sizes, ids, pa.int32()),
                    ],
                    names=["doc_id", "part", "row", "n_tokens", "tokens"],
                )
                row += n

    ordered = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )
    (
        ordered.mapInArrow(encode, SCHEMA.format(kind=kind))
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("compression", "zstd")
        .parquet(path)
    )


def with_starts(files: DataFrame, thin: DataFrame | None = None) -> DataFrame:
    """``thin`` (or the files' own thin columns) with ``start``: ids written before each document.

    Reads no ids: totals of the parts (one row each) are carried forward and
    added to the running sum within the part.
    """
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    within = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    out = (files.drop("tokens") if thin is None else thin).withColumn(
        "start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    )
    return out.join(parts, "part").withColumn("start", F.col("start") + F.col("_base")).drop("_base", "part", "row")


def _crc(batches: Batches) -> Batches:
    for batch in batches:
        lists = batch.column("tokens")
        flat = np.ascontiguousarray(lists.values.to_numpy(), "<u4")
        ends = lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "part", "row", "n_tokens")), pa.array(crcs, pa.int64())],
            names=["doc_id", "part", "row", "n_tokens", "ids_crc32"],
        )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_id"].dataType.simpleString()
    thin = files.mapInArrow(_crc, f"doc_id {kind}, part int, row long, n_tokens long, ids_crc32 long")
    return with_starts(files, thin).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_token_files")
def token_files(spark, sf_dir):
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
