"""Hashes, vectors, casts and JSON helpers."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words taken for yes and no.
YES = ("y", "yes", "true", "1")
NO = ("n", "no", "false", "0")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def short_sha1(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(c), 1, length)


def canonical_json(*names: str) -> Column:
    """JSON with the fields in name order and nulls kept."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def payload_hash(*names: str) -> Column:
    return sha256(canonical_json(*names))


def named_uuid(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5: SHA-1 of namespace and name with the version bits set."""
    digest = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(variant.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; an empty, ragged or zero vector raises."""
    bad = (F.size(a) != F.size(b)) | (F.size(a) < 1)
    length = norm(a) * norm(b)
    value = dot(a, b) / length
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(bad, F.raise_error(F.lit("vectors must be filled and of one size")))
        .when(length == 0, F.raise_error(F.lit("a vector must not be zero")))
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    )


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine against one constant vector (its norm is worked out once, on the driver)."""
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    if length == 0:
        raise ValueError("the query vector must be filled and not zero")
    q = F.array(*[F.lit(float(x)) for x in query])
    own = norm(a)
    value = dot(a, q) / (own * F.lit(length))
    return (
        F.when(a.isNull(), F.lit(None).cast("double"))
        .when(F.size(a) != len(query), F.raise_error(F.lit("vectors must be of one size")))
        .when(own == 0, F.raise_error(F.lit("a vector must not be zero")))
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    )


def similarity_score(cos: Column) -> Column:
    """Cosine mapped to 0..100."""
    return (cos + F.lit(1.0)) / F.lit(2.0) * F.lit(100.0)


def to_bool(c: Column) -> Column:
    """Yes and no words to a tri-state flag."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*YES), F.lit(True)).when(s.isin(*NO), F.lit(False))


def to_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("int")


# Fixed value: what a masked system text is replaced by.
MASK = "[已省略内部 system prompt]"


def without_system_text(messages: Column) -> Column:
    """Messages with the content of system turns masked."""
    return F.transform(
        messages,
        lambda m: F.when(m["role"] == "system", m.withField("content", F.lit(MASK))).otherwise(m),
    )


def unit_rows(vectors: list) -> np.ndarray:
    """Rows of unit length in doubles; a zero vector stays zero."""
    m = np.asarray(vectors, np.float64)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class Nearest:
    """The k keys with the greatest scores of each query so far; ties go to the lesser key."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.best = k, [[] for _ in range(queries)]

    def add(self, keys: list, scores: np.ndarray) -> None:
        """Take in a batch: ``scores`` has a row for each key and a column for each query."""
        scores = np.round(scores, 9) + 0.0
        place = min(self.k, len(keys)) - 1
        least = -np.partition(-scores, place, axis=0)[place]
        for q, held in enumerate(self.best):
            # All that tie with the last one are taken, so that keys decide.
            rows = np.flatnonzero(scores[:, q] >= least[q])
            held += [(-float(scores[i, q]), keys[i]) for i in rows]
            held.sort()
            del held[self.k :]

    def rows(self):
        for q, held in enumerate(self.best):
            for score, key in held:
                yield q, key, -score


def rounded(c: Column, digits: int) -> Column:
    """``c`` to so many digits by its scaled binary value, as the SQL twins round it.

    Spark's own ``round`` goes by the decimal notation of ``c``, which differs where the next digit is a 5.
    """
    scale = float(10**digits)
    return F.round(c * scale) / scale
