"""Places where a user's own Python function runs inside Spark tasks, in Arrow batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashed_words(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """Stand-in embedding: signed counts of hashed words, scaled to unit length."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.casefold().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % size] += 1.0 if (h >> 32) & 1 else -1.0
        length = math.sqrt(sum(x * x for x in v))
        if length == 0:
            v[0] = length = 1.0
        out.append([x / length for x in v])
    return out


def _slices(part: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """A frame in pieces, so that what is made of one leaves before the next is made."""
    for i in range(0, len(part), rows):
        yield part.iloc[i : i + rows]


def embed(df: DataFrame, col: str, make: Callable[[], EmbedFn], batch: int = 64, out: str = "embedding") -> DataFrame:
    """Add vectors.  ``make`` is called once per task and returns the embedding function."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make()
        for part in parts:
            for few in _slices(part, batch):
                vectors = list(fn(few[col].tolist()))
                if len(vectors) != len(few):
                    raise RuntimeError("the embedding function must give one vector per text")
                yield few.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def assess(
    df: DataFrame, fn: Callable[[dict], list[dict]], schema: str, attempts: int = 2, chunk: int = 64
) -> DataFrame:
    """Run a user's assessment of each article; failures become rows with an error, not a lost job.

    ``fn`` takes one row as a dict and returns rows of ``schema``; the columns
    ``attempts`` and ``error_type`` are added.  The answers of ``chunk`` articles
    at a time leave the task.
    """
    full = T.StructType.fromDDL(f"{schema}, attempts int, error_type string")
    names = full.fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for few in (f for part in parts for f in _slices(part, chunk)):
            rows: list[dict] = []
            for item in few.to_dict("records"):
                error, tried = None, 0
                while tried < attempts:
                    tried += 1
                    try:
                        got = fn(item)
                        rows += [{**g, "attempts": tried, "error_type": None} for g in got]
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = type(e).__name__
                if error:
                    known = {k: item[k] for k in names if k in item}
                    rows.append({**known, "attempts": tried, "error_type": error})
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, full)


def summarise(
    df: DataFrame, fn: Callable[[list[dict]], list[str]], key: str = "article_id", chunk: int = 10
) -> DataFrame:
    """Add ``summary_text`` from a user's function over chunks of rows.

    If the call fails, or does not cover the chunk, the whole chunk keeps its
    ``fallback_text`` and ``summary_status`` says so.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("summary_text", T.StringType()),
         T.StructField("summary_status", T.StringType())]
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, states = [], []
            for i in range(0, len(part), chunk):
                rows = part.iloc[i : i + chunk].to_dict("records")
                try:
                    got = list(fn(rows))
                    if len(got) != len(rows) or not all(isinstance(g, str) and g.strip() for g in got):
                        raise ValueError("summaries must cover the chunk")
                    texts += got
                    states += ["completed"] * len(rows)
                except Exception:  # noqa: BLE001
                    texts += [r["fallback_text"] for r in rows]
                    states += ["fallback"] * len(rows)
            yield part.assign(summary_text=texts, summary_status=states)

    return df.mapInPandas(run, schema)


def neutral_signals() -> tuple:
    """Journal and recency signal columns of an article when no provider is given."""
    return F.lit(5.0), F.lit(5.0)
