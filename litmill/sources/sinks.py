"""Writers.  Each returns what it wrote, read back, unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from litmill import scale
from litmill.functions import values
from litmill.operators import store as store_ops
from litmill.operators.ordering import next_sequence, source_rank


def _written(df: DataFrame, path: str, mode: str = "append", by: str | None = None) -> DataFrame:
    out = df.write.mode(mode)
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_provenance(raw: DataFrame, records: DataFrame, path: str, pos: str = "pos") -> DataFrame:
    """Every raw record once per (run, source id), with rank, payload hash and outcome.

    Repeats are settled on thin columns; payloads join back on the unique position.
    """
    keys = ["search_run_id", "source_record_id"]
    kept = raw.groupBy(*keys).agg(F.min(pos).alias(pos))
    ranked = source_rank(kept, "search_run_id", pos)
    thin = store_ops.provenance_outcome(ranked, records)
    payload = [c for c in raw.columns if c not in keys]
    rows = raw.withColumn("payload", values.canonical_json(*sorted(set(raw.columns) - {pos})))
    rows = rows.select(pos, "source", "payload").withColumn("payload_hash", F.sha2("payload", 256))
    assert payload
    return _written(thin.join(rows, pos), path, by="source")


def write_runs(requested: DataFrame, results: DataFrame, path: str) -> DataFrame:
    return _written(store_ops.run_ledger(requested, results), path)


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """A complete table snapshot under a new path."""
    return _written(df, path, mode="error")


def put_embeddings(store_path: str, new: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Add vectors of unseen keys as the batch folder of the given name; stored ones are left alone.

    The store is a folder of ``batch=`` folders.  A retry of a batch compares
    with the other batches only and replaces its own folder, so a half-written
    one does no harm.
    """
    spark = new.sparkSession
    others = spark.read.parquet(store_path).filter(F.col("batch").cast("string") != batch)
    fresh = store_ops.put_if_absent(others, store_ops.checked_vectors(new), keys)
    fresh = scale.stage(fresh.select(*[c for c in others.columns if c != "batch"]), "new-vectors")
    fresh.write.mode("overwrite").parquet(f"{store_path}/batch={batch}")
    return spark.read.parquet(store_path)


def register_plan(store: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Stored batches and the planned ones not stored yet."""
    return store.unionByName(store_ops.put_if_absent(store, plan, keys), allowMissingColumns=True)


def write_ranking_audit(ranked: DataFrame, summary: DataFrame, path: str) -> tuple[str, str, str | None]:
    """Full ranking and summary as JSON; (status, path, error), a failed write never raises."""
    try:
        ranked.write.mode("error").json(f"{path}/ranking")
        summary.write.mode("error").json(f"{path}/summary")
    except (AnalysisException, OSError) as e:
        return "failed", path, type(e).__name__
    except Exception as e:  # noqa: BLE001  - the sink must not take the job down
        return "failed", path, type(e).__name__
    return "written", path, None


def write_summary(recommendations: DataFrame, path: str, task: Column, day: str) -> DataFrame:
    """One JSON document per task and row, replacing the task's partition."""
    packed = recommendations.select(
        task.alias("task_id"), F.to_json(F.struct("*")).alias("document"), F.lit(day).alias("day")
    )
    packed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "task_id"
    ).parquet(path)
    return recommendations.sparkSession.read.parquet(path)


def append_messages(store: DataFrame, conversations: DataFrame, new: DataFrame) -> DataFrame:
    """New messages numbered on from the stored ones; unknown conversations are left out.

    The preview is the first 160 characters.
    """
    known = new.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    rows = next_sequence(store, known, "conv_id", [F.asc("turn")])
    return rows.withColumn("preview", F.substring("text", 1, 160))


def write_bench(report: DataFrame, path: str) -> None:
    """Stage timings and failures as JSON."""
    report.coalesce(1).write.mode("error").json(path)
