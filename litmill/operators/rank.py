"""Candidate scoring, coarse filtering, ranking and the audited selection decision."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from litmill import scale
from litmill.functions import dates, values
from litmill.operators.rubrics import STUDY_TYPES
from litmill.operators.search import Concept, has_phrase, padded

# Concept weights, core kinds, scores of a hit and parts of the total.
KIND_WEIGHTS = {"drug": 0.45, "intervention": 0.45, "population": 0.30, "outcome": 0.25}
CORE_KINDS = ("drug", "intervention")
TITLE_HIT, ABSTRACT_HIT = 100.0, 70.0
SCORE_WEIGHTS = {"keyword": 0.50, "semantic": 0.40, "recency": 0.10}
# The reasons shown with a candidate.
REASON_CORE = "命中核心干预或药物术语"
REASON_MATCH = "关键词命中："
REASON_DATE = "已纳入发表时间近似分数"
REASON_NO_DATE = "发表时间缺失，使用中性分"


def concept_score(concept: Concept, title: Column, abstract: Column) -> Column:
    """100 for a hit in the title, 70 in the abstract, else 0 (padded match texts)."""
    return (
        F.when(has_phrase(title, concept.terms), F.lit(TITLE_HIT))
        .when(has_phrase(abstract, concept.terms), F.lit(ABSTRACT_HIT))
        .otherwise(F.lit(0.0))
    )


def keyword_score(profile: Sequence[Concept], scores: Sequence[Column]) -> Column:
    """Weighted mean over concepts of a weighted kind; the others blend in at ten per cent."""
    weighted = [(KIND_WEIGHTS[c.kind], s) for c, s in zip(profile, scores) if c.kind in KIND_WEIGHTS]
    others = [s for c, s in zip(profile, scores) if c.kind not in KIND_WEIGHTS]
    rest = sum(others, F.lit(0.0)) / F.lit(float(len(others))) if others else None
    if not weighted:
        return rest if rest is not None else F.lit(0.0)
    total = sum(w for w, _ in weighted)
    base = sum((F.lit(w) * s for w, s in weighted), F.lit(0.0)) / F.lit(total)
    return base if rest is None else F.lit(0.9) * base + F.lit(0.1) * rest


def core_match(profile: Sequence[Concept], scores: Sequence[Column]) -> Column:
    """Whether all drug and intervention concepts match; true if there are none."""
    core = F.lit(True)
    for c, s in zip(profile, scores):
        if c.kind in CORE_KINDS:
            core = core & (s > 0)
    return core


def match_concepts(
    articles: DataFrame, profile: Sequence[Concept], title: Column, abstract: Column
) -> DataFrame:
    """Add keyword_score, core_matched and matched_concepts.

    ``title`` and ``abstract`` are in match-text form.  The profile is part of
    the expression: no join and no shuffle, the corpus is only mapped.
    """
    if not profile:
        raise ValueError("a research profile needs at least one concept")
    out = articles.withColumn("_t", padded(F.coalesce(title, F.lit("")))).withColumn(
        "_a", padded(F.coalesce(abstract, F.lit("")))
    )
    for i, c in enumerate(profile):
        out = out.withColumn(f"_s{i}", concept_score(c, F.col("_t"), F.col("_a")))
    scores = [F.col(f"_s{i}") for i in range(len(profile))]
    matched = F.array_compact(
        F.array(*[F.when(s > 0, F.lit(c.label)) for c, s in zip(profile, scores)])
    )
    return out.select(
        *articles.columns,
        keyword_score(profile, scores).alias("keyword_score"),
        core_match(profile, scores).alias("core_matched"),
        matched.alias("matched_concepts"),
    )


def coarse_filter(
    df: DataFrame, low: int | None = None, high: int = 400, keep: int = 200, floor: int = 50, key: str = "article_id"
) -> DataFrame:
    """Cheap cut before vectors are scored: all rows with ``coarse_status``, passed or below_coarse_cut.

    Without ``low`` nothing is cut.  Up to ``low`` rows all pass; beyond ``high`` the best ``keep`` pass; between,
    rows with a core and a keyword hit, falling back to keyword hits and then to
    the best ``keep`` when fewer than ``floor`` are left.  Ties go to the greater
    id.  Needs keyword_score, recency_score, core_matched and publication_year;
    stage an expensive input first, it is read three times.
    """
    hit = F.col("keyword_score") > 0
    if low is None:
        return df.withColumn("coarse_status", F.lit("passed"))
    coarse = F.lit(0.85) * F.col("keyword_score") + F.lit(0.15) * F.col("recency_score")
    scored = df.withColumn("coarse_score", coarse)
    stats = scored.agg(
        F.struct(
            F.count("*").alias("total"),
            F.count_if(F.col("core_matched") & hit).alias("both"),
            F.count_if(hit).alias("hits"),
        )
    ).scalar()
    best = (
        scored.orderBy(
            F.desc("core_matched"), F.desc(hit), F.desc("coarse_score"),
            F.desc(F.coalesce("publication_year", F.lit(0))), F.desc(key),
        )
        .limit(keep)
        .select(key, F.lit(True).alias("_best"))
    )
    # At most ``keep`` rows, so the side is bounded by the parameter.
    marked = scored.join(F.broadcast(best), key, "left").withColumn("_c", stats)
    total, both, hits = (F.col(f"_c.{n}") for n in ("total", "both", "hits"))
    need = F.least(F.lit(floor), total)
    in_best = F.coalesce("_best", F.lit(False))
    passes = (
        F.when(total <= low, F.lit(True))
        .when(total > high, in_best)
        .when(both >= need, F.col("core_matched") & hit)
        .when(hits >= need, hit)
        .otherwise(in_best)
    )
    status = F.when(passes, F.lit("passed")).otherwise(F.lit("below_coarse_cut"))
    return marked.withColumn("coarse_status", status).drop("_best", "_c", "coarse_score")


def candidate_score(df: DataFrame, cosine: Column, reference: dt.date | None = None) -> DataFrame:
    """Add semantic_score and candidate_score (keyword .50, semantic .40, recency .10)."""
    if reference is not None:
        df = df.withColumn(
            "recency_score",
            dates.recency(F.col("publication_date"), F.col("publication_year"), reference),
        )
    w = SCORE_WEIGHTS
    return (
        df.withColumn("cosine", cosine)
        .withColumn("semantic_score", values.similarity_score(F.col("cosine")))
        .withColumn(
            "candidate_score",
            F.lit(w["keyword"]) * F.col("keyword_score")
            + F.lit(w["semantic"]) * F.col("semantic_score")
            + F.lit(w["recency"]) * F.col("recency_score"),
        )
    )


def selection_reasons(core: Column, matched: Column, date: Column, year: Column) -> Column:
    """Labels that say why an article scored as it did."""
    dated = date.isNotNull() | year.isNotNull()
    return F.array_compact(
        F.array(
            F.when(core, F.lit(REASON_CORE)),
            F.when(F.size(matched) > 0, F.concat(F.lit(REASON_MATCH), F.array_join(matched, "、"))),
            F.when(dated, F.lit(REASON_DATE)).otherwise(F.lit(REASON_NO_DATE)),
        )
    )


def rank_order(key: str = "article_id") -> list[Column]:
    return [F.desc("candidate_score"), F.desc("core_matched"), F.asc(key)]


def rank(df: DataFrame, key: str = "article_id") -> DataFrame:
    """Number all rows: score descending, core matches first, id ascending."""
    return scale.running_sum(df, [], rank_order(key), name="selection_rank")


def nearest(vectors: DataFrame, query: Sequence[float], k: int, key: str, vec: str) -> DataFrame:
    """The k vectors most like the query, numbered."""
    top = (
        vectors.select(key, values.cosine_to(F.col(vec), query).alias("cosine"))
        .orderBy(F.desc("cosine"), F.asc(key))
        .limit(k)
    )
    # k rows at most reach this window.
    return top.withColumn(
        "position", F.row_number().over(W.orderBy(F.desc("cosine"), F.asc(key)))
    )


def nearest_many(
    vectors: DataFrame, queries: DataFrame, k: int, key: str, vec: str, query_key: str = "query_id", block: int = 1024,
    piece: int = 2048,
) -> DataFrame:
    """(query_key, key, cosine, position): the k vectors most like each query, all vectors compared with all queries.

    Queries go to the tasks in blocks of ``block`` rows.  A task multiplies its
    vectors, ``piece`` rows at a time, with the block and keeps k rows for each query,
    so what leaves it is bounded, and no pair becomes a row.  Cosines are
    rounded to nine digits before they are ranked; ties go to the lesser key.
    Rows without a vector take no part.
    """
    spark = vectors.sparkSession
    asked = scale.running_sum(queries.filter(F.col(vec).isNotNull()).select(query_key, vec), [], [F.asc(query_key)], name="_n")
    asked = scale.stage(asked.withColumn("_block", F.expr(f"(_n - 1) div {block}")), "queries")
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query_key, queries), (key, vectors))}
    blocks = [r[0] for r in asked.select("_block").distinct().collect()]
    passes = []
    for b in sorted(blocks):
        rows = asked.filter(F.col("_block") == b).orderBy("_n").select(query_key, vec).collect()
        unit = values.unit_rows([r[1] for r in rows])
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], unit))

        def run(batches, sent=sent):
            import pyarrow as pa

            names, unit = sent.value
            best = values.Nearest(len(names), k)
            for batch in batches:
                held = batch.filter(batch.column(vec).is_valid())
                for i in range(0, held.num_rows, piece):
                    few = held.slice(i, piece)
                    best.add(few.column(key).to_pylist(), values.unit_rows(few.column(vec).to_pylist()) @ unit.T)
            found = list(best.rows())
            if found:
                at, keys, cosine = zip(*found)
                yield pa.RecordBatch.from_pydict({query_key: [names[i] for i in at], key: keys, "cosine": cosine})

        passes.append(
            vectors.select(key, vec).mapInArrow(run, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, cosine double")
        )
    if not passes:
        return spark.createDataFrame([], f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, cosine double, position int")
    first = W.partitionBy(query_key).orderBy(F.desc("cosine"), F.asc(key))
    return reduce(DataFrame.unionByName, passes).withColumn("position", F.row_number().over(first)).filter(F.col("position") <= k)


def mark_first(
    df: DataFrame, admissible: Column, order: Sequence[Column], limit: int, key: str, name: str
) -> DataFrame:
    """Mark the first ``limit`` admissible rows: a bounded top-k, not a running count."""
    top = df.filter(admissible).orderBy(*order).limit(limit).select(key, F.lit(True).alias(name))
    return df.join(F.broadcast(top), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def decide(df: DataFrame, limit: int | None = None, key: str = "article_id") -> DataFrame:
    """Selection status of every row, with the reason of each exclusion; a row without a vector is never selected.

    Without ``limit`` all admissible rows are selected.
    """
    supported = F.coalesce(F.col("study_group").isin(*STUDY_TYPES), F.lit(False))
    scored = F.col("candidate_score").isNotNull()
    ok = F.col("core_matched") & supported & scored
    out = df.withColumn("_in", ok) if limit is None else mark_first(df, ok, rank_order(key), limit, key, "_in")
    reason = (
        F.when(~F.col("core_matched"), F.lit("core_intervention_not_matched"))
        .when(~supported, F.lit("unsupported_study_design"))
        .when(~scored, F.lit("no_vector"))
        .when(~F.col("_in"), F.lit("global_candidate_limit_reached"))
    )
    status = (
        F.when(~scored, F.lit("no_vector")).when(F.col("_in"), F.lit("selected")).otherwise(F.lit("not_selected"))
    )
    return out.withColumn("selection_status", status).withColumn(
        "exclusion_reason", reason
    ).drop("_in")


def selection_summary(decided: DataFrame) -> DataFrame:
    """One row of counts over a decided ranking."""
    why = F.col("exclusion_reason")
    by_type = decided.filter("selection_status = 'selected'").groupBy("study_group").count()
    packed = by_type.agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat_ws(":", "study_group", F.col("count").cast("string")))),
            ",",
        )
    )
    return decided.agg(
        F.count("*").alias("scored"),
        F.count_if(F.col("selection_status") == "selected").alias("selected"),
        F.count_if(why == "core_intervention_not_matched").alias("core_not_matched"),
        F.count_if(why == "unsupported_study_design").alias("unsupported_design"),
        F.count_if(why == "global_candidate_limit_reached").alias("limit_reached"),
    ).withColumn("selected_by_type", packed.scalar())
