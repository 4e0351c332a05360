"""Concept matching, boolean concept search, constraints and search options."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill import scale
from litmill.functions import exact, text

# Sources a question is sent to, why, and the words that ask for full text.
FULL_TEXT_WORDS = ("全文", "full text", "full-text", "open access", "开放获取", "全文解析")
SOURCE_REASONS = {
    "pubmed": "医学题录和临床研究的核心来源",
    "europe_pmc": "补充生命科学题录和全文资源",
    "pmc": "用户明确需要开放全文或全文解析",
    "semantic_scholar": "研究方向较宽或跨学科，增加语义检索补充召回",
}


@dataclass(frozen=True)
class Concept:
    """One concept of a research question and the terms that stand for it."""

    kind: str
    label: str
    terms: tuple[str, ...]


BITS = 60  # groups of a query in one number


def padded(c: Column) -> Column:
    """Normalised text with a blank at either end, so that phrases match on word borders."""
    return F.concat(F.lit(" "), c, F.lit(" "))


def has_phrase(body: Column, terms: Sequence[str]) -> Column:
    """Whether any (raw) term occurs on word borders in a padded normalised text."""
    wanted = [t for t in dict.fromkeys(exact.fold_words(t) for t in terms) if t]
    found = F.lit(False)
    for t in wanted:
        found = found | body.contains(f" {t} ")
    return F.coalesce(found, F.lit(False))


def phrase_match(
    docs: DataFrame,
    terms: DataFrame,
    doc_key: str,
    fields: Sequence[str],
    max_words: int | None = None,
    any_field: bool = False,
) -> DataFrame:
    """(doc, field, term columns): which normalised terms occur in which field of which document.

    With ``any_field`` the field is left out and each (doc, term) comes once.
    ``terms`` needs a ``term`` column in match-text form; terms of more than
    ``max_words`` words are left out.  ``doc_key`` is unique.

    A term is looked for by one word, or by two neighbouring words of a longer
    one (its longest pair, which seldom is a common one).  Documents give their
    distinct words and pairs, without their texts, and these meet the terms'
    in an equality join, whatever the length of the terms.  That settles terms
    of one or two words; for longer ones the texts of the documents found join
    back and are searched in place.
    """
    terms = scale.stage(terms, "terms")  # written once, the terms have a real size
    n_words = F.size(F.split("term", " "))
    if max_words is not None:
        terms = terms.filter(n_words <= max_words)
    key = F.reduce(_runs("term", 2), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    # Each distinct term is looked for once, however many rows of ``terms`` have it.
    anchors = terms.select(
        "term", F.when(n_words > 1, key).otherwise(F.col("term")).alias("_run"), (n_words > 2).alias("_long")
    ).distinct()
    used = terms.agg(F.bool_or(n_words == 1), F.bool_or(n_words > 1)).first()
    lengths = [n for n, yes in zip((1, 2), used) if yes] or [1]
    runs = lambda fs: F.array_distinct(F.concat(*[_runs(f, n) for f in fs for n in lengths]))
    if any_field:
        held, keys = docs.select(doc_key, F.explode(runs(fields)).alias("_run")), [doc_key]
    else:
        parts = [docs.select(doc_key, F.lit(f).alias("field"), F.explode(runs([f])).alias("_run")) for f in fields]
        held, keys = reduce(DataFrame.unionByName, parts), [doc_key, "field"]
    met = scale.stage(held.join(anchors, "_run").select(*keys, "term", "_long"), "anchored")
    if any_field:
        body = reduce(lambda a, b: a | b, (F.contains(padded(F.col(f)), _spaced("term")) for f in fields))
    else:
        body = reduce(
            lambda a, f: F.when(F.col("field") == f, F.contains(padded(F.col(f)), _spaced("term"))).otherwise(a), fields, F.lit(False)
        )
    searched = met.filter("_long").join(docs.select(doc_key, *fields), doc_key).filter(F.coalesce(body, F.lit(False)))
    hits = met.filter("not _long").select(*keys, "term").unionByName(searched.select(*keys, "term"))
    return hits.join(terms, "term")


def _runs(field: str, n: int) -> Column:
    """Single words, or pairs of neighbouring words, of a normalised text; none for null."""
    words = F.split(F.coalesce(F.col(field), F.lit("")), " ")
    if n == 1:
        return words
    after = F.slice(words, 2, F.size(words))
    # The last word has none after it; its pair is null.
    return F.array_compact(F.zip_with(words, after, lambda a, b: F.concat(a, F.lit(" "), b)))


def _spaced(term: str) -> Column:
    return F.concat(F.lit(" "), F.col(term), F.lit(" "))


def concept_search(
    docs: DataFrame, plan: DataFrame, doc_key: str, fields: Sequence[str], mode: str = "all"
) -> DataFrame:
    """(query_id, doc): any term of a group may match, every group of a query must.

    ``plan`` holds query_id, group_id, term and term_order; ``mode`` is "all"
    or "representative" (only the first term of each group counts).
    """
    if mode not in ("all", "representative"):
        raise ValueError("mode is all or representative")
    if mode == "representative":
        plan = plan.groupBy("query_id", "group_id").agg(F.min_by("term", "term_order").alias("term"))
    # Groups are numbered within their query; a bit for each says which ones a document meets.
    numbered = plan.select("query_id", "group_id").distinct().withColumn(
        "_at", F.row_number().over(W.partitionBy("query_id").orderBy("group_id")) - 1
    )
    numbered = scale.stage(numbered, "groups")
    most = numbered.agg(F.max("_at")).first()[0] or 0
    bits = [f"_bits{k}" for k in range(most // BITS + 1)]
    mask = [
        F.when(F.floor(F.col("_at") / BITS) == k, F.expr(f"shiftleft(1L, cast(_at % {BITS} as int))")).otherwise(F.lit(0).cast("long")).alias(b)
        for k, b in enumerate(bits)
    ]
    # A term that several groups of a query share is one row of theirs.
    terms = plan.select("query_id", "group_id", "term").distinct().join(numbered, ["query_id", "group_id"]).select(
        "query_id", "term", *mask
    ).groupBy("query_id", "term").agg(*[F.bit_or(b).alias(b) for b in bits])
    need = numbered.select("query_id", *mask).groupBy("query_id").agg(*[F.bit_or(b).alias(f"_need{b}") for b in bits])
    hits = phrase_match(docs, terms, doc_key, fields, any_field=True)
    met = hits.groupBy("query_id", doc_key).agg(*[F.bit_or(b).alias(b) for b in bits]).join(need, "query_id")
    whole = reduce(lambda a, b: a & b, (F.col(b) == F.col(f"_need{b}") for b in bits))
    return met.filter(whole).select("query_id", doc_key)


def design_values(design: Column, types: Column, body: Column) -> Column:
    """Constraint values a document satisfies."""
    cohort = F.coalesce(design == "cohort", F.lit(False))
    observational = F.exists(
        F.coalesce(types, F.array().cast("array<string>")),
        lambda t: F.lower(t).isin("observational study", "observational studies"),
    )
    return F.array_compact(
        F.array(
            F.when(design == "randomized_controlled_trial", F.lit("randomized_controlled_trial")),
            F.when(cohort, F.lit("cohort")),
            F.when(cohort & padded(body).contains(" prospective "), F.lit("prospective_cohort")),
            F.when(observational, F.lit("observational_study")),
        )
    )


# Study design constraints that can be applied.
DESIGN_CONSTRAINTS = (
    "randomized_controlled_trial", "prospective_cohort", "cohort", "observational_study",
)


def apply_constraints(
    found: DataFrame,
    docs: DataFrame,
    constraints: DataFrame,
    doc_key: str,
    prefer: str = "filter",
    strict: bool = False,
) -> DataFrame:
    """Keep (query_id, doc) pairs whose document meets the query's design constraints.

    Every include value must hold and no exclude value may.  "prefer" works as
    include by default; with ``prefer="boost"`` it only adds a ``boost`` column
    to sort by.  Other constraint kinds are ignored; an unknown design value
    drops the query's results, or raises with ``strict``.  ``docs`` holds the
    document key and ``design_values``.
    """
    if prefer not in ("filter", "boost"):
        raise ValueError("prefer is filter or boost")
    rules = constraints.filter(F.col("kind") == "study_design")
    hard = ("include", "prefer") if prefer == "filter" else ("include",)
    unknown = ~F.col("value").isin(*DESIGN_CONSTRAINTS)

    def values(*ops: str) -> Column:
        return F.collect_set(F.when(F.col("operator").isin(*ops), F.col("value")))

    per_query = rules.groupBy("query_id").agg(
        values(*hard).alias("_must"),
        values("exclude").alias("_not"),
        values("prefer").alias("_like"),
        F.bool_or(unknown).alias("_unknown"),
    )
    if strict:
        per_query = per_query.withColumn(
            "_unknown",
            F.when(F.col("_unknown"), F.raise_error(F.lit("unknown study design constraint")))
            .otherwise(F.lit(False)),
        )
    pairs = found.join(per_query, ["query_id"], "left")
    pairs = pairs.join(docs.select(doc_key, "design_values"), [doc_key], "inner")
    none = F.array().cast("array<string>")
    must, never, like = (F.coalesce(c, none) for c in ("_must", "_not", "_like"))
    keep = (
        (F.size(F.array_except(must, "design_values")) == 0)
        & ~F.coalesce(F.arrays_overlap(never, "design_values"), F.lit(False))
        & ~F.coalesce("_unknown", F.lit(False))
    )
    out = pairs.filter(keep)
    if prefer == "boost":
        return out.select(
            *found.columns,
            F.coalesce(F.arrays_overlap(like, "design_values"), F.lit(False)).alias("boost"),
        )
    return out.select(*found.columns)


def search_options(
    df: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    open_access_only: bool = False,
    order: str | None = None,
    tie: str = "record_id",
) -> DataFrame:
    """Publication date range (either end open), open access only, relevance or newest order."""
    if start and end and start > end:
        raise ValueError("start must not be after end")
    if start:
        df = df.filter(F.col("publication_date") >= F.lit(start))
    if end:
        df = df.filter(F.col("publication_date") <= F.lit(end))
    if open_access_only:
        df = df.filter(F.col("is_open_access"))
    if order == "newest":
        return df.orderBy(F.desc_nulls_last("publication_date"), tie)
    if order == "relevance":
        return df.orderBy(F.desc("score"), tie)
    if order is not None:
        raise ValueError("order is newest or relevance")
    return df


def select_sources(
    questions: DataFrame,
    available: Sequence[str] = tuple(SOURCE_REASONS),
    strict: bool = False,
) -> DataFrame:
    """One row per question and chosen source, with the reason.

    ``questions`` holds ``query_id``, ``query`` and an array ``directions``.  A
    question left without any source gives one row with a null source, or
    raises with ``strict``.
    """
    folded = text.fold(F.col("query"))
    asks = F.lit(False)
    for w in FULL_TEXT_WORDS:
        asks = asks | folded.contains(w)
    broad = F.coalesce(F.array_contains("directions", "other"), F.lit(False))
    when = {"pubmed": F.lit(True), "europe_pmc": F.lit(True), "pmc": asks, "semantic_scholar": broad}
    picks = [
        F.when(
            when[s],
            F.struct(F.lit(i).alias("place"), F.lit(s).alias("source"), F.lit(r).alias("reason")),
        )
        for i, (s, r) in enumerate(SOURCE_REASONS.items(), 1)
        if s in set(available)
    ]
    if not picks:
        if strict:
            raise ValueError("no source is available")
        return questions.select(
            "query_id",
            F.lit(None).cast("int").alias("place"),
            F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("string").alias("reason"),
        )
    rows = questions.select("query_id", F.explode_outer(F.array_compact(F.array(*picks))).alias("s"))
    if strict:
        rows = rows.withColumn(
            "s", F.coalesce("s", F.raise_error(F.lit("no source is available")).cast(
                "struct<place:int,source:string,reason:string>"))
        )
    return rows.select("query_id", "s.place", "s.source", "s.reason")


def joint_cover(matches: DataFrame, groups: int) -> DataFrame:
    """One row: do single documents cover all concepts, or only all documents together?"""
    per_doc = matches.groupBy("doc_id").agg(F.count_distinct("group_id").alias("n"))
    joint = per_doc.agg(F.count_if(F.col("n") == groups).alias("covering_docs"))
    union = matches.agg(F.count_distinct("group_id").alias("covered"))
    return joint.select(
        "covering_docs",
        union.scalar().alias("covered_concepts"),
        F.when(F.col("covering_docs") > 0, F.lit("joint"))
        .when(union.scalar() == groups, F.lit("union_only"))
        .otherwise(F.lit("incomplete"))
        .alias("cover"),
    )


def concept_cover(required: DataFrame, covered: DataFrame) -> DataFrame:
    """(query_id, concept, required_rows, covered_rows, issue): exact cover without repeats."""
    a = required.groupBy("query_id", "concept").agg(F.count("*").alias("required_rows"))
    b = covered.groupBy("query_id", "concept").agg(F.count("*").alias("covered_rows"))
    both = a.join(b, ["query_id", "concept"], "full_outer").na.fill(
        0, ["required_rows", "covered_rows"]
    )
    issue = (
        F.when(F.col("covered_rows") == 0, F.lit("not_covered"))
        .when(F.col("required_rows") == 0, F.lit("not_required"))
        .when((F.col("covered_rows") > 1) | (F.col("required_rows") > 1), F.lit("repeated"))
    )
    return both.withColumn("issue", issue)
