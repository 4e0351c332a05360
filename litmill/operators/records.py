"""The unified record: provider projections, contract rules, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import exact, text
from litmill.operators.quality import codes, demand
from litmill.operators.routing import infer_design
from litmill.schemas import RECORD

# Internal stage -> public stage.
PUBLIC_STAGES = {
    "created": "created",
    "intent_recognized": "recognizing_intent",
    "mesh_normalized": "normalizing_terms",
    "search_plan_built": "building_search_plan",
    "search_sources_selected": "building_search_plan",
    "searching": "searching",
    "search_results_merged": "merging_results",
    "articles_grouped": "evaluating_evidence",
    "quality_evaluated": "evaluating_evidence",
    "quality_ranked": "evaluating_evidence",
    "completed": "completed",
    "summary_failed": "failed",
}
FORMATS = ("pdf", "epub", "html", "xml", "text", "other")
OPEN_CODES = ("oa", "f", "free")
CLOSED_CODES = ("s", "sub", "subscription")


def distinct_texts(c: Column) -> Column:
    """List of single-line texts without blanks and repeats (case-insensitive), order kept."""
    kept = text.first_of_each(c, text.collapse, text.list_key)
    return F.coalesce(kept, F.array().cast("array<string>"))


def public_stage(c: Column) -> Column:
    pairs = [F.lit(x) for kv in PUBLIC_STAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


# What each provider's rows lack (None) or fix (a constant) in the unified record.
PROVIDER_RULES: dict[str, dict[str, object]] = {
    "pubmed": {
        "study_design": None, "is_open_access": None, "can_download_full_text": False,
        "license": None, "full_text_resources": None, "citation_count": None,
    },
    "europe_pmc": {},
    "semantic_scholar": {
        "study_design": None, "journal_abbreviation": None, "issn": None,
        "electronic_issn": None, "publication_status": None, "language": None,
    },
    "pmc": {
        "study_design": None, "journal_abbreviation": None, "issn": None,
        "electronic_issn": None, "publication_status": None, "language": None,
        "keywords": None, "full_text_resources": None, "citation_count": None,
    },
    "preprint": {
        "pmid": None, "pmcid": None, "study_design": None, "publication_status": "preprint",
        "language": None, "is_open_access": None, "citation_count": None,
        "peer_review_status": "preprint",
    },
}


def unify(provider: str, rows: DataFrame, exact_text: bool = False, strict_meta: bool = False) -> DataFrame:
    """Provider rows in the unified record schema; columns a provider lacks become null.

    Rows whose title, ids or run are blank keep a null there; the contract rules
    report them.  ``exact_text`` uses full compatibility folding for titles.
    """
    fixed = PROVIDER_RULES[provider]
    have = set(rows.columns)

    def col(name: str) -> Column:
        if name in fixed:
            return F.lit(fixed[name])
        return F.col(name) if name in have else F.lit(None)

    def words(name: str) -> Column:
        return F.coalesce(col(name).cast("array<string>"), F.array().cast("array<string>"))

    def flag(name: str) -> Column:
        return F.coalesce(col(name).cast("boolean"), F.lit(False))

    title = text.single_line(col("title").cast("string"))
    abstract = text.multi_line(col("abstract").cast("string"))
    resources = F.coalesce(
        col("full_text_resources").cast(RECORD["full_text_resources"].dataType),
        F.array().cast(RECORD["full_text_resources"].dataType),
    )
    if provider in ("semantic_scholar", "preprint"):
        can_download = F.size(resources) > 0
    else:
        can_download = flag("can_download_full_text")
    built = {
        "doi": text.doi(col("doi").cast("string")),
        "pmid": text.pmid(col("pmid").cast("string")),
        "pmcid": text.pmcid(col("pmcid").cast("string")),
        "published_doi": text.doi(col("published_doi").cast("string")),
        "title": title,
        "normalized_title": exact.title_text(title) if exact_text else text.title_text(title),
        "abstract": abstract,
        "abstract_available": abstract.isNotNull(),
        "publication_types": distinct_texts(words("publication_types")),
        "keywords": distinct_texts(words("keywords")),
        "study_design": infer_design(
            words("publication_types"), col("study_design").cast("string"), abstract, strict_meta
        ),
        "peer_review_status": F.coalesce(col("peer_review_status").cast("string"), F.lit("unknown")),
        "has_full_text": flag("has_full_text"),
        "can_download_full_text": can_download,
        "is_retracted": flag("is_retracted"),
        "full_text_resources": resources,
        "landing_url": text.http_url(col("landing_url").cast("string")),
        "authors": F.coalesce(
            col("authors").cast(RECORD["authors"].dataType),
            F.array().cast(RECORD["authors"].dataType),
        ),
    }
    single = {
        "source_record_id", "source_article_id", "search_run_id", "first_author", "journal_title",
        "journal_abbreviation", "issn", "electronic_issn", "publication_date",
        "publication_status", "language", "license",
    }
    if provider != "preprint":
        built["source"] = F.lit(provider)
    out = []
    for f in RECORD.fields:
        c = built.get(f.name)
        if c is None:
            c = col(f.name).cast(f.dataType)
            if f.name in single:
                c = text.single_line(c)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def union_sources(*parts: DataFrame) -> DataFrame:
    """All branches one after another, repeats kept."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def validate_records(df: DataFrame, strict: bool = False) -> DataFrame:
    """Contract rules of the unified record as issue codes."""

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))

    def out_of(cond: Column) -> Column:
        return F.coalesce(~cond, F.lit(False))

    rules = [
        (blank("source_record_id"), "no_source_record_id"),
        (blank("search_run_id"), "no_search_run_id"),
        (blank("title"), "no_title"),
        (blank("normalized_title"), "no_normalized_title"),
        (out_of(F.col("publication_year").between(1500, 3000)), "year_range"),
        (out_of(F.col("source_rank") >= 1), "rank_range"),
        (out_of(F.col("citation_count") >= 0), "citation_range"),
        (out_of(F.col("preprint_version") >= 1), "version_range"),
        (
            F.coalesce(F.col("preprint_server") != "", F.lit(False))
            & ~F.col("peer_review_status").eqNullSafe("preprint"),
            "server_without_preprint",
        ),
    ]
    if "full_text_resources" in df.columns:
        any_file = F.exists("full_text_resources", lambda r: F.coalesce(r["is_downloadable"], F.lit(False)))
        rules.append(
            (F.col("can_download_full_text") & ~F.coalesce(any_file, F.lit(False)), "download_without_file")
        )
    return demand(df.withColumn("issues", codes(*rules)), strict)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, bad, runs): valid records, the others with codes, and per-run counts and status."""
    checked = validate_records(df)
    good = checked.filter(F.size("issues") == 0).drop("issues")
    bad = checked.filter(F.size("issues") > 0)
    runs = checked.groupBy("search_run_id").agg(
        F.count_if(F.size("issues") == 0).alias("retrieved_count"),
        F.count_if(F.size("issues") > 0).alias("invalid_count"),
    )
    status = F.when(F.col("invalid_count") > 0, F.lit("partial_success")).otherwise(
        F.lit("success_with_results")
    )
    return good, bad, runs.withColumn("status", status)


def sniff_format(style: Column, url: Column) -> Column:
    """Full-text format by the first matching token in style and URL path."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    hay = F.concat_ws(" ", F.lower(F.trim(F.coalesce(style, F.lit("")))), path)
    return (
        F.when(hay.contains("pdf"), "pdf")
        .when(hay.contains("epub"), "epub")
        .when(hay.contains("htm"), "html")
        .when(hay.contains("xml"), "xml")
        .when(hay.contains("text") | path.endswith(".txt"), "text")
        .otherwise("other")
    )


def resource_open_access(availability: Column, code: Column) -> Column:
    label = F.lower(F.trim(F.coalesce(availability, F.lit(""))))
    short = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    closed = F.lit(False)
    for w in ("subscription", "restricted", "closed"):
        closed = closed | label.contains(w)
    return F.when(
        short.isin(*OPEN_CODES) | label.contains("open access") | (label == "free"), F.lit(True)
    ).when(short.isin(*CLOSED_CODES) | closed, F.lit(False))


def resource_flags(df: DataFrame) -> DataFrame:
    """Landing rows dropped; format, open access and downloadable derived."""
    landing = F.lit(False)
    for c in ("original_style", "site"):
        landing = landing | F.coalesce(F.lower(F.trim(F.col(c))) == "doi", F.lit(False))
    rows = df.filter(~landing).filter(text.http_url(F.col("url"), need_host=True).isNotNull())
    rows = rows.withColumn("format", sniff_format(F.col("original_style"), F.col("url")))
    rows = rows.withColumn(
        "is_open_access", resource_open_access(F.col("availability"), F.col("availability_code"))
    )
    return rows.withColumn("is_downloadable", F.col("is_open_access"))


def intent_issues(df: DataFrame) -> DataFrame:
    """Recognised intents: chat carries nothing else, confidence range, list bounds."""
    chat = F.col("intent_category") == "simple_chat"
    filled = (F.size("directions") > 0) | (F.col("keyword_count") > 0) | (F.col("constraint_count") > 0)
    return df.withColumn(
        "issues",
        codes(
            (chat & filled, "chat_with_research_fields"),
            (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_range"),
            (F.size("directions") > 3, "too_many_directions"),
            (F.col("max_candidates") > 3, "too_many_candidates"),
        ),
    )


def result_issues(df: DataFrame) -> DataFrame:
    """Published documents: JSON text in ``summary``, the answer, and issue codes."""
    schema = (
        "overall_summary string, recommendations array<map<string,string>>, "
        "coverage_gaps array<string>, conflict_summary string"
    )
    parsed = df.withColumn("_p", F.from_json("summary", schema, {"mode": "PERMISSIVE"}))
    overall = F.trim(F.coalesce("_p.overall_summary", F.lit("")))
    message = F.trim(F.coalesce("last_message", F.lit("")))
    return (
        parsed.withColumn(
            "issues",
            codes(
                (F.trim(F.coalesce("query", F.lit(""))) == "", "no_query"),
                (F.coalesce(F.trim("summary"), F.lit("")) == "", "no_summary"),
                (overall == "", "no_overall_summary"),
            ),
        )
        .withColumn("answer", F.when(message != "", message).otherwise(text.null_if_empty(overall)))
        .withColumn("recommendation_count", F.size(F.coalesce("_p.recommendations", F.array())))
        .drop("_p")
    )

