"""Declared schemas of the main tables."""

from pyspark.sql import types as T

AUTHOR = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "full_name", "first_name", "last_name", "initials",
            "collective_name", "orcid", "source_author_id",
        )
    ]
)

RESOURCE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("original_style", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("availability", T.StringType()),
        T.StructField("availability_code", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("is_open_access", T.BooleanType()),
        T.StructField("is_downloadable", T.BooleanType()),
        T.StructField("suggested_file_name", T.StringType()),
    ]
)

_STR, _INT, _BOOL = T.StringType(), T.IntegerType(), T.BooleanType()

# One bibliographic record before duplicates are resolved.
RECORD = T.StructType(
    [
        T.StructField("source", _STR),
        T.StructField("source_record_id", _STR),
        T.StructField("source_article_id", _STR),
        T.StructField("source_rank", _INT),
        T.StructField("search_run_id", _STR),
        T.StructField("doi", _STR),
        T.StructField("pmid", _STR),
        T.StructField("pmcid", _STR),
        T.StructField("title", _STR),
        T.StructField("normalized_title", _STR),
        T.StructField("abstract", _STR),
        T.StructField("abstract_available", _BOOL),
        T.StructField("authors", T.ArrayType(AUTHOR)),
        T.StructField("first_author", _STR),
        T.StructField("journal_title", _STR),
        T.StructField("journal_abbreviation", _STR),
        T.StructField("issn", _STR),
        T.StructField("electronic_issn", _STR),
        T.StructField("publication_date", _STR),
        T.StructField("publication_year", _INT),
        T.StructField("publication_types", T.ArrayType(_STR)),
        T.StructField("study_design", _STR),
        T.StructField("publication_status", _STR),
        T.StructField("language", _STR),
        T.StructField("keywords", T.ArrayType(_STR)),
        T.StructField("peer_review_status", _STR),
        T.StructField("preprint_server", _STR),
        T.StructField("preprint_version", _INT),
        T.StructField("published_doi", _STR),
        T.StructField("is_open_access", _BOOL),
        T.StructField("has_full_text", _BOOL),
        T.StructField("can_download_full_text", _BOOL),
        T.StructField("license", _STR),
        T.StructField("full_text_resources", T.ArrayType(RESOURCE)),
        T.StructField("citation_count", _INT),
        T.StructField("is_retracted", _BOOL),
        T.StructField("landing_url", _STR),
        T.StructField("retrieved_at", T.TimestampType()),
    ]
)
