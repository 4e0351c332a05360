"""Joins against, and merges into, the stored corpus.

Parquet has no MERGE, so every upsert builds the next snapshot of a table from
the stored one and the incoming rows; the caller writes it to a new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill import scale
from litmill.functions import dates, text
from litmill.operators import resolve
from litmill.operators import spans as span_ops
from litmill.operators.portfolio import format_rank

# Article fields that are filled when empty (the title never changes).
FILL_FIELDS = (
    "doi", "pmid", "pmcid", "abstract", "first_author", "journal_title", "journal_abbreviation",
    "issn", "electronic_issn", "publication_date", "publication_year", "study_design",
    "publication_status", "language",
)
FILL_LISTS = ("authors", "publication_types")
LONG_FIELDS = ("abstract",)
# Ways to recognise an article, best first.
WAYS = ("doi", "pmid", "pmcid", "title_year_author")


def provenance_outcome(raw: DataFrame, records: DataFrame) -> DataFrame:
    """Raw rows with success if a unified record came of them, else failed."""
    keys = ["search_run_id", "source_record_id"]
    done = records.select(*keys).distinct().withColumn("_ok", F.lit(True))
    rows = raw.join(done, keys, "left")
    status = F.when(F.col("_ok"), F.lit("success")).otherwise(F.lit("failed"))
    return rows.withColumn("normalization_status", status).drop("_ok")


def link_sources(records: DataFrame, source_rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Records with their provenance row and article; a record without provenance is an orphan."""
    keys = ["search_run_id", "source_record_id"]
    rows = records.join(source_rows, keys, "left").join(articles, keys, "left")
    return rows.withColumn("orphan", F.col("source_record_pk").isNull()).withColumn(
        "normalized_at", F.greatest("row_retrieved_at", "record_retrieved_at")
    )


def task_articles(
    runs: DataFrame, source_rows: DataFrame, articles: DataFrame, task_ids: Sequence | None = None
) -> DataFrame:
    """Distinct articles of each task, through its runs and their records."""
    if task_ids is not None:
        runs = runs.filter(F.col("task_id").isin(*task_ids))
    pairs = (
        source_rows.filter("article_id is not null")
        .select("search_run_id", "article_id")
        .distinct()
        .join(runs.select("search_run_id", "task_id"), "search_run_id")
        .select("task_id", "article_id")
        .distinct()
    )
    return pairs.join(articles, ["article_id"], "inner")


def long_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, value) of every way to recognise an article, from one pass over the rows."""
    author = text.fold(text.null_if_empty(text.strip(F.col("first_author"))))
    weak = F.concat_ws("|", "normalized_title", F.col("publication_year").cast("string"), author)
    known = F.col("publication_year").isNotNull() & author.isNotNull() & F.col("normalized_title").isNotNull()
    values = (
        text.fold(text.null_if_empty(text.strip(F.col("doi")))),
        text.null_if_empty(text.strip(F.col("pmid"))),
        F.upper(text.null_if_empty(text.strip(F.col("pmcid")))),
        F.when(known, weak),
    )
    each = F.array(*[F.struct(F.lit(way).alias("kind"), v.alias("value")) for way, v in zip(WAYS, values)])
    # The outer form does not test the array's size first, which would build it twice.
    rows = df.select(key, F.explode_outer(each).alias("k")).select(key, "k.kind", "k.value")
    return rows.filter("value is not null")


def best_match(hits: DataFrame) -> DataFrame:
    """(record_id, article_id, matched_by) of (record_id, kind, article_id): the best kind, then the least article id."""
    rank = sum((F.when(F.col("kind") == way, n).otherwise(0) for n, way in enumerate(WAYS, 1)), F.lit(0))
    best = F.min(F.struct(rank.alias("n"), "article_id", F.col("kind").alias("matched_by"))).alias("m")
    return hits.groupBy("record_id").agg(best).select("record_id", "m.article_id", "m.matched_by")


def match_existing(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """(record_id, article_id, matched_by): the stored article each record belongs to.

    One equality join on kind and value instead of a disjunction, which would
    become a nested-loop join.  Any strong identifier beats title, year and
    author; among several the earlier kind and the least article id win.
    """
    owners = long_keys(store, "article_id").groupBy("kind", "value").agg(F.min("article_id").alias("article_id"))
    return best_match(long_keys(incoming, "record_id").join(owners, ["kind", "value"]))


def _first_filled(name: str, list_field: bool) -> Column:
    """First non-empty value in record order."""
    c = F.col(name)
    filled = (F.size(c) > 0) if list_field else c.isNotNull() & (c.cast("string") != "")
    return F.min_by(c, F.when(filled, F.col("record_id"))).alias(f"_n_{name}")


def new_articles(fresh: DataFrame) -> DataFrame:
    """(record_id, first_id): unmatched records that share an identifier, or title, year and author, become one article."""
    keys = long_keys(fresh, "record_id")
    groups = resolve.components(keys).withColumnRenamed("cluster", "first_id")
    return fresh.select("record_id").join(groups, "record_id", "left").select(
        "record_id", F.coalesce("first_id", "record_id").alias("first_id")
    )


def upsert_articles(
    store: DataFrame, incoming: DataFrame, matches: DataFrame, build_spans: bool = False,
    long_fields: Sequence[str] = LONG_FIELDS,
) -> DataFrame:
    """Next snapshot of the articles.

    Matched records fill only empty fields, lists of authors and publication
    types among them, in record order, and raise the retraction flag; titles
    stay.  Unmatched records that match each other make one article, which the
    first of them founds and the others fill; it takes the first record id as a
    text id ("r" + id).  Running it twice changes nothing.  Spans are rebuilt
    from the final texts if asked for.  ``long_fields`` are kept out of the
    aggregate; give none where ids stand for the texts.
    """
    both = [c for c in incoming.columns if c in store.columns]
    matches = scale.stage(matches.select("record_id", "article_id"), "matches")
    long_text = [f for f in long_fields if f in both]
    fields = [f for f in FILL_FIELDS if f in both and f not in long_text]
    lists = [f for f in FILL_LISTS if f in both]
    fresh = incoming.join(matches.select("record_id"), "record_id", "left_anti")
    firsts = scale.stage(new_articles(fresh), "new-articles")
    founders = fresh.join(firsts.filter("record_id = first_id").select("record_id"), "record_id", "left_semi")
    new_id = F.concat(F.lit("r"), F.col("first_id").cast("string"))
    known = store.withColumn("article_id", F.col("article_id").cast("string"))
    made = founders.withColumn("article_id", F.concat(F.lit("r"), F.col("record_id").cast("string")))
    base = known.unionByName(made.select(*[c for c in store.columns if c in made.columns]), allowMissingColumns=True)
    joined = matches.select("record_id", F.col("article_id").cast("string").alias("article_id")).unionByName(
        firsts.filter("record_id <> first_id").select("record_id", new_id.alias("article_id"))
    )
    offers = incoming.join(joined, "record_id").groupBy("article_id").agg(
        *[_first_filled(f, False) for f in fields],
        *[_first_filled(f, True) for f in lists],
        *[F.min(F.when(F.col(f) != "", F.col("record_id"))).alias(f"_r_{f}") for f in long_text],
        F.bool_or("is_retracted").alias("_retracted"),
    )
    rows = base.join(offers, "article_id", "left")
    for f in long_text:
        # Long texts take no part in the aggregate: where one is wanted, it joins back by the record that has it.
        wanted = F.when(F.col(f).isNull() | (F.col(f) == ""), F.col(f"_r_{f}"))
        texts = incoming.select(F.col("record_id").alias("_record"), F.col(f).alias(f"_n_{f}"))
        rows = rows.join(texts, wanted == F.col("_record"), "left").drop("_record")
    for f in fields + lists + long_text:
        c = F.col(f)
        empty = c.isNull() | ((F.size(c) == 0) if f in lists else (c.cast("string") == ""))
        rows = rows.withColumn(f, F.coalesce(F.when(empty, F.col(f"_n_{f}")), c))
    out = rows.withColumn(
        "is_retracted", F.col("is_retracted") | F.coalesce("_retracted", F.lit(False))
    ).select(*store.columns)
    if build_spans:
        out = span_ops.with_spans(out.drop("spans"), "article_id").withColumn(
            "span_version", F.lit(span_ops.SEGMENTER_VERSION)
        )
    return out


def upsert_resources(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next snapshot of the full-text resources, unique on (article, url).

    Flags only ever turn true; the first landing page stays; a new preferred
    resource demotes the old one.  ``seq`` orders the incoming rows (null = stored).
    Stored rows that share a link go by ``record_seq`` if they have one, so the
    result never hangs on the order in which rows are read.
    """
    old = store.withColumn("_seq", F.lit(-1).cast("long")).withColumn("_new", F.lit(False))
    new = incoming.withColumnRenamed("seq", "_seq").withColumn("_new", F.lit(True))
    rows = old.unionByName(new, allowMissingColumns=True)
    rows = rows if "record_seq" in rows.columns else rows.withColumn("record_seq", F.lit(None).cast("long"))
    order = F.struct("_seq", "record_seq", format_rank(F.col("format")), "format", "landing_url")
    merged = rows.groupBy("article_id", "url").agg(
        F.min_by("format", order).alias("format"),
        F.min_by("landing_url", F.when(F.col("landing_url") != "", order)).alias("landing_url"),
        # A stored false stays unless an incoming row says true.
        F.coalesce(
            F.when(F.bool_or("is_open_access"), F.lit(True)), F.min_by("is_open_access", order)
        ).alias("is_open_access"),
        F.coalesce(
            F.when(F.bool_or("is_downloadable"), F.lit(True)), F.min_by("is_downloadable", order)
        ).alias("is_downloadable"),
        F.bool_or(F.coalesce("is_preferred", F.lit(False)) & ~F.col("_new")).alias("_was"),
    )
    # Last record wins among those that offer a preferred file; within it the best format.
    offer = F.struct(-F.col("record_seq"), format_rank(F.col("format")), F.col("_seq"))
    chosen = (
        new.filter("is_downloadable")
        .groupBy("article_id")
        .agg(F.min_by("url", offer).alias("_choice"))
    )
    out = merged.join(chosen, ["article_id"], "left")
    preferred = F.when(F.col("_choice").isNull(), F.col("_was")).otherwise(
        F.col("url") == F.col("_choice")
    )
    return out.withColumn("is_preferred", preferred).drop("_was", "_choice")


def put_if_absent(store: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is not stored yet, one per key (that of least hash); stored rows are never changed."""
    fresh = new.join(store.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return fresh.distinct()
    one = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row")
    return fresh.groupBy(*keys).agg(one).select(*keys, "_row.*").select(*new.columns)


def checked_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors with their dimension and whether they have unit length; an empty one raises."""
    from litmill.functions.values import norm

    size = F.size(F.coalesce(vec, F.array().cast("array<float>")))
    ok = F.when(size > 0, F.col(vec)).otherwise(F.raise_error(F.lit("a vector must not be empty")))
    return (
        df.withColumn(vec, ok)
        .withColumn("dimension", F.size(vec))
        .withColumn("normalized", F.abs(norm(F.col(vec)) - 1.0) < 1e-3)
    )


def hydrate(ids: DataFrame, articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Id lists to articles, order kept; missing and repeated ids are flagged.

    ``ids`` holds a list key, ``pos`` and the article id.
    """
    counts = ids.groupBy("list_id", key).agg(F.count("*").alias("_n"))
    rows = ids.join(counts, ["list_id", key])
    found = articles.withColumn("_found", F.lit(True))
    out = rows.join(found, [key], "left")
    return out.withColumn("missing", F.col("_found").isNull()).withColumn(
        "repeated", F.col("_n") > 1
    ).drop("_found", "_n")


def convert_ids(df: DataFrame, crosswalk: DataFrame, kind: str) -> DataFrame:
    """PMCIDs for ids of one kind (pmid or doi) from a crosswalk table."""
    if kind not in ("pmid", "doi"):
        raise ValueError("kind is pmid or doi")
    clean = text.pmid if kind == "pmid" else text.doi
    table = (
        crosswalk.filter(F.col(kind).isNotNull() & F.col("pmcid").isNotNull())
        .groupBy(F.col(kind).alias("_id"))
        .agg(F.min("pmcid").alias("pmcid"))
    )
    rows = df.drop("pmcid").withColumn("_id", clean(F.col(kind)))
    known = rows.filter("_id is not null")
    rest = rows.filter("_id is null").withColumn("pmcid", F.lit(None).cast("string"))
    return known.join(table, ["_id"], "left").unionByName(rest).drop("_id")


def run_ledger(requested: DataFrame, results: DataFrame) -> DataFrame:
    """One row per requested run, failed runs with zero counts, with the query's hash."""
    counts = results.groupBy("search_run_id").agg(F.count("*").alias("retrieved_count"))
    rows = requested.join(counts, "search_run_id", "left").na.fill(0, ["retrieved_count"])
    return rows.withColumn("query_hash", F.sha2("compiled_query", 256)).withColumn(
        "status",
        F.when(F.col("failed"), F.lit("failed"))
        .when(F.col("retrieved_count") == 0, F.lit("success_empty"))
        .otherwise(F.lit("success_with_results")),
    )


def parsed_date(c: Column) -> Column:
    return dates.iso_date(c)
