"""Views that give the test tables the shapes our operators take.

Each view is one SQL text that runs in Spark and in the SQL oracle; the few
functions that are spelled differently are written as ``ARR(...)``, ``RX(...)``
and so on, and are expanded per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from litmill import scale
from litmill.functions import text
from litmill.operators import resolve

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


# Tables with long texts, whose rows are costly to work on.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return scale.spread(df) if name in TEXT_TABLES else df


SPARK_WORDS = {"ARR": "array", "DIV": "div", "EMPTY_LIST": "cast(array() as array<string>)"}
DUCK_WORDS = {"ARR": "list_value", "DIV": "//", "EMPTY_LIST": "cast([] as varchar[])"}


def _words(sql: str, words: dict[str, str]) -> str:
    return re.sub(r"\b(ARR|DIV|EMPTY_LIST)\b", lambda m: words[m.group(1)], sql)


def duck(sql: str) -> str:
    return _words(sql, DUCK_WORDS)


def spark_sql(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Run a shared SQL text over the given frames."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in views:
        sql = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(_words(sql, SPARK_WORDS), **views)


# --- normalisers, oracle side -------------------------------------------------

SPACE = text.SPACE


def q_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def q_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def q_match(x: str) -> str:
    return f"trim(regexp_replace({q_fold(x)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def q_title(x: str) -> str:
    return f"nullif({q_match(x)}, '')"


def q_single(x: str) -> str:
    return f"nullif({q_collapse(x)}, '')"


# --- records --------------------------------------------------------------------

# Bibliographic records derived from documents.  Identifiers repeat for copied
# texts, so clusters of every size arise, transitive ones included.
REC = """
select doc_id as record_id,
 case cast(substr(source, 4) as int) % 6 when 0 then 'europe_pmc' when 1 then 'pmc' when 2 then 'pubmed'
   when 3 then 'semantic_scholar' when 4 then 'biorxiv' else 'medrxiv' end as source,
 cast(doc_id as string) as source_record_id,
 case when doc_id % 6 = 0 then '' else 'A' || cast(doc_id as string) end as source_article_id,
 cast(doc_id % 97 + 1 as int) as source_rank,
 'run-' || source as search_run_id,
 case when doc_id % 3 <> 0 then '10.1/' || md5(text) end as doi,
 case when doc_id % 40 = 0 then cast(5000 + doc_id DIV 80 as string) when doc_id % 4 = 0 then cast(n_chars * 1000 + length(split_part(text, chr(10), 1)) as string) end as pmid,
 case when doc_id % 10 = 3 then 'PMC' || cast(n_chars * 1000 + length(split_part(text, chr(10), 1)) as string) end as pmcid,
 split_part(text, chr(10), 1) as title,
 case when doc_id % 11 = 0 then null else text end as abstract,
 doc_id % 11 <> 0 as abstract_available,
 case when doc_id % 7 = 6 then '' else 'Author ' || substr(md5(split_part(text, chr(10), 1)), 1, 4) end as first_author,
 case when doc_id % 5 = 4 then null else 'Journal ' || cast(doc_id % 13 as string) end as journal_title,
 case when doc_id % 9 = 0 then '' when doc_id % 9 = 1 then null else '1000-' || cast(1000 + doc_id % 50 as string) end as issn,
 case when doc_id % 8 = 7 then null else cast(make_date(cast(2000 + length(split_part(text, chr(10), 1)) % 25 as int), cast(1 + doc_id % 12 as int), cast(1 + doc_id % 28 as int)) as string) end as publication_date,
 case when doc_id % 17 = 5 then null else cast(2000 + length(split_part(text, chr(10), 1)) % 25 as int) end as publication_year,
 case when doc_id % 3 = 0 then ARR('Journal Article', 'Kind ' || cast(doc_id % 4 as string)) else ARR('journal article.', 'Other') end as publication_types,
 ARR('Key ' || cast(doc_id % 5 as string), 'key-' || cast(doc_id % 5 as string), lang, 'Topic ' || cast(doc_id % 7 as string)) as keywords,
 lang as language,
 case doc_id % 3 when 0 then 'peer_reviewed' when 1 then 'preprint' else 'unknown' end as peer_review_status,
 case when doc_id % 3 = 1 then 'biorxiv' end as preprint_server,
 case when doc_id % 3 = 1 then cast(1 + doc_id % 4 as int) end as preprint_version,
 case when doc_id % 5 = 0 then true when doc_id % 5 = 1 then false end as is_open_access,
 doc_id % 4 < 2 as has_full_text,
 doc_id % 4 = 1 as can_download_full_text,
 cast(doc_id * 7 % 50 as int) as citation_count,
 doc_id % 101 = 7 as is_retracted,
 'https://example.org/' || cast(doc_id as string) as landing_url
from documents"""

# The same with its normalised title, for the oracle.
DUCK_REC = f"rec0 as ({duck(REC)}), rec as (select *, {q_title('title')} as normalized_title from rec0)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Spark's split_part cuts the whole text; the first line is all that is asked for.
    first_line = REC.replace("split_part(text, chr(10), 1)", "substring_index(text, chr(10), 1)")
    rec = spark_sql(spark, first_line, documents=docs)
    return rec.withColumn("normalized_title", text.title_text(rec["title"]))


# Identity keys and clusters by fixed point, for the oracle.
DUCK_KEYS = f"""{DUCK_REC}, keys as (
 select record_id, 'doi' as kind, {q_fold(q_strip('doi'))} as value from rec where doi <> ''
 union all select record_id, 'pmid', {q_strip('pmid')} from rec where pmid <> ''
 union all select record_id, 'pmcid', upper({q_strip('pmcid')}) from rec where pmcid <> ''
 union all select record_id, 'title_year_author',
  normalized_title || '|' || cast(publication_year as varchar) || '|' || {q_title('first_author')} from rec
  where coalesce(doi, '') = '' and coalesce(pmid, '') = '' and coalesce(pmcid, '') = ''
   and normalized_title is not null and publication_year is not null and {q_title('first_author')} is not null)"""

DUCK_CLUSTERS = f"""{DUCK_KEYS}, stars as (
 select distinct k.record_id as a, h.hub as b from keys k join
  (select kind, value, min(record_id) as hub from keys group by kind, value) h
  on k.kind = h.kind and k.value = h.value where k.record_id <> h.hub),
links as (select a, b from stars union select b, a from stars),
reach(a, b) as (select record_id, record_id from (select distinct record_id from keys) union
 select r.a, l.b from reach r join links l on r.b = l.a),
clusters as (select a as record_id, min(b) as cluster from reach group by a),
members as (select r.*, coalesce(c.cluster, r.record_id) as cluster from rec r left join clusters c on r.record_id = c.record_id),
ranked as (select *, row_number() over (partition by cluster order by
  case peer_review_status when 'peer_reviewed' then 2 when 'unknown' then 1 else 0 end desc,
  can_download_full_text desc, abstract_available desc, has_full_text desc,
  (case when doi <> '' then 1 else 0 end + case when pmid <> '' then 1 else 0 end + case when pmcid <> '' then 1 else 0 end) desc,
  case source when 'europe_pmc' then 5 when 'pmc' then 4 when 'pubmed' then 3 when 'semantic_scholar' then 2 when 'biorxiv' then 1 else 0 end desc,
  source_rank asc, record_id asc) as pos from members)"""

_resolved: dict[tuple, tuple[DataFrame, DataFrame, DataFrame]] = {}


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, keys, clusters), keys and clusters written once per session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _resolved:
        rec = records(spark, sf_dir)
        keys = resolve.staged_keys(rec)
        _resolved[at] = (rec, keys, scale.stage(resolve.components(keys, staged=True), "clusters"))
    return _resolved[at]


def forget() -> None:
    """Drop the remembered clusters, so that a timing covers the whole work."""
    _resolved.clear()
