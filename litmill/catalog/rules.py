"""Projections, routing, contract rules, filters and set checks."""

import datetime as dt

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.operators import audit, portfolio, quality, rank, records, routing, search
from litmill.operators.rubrics import STUDY_TYPES

# Study design inputs: metadata markers and method phrases by document id.
_MARKS = [m for m, _ in routing.METADATA_MARKERS]
_PHRASES = (
    "a systematic review of metabolic data", "systematic review of trials", "an umbrella review",
    "this literature review", "randomised by centre in a large trial", "participants were randomized",
    "a case-control study", "a prospective cohort", "a prevalence survey",
)
_CASE_MARK = "case doc_id % 13 " + " ".join(f"when {i} then 'Some {m.title()} kind'" for i, m in enumerate(_MARKS)) + " end"
_CASE_PHRASE = "case doc_id % 9 " + " ".join(f"when {i} then ' {p}.'" for i, p in enumerate(_PHRASES)) + " end"
_CASE_STATED = (
    "case doc_id % 7 when 0 then 'Cross-Sectional Prevalence' when 1 then 'cross_sectional_prevalence' when 2 then 'Review' "
    "when 3 then 'Randomized' when 4 then 'qualitative evidence synthesis' when 5 then 'Case Control' end"
)
DESIGN = f"""select doc_id as article_id, source,
 case when doc_id % 2 = 0 then ARR({_CASE_MARK}) else EMPTY_LIST end as publication_types,
 case when doc_id % 5 = 4 then {_CASE_STATED} end as stated,
 case when doc_id % 10 = 9 then null when doc_id % 4 = 3 then text else text || {_CASE_PHRASE} end as abstract from documents"""

_INFER = """coalesce(""" + ", ".join(
    f"case when contains(meta, '{m}') then '{v}' end" for m, v in routing.METADATA_MARKERS
) + f""", case when regexp_matches(body, '{routing.REVIEW_PHRASE}') then case when contains(body, 'meta') then 'meta_analysis' else 'systematic_review' end end, """ + ", ".join(
    f"case when regexp_matches(body, '{p}') then '{v}' end" for p, v in routing.ABSTRACT_PHRASES
) + ")"
_TOKEN = "nullif(trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '_'), '')"
_ALIAS = ", ".join(f"case when contains(joined, '{n}') then '{v}' end" for n, v in routing.ALIASES)
_TYPES = ", ".join(f"'{t}'" for t in STUDY_TYPES)
DUCK_DESIGN = f"""design as ({A.duck(DESIGN)}), prep as (select *,
 lower(concat_ws(' ', coalesce({A.q_collapse('stated')}, ''), coalesce(array_to_string(publication_types, ' '), ''))) as meta0,
 lower(coalesce(abstract, '')) as body, coalesce({_TOKEN.format(x='stated')}, '') as own,
 coalesce({_TOKEN.format(x='publication_types[1]')}, '') as tok from design),
 inferred as (select *, (select {_INFER.replace('meta,', 'meta0,')} from (select 1)) as inferred,
  (select {_INFER.replace('meta,', 'meta1,')} from (select 1)) as inferred_own from
   (select *, lower(own || ' ' || coalesce(array_to_string(publication_types, ' '), '')) as meta1, concat_ws('_', nullif(own, ''), nullif(tok, '')) as joined from prep)),
 grouped as (select *, coalesce(inferred_own, case when own in ({_TYPES}) then own end, {_ALIAS},
  case when contains(joined, 'cross_sectional') then case when contains(joined, 'prevalence') then 'cross_sectional_prevalence' else 'cross_sectional_analytical' end end,
  case when contains(joined, 'review') then 'narrative_review' end, 'unknown') as study_group from inferred)"""


def design(spark, sf_dir):
    return A.spark_sql(spark, DESIGN, documents=A.table(spark, sf_dir, "documents"))


def _grouped(spark, sf_dir):
    d = design(spark, sf_dir)
    return d.withColumn(
        "study_group", routing.study_group(F.col("publication_types"), F.col("stated"), F.col("abstract")))


@query("p13_infer_study_design", f"with {DUCK_DESIGN} select article_id, inferred as design from grouped")
def infer_study_design(spark, sf_dir):
    return design(spark, sf_dir).select(
        "article_id",
        routing.infer_design(F.col("publication_types"), F.col("stated"), F.col("abstract")).alias("design"),
    )


@query("p14_study_group", f"with {DUCK_DESIGN} select article_id, study_group from grouped")
def study_group(spark, sf_dir):
    return _grouped(spark, sf_dir).select("article_id", "study_group")


@query(
    "p15_split_supported",
    f"""with {DUCK_DESIGN} select study_group, case when study_group in ({_TYPES}) then 'supported' else 'not_evaluated' end as status,
 case when study_group not in ({_TYPES}) then 'unsupported_study_design' end as reason, count(*) as n from grouped group by 1, 2, 3""",
)
def split_supported(spark, sf_dir):
    yes, no = routing.split_supported(_grouped(spark, sf_dir))
    yes = yes.select("*", F.lit("supported").alias("status"), F.lit(None).cast("string").alias("reason"))
    return yes.unionByName(no).groupBy("study_group", "status", "reason").agg(F.count("*").alias("n"))


# Two providers' rows from documents, for the unified record.
_EPMC_ROWS = """select doc_id, cast(doc_id as string) as source_record_id, 'europe_pmc:MED:' || cast(doc_id as string) as source_article_id,
 'r1' as search_run_id, 'DOI: 10.9/' || cast(doc_id as string) as doi, case when doc_id % 2 = 0 then cast(doc_id as string) else 'bad' end as pmid,
 cast(doc_id as string) as pmcid, split_part(text, chr(10), 1) as title, text as abstract, 'A  B' as first_author,
 ARR('Review', 'review', ' ', 'Cohort') as publication_types, ARR(lang, upper(lang), 'x  y') as keywords, lang as language,
 cast(2000 + doc_id % 25 as int) as publication_year, cast(doc_id % 9 as int) as citation_count,
 case when doc_id % 3 = 0 then true end as is_open_access, doc_id % 2 = 0 as has_full_text, 'ftp://x' as landing_url from documents where doc_id % 2 = 0"""
_PRE_ROWS = """select doc_id, '10.1101/' || cast(doc_id as string) as source_record_id, 'biorxiv:doi:10.1101/' || cast(doc_id as string) as source_article_id,
 'r2' as search_run_id, '10.1101/' || cast(doc_id as string) as doi, '77' as pmid, 'PMC1' as pmcid, '  ' || split_part(text, chr(10), 1) as title,
 case when doc_id % 3 = 0 then '' else text end as abstract, lang as first_author, ARR('new results') as publication_types, ARR('neuro') as keywords,
 'en' as language, cast(2000 + doc_id % 25 as int) as publication_year, 'biorxiv' as source, 'biorxiv' as preprint_server,
 cast(1 + doc_id % 3 as int) as preprint_version, true as is_open_access, 'HTTPS://x.org/' || cast(doc_id as string) as landing_url from documents where doc_id % 2 = 1"""


def _multi(x):
    return f"""(select nullif(string_agg({A.q_collapse('l')}, chr(10) order by i), '') from (select unnest(regexp_split_to_array({x}, '{A.text.LINE_BREAK}')) as l,
 generate_subscripts(regexp_split_to_array({x}, '{A.text.LINE_BREAK}'), 1) as i) where {A.q_collapse('l')} <> '')"""


@query(
    "p10_unify_records",
    f"""with e as ({A.duck(_EPMC_ROWS)}), p as ({A.duck(_PRE_ROWS)})
 select 'europe_pmc' as source, source_record_id, lower(substr(doi, 6)) as doi, case when pmid <> 'bad' then pmid end as pmid, 'PMC' || pmcid as pmcid,
 {A.q_single('title')} as title, {A.q_title('title')} as normalized_title, md5({_multi('abstract')}) as abstract_md5, 'A B' as first_author,
 'Review;Cohort' as publication_types, lang || ';x y' as keywords, language, publication_year, 'cohort' as study_design, 'unknown' as peer_review_status,
 cast(null as varchar) as preprint_server, cast(null as integer) as preprint_version, is_open_access, has_full_text, citation_count, cast(null as varchar) as landing_url
 from (select *, language as lang from e)
 union all select 'biorxiv', source_record_id, doi, null, null, {A.q_single('title')}, {A.q_title('title')}, md5({_multi('abstract')}), first_author, 'new results', 'neuro',
 null, publication_year, null, 'preprint', 'biorxiv', preprint_version, null, false, null, landing_url from p""",
)
def unify_records(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    e = records.unify("europe_pmc", A.spark_sql(spark, _EPMC_ROWS, documents=d))
    p = records.unify("preprint", A.spark_sql(spark, _PRE_ROWS, documents=d))
    return records.union_sources(e, p).select(
        "source", "source_record_id", "doi", "pmid", "pmcid", "title", "normalized_title",
        F.md5("abstract").alias("abstract_md5"), "first_author",
        F.array_join("publication_types", ";").alias("publication_types"),
        F.array_join("keywords", ";").alias("keywords"), "language", "publication_year", "study_design",
        "peer_review_status", "preprint_server", "preprint_version", "is_open_access", "has_full_text",
        "citation_count", "landing_url",
    )


# Records with faults put in by id.
_FAULTY = """select record_id, source, case when record_id % 29 = 0 then ' ' else source_record_id end as source_record_id,
 search_run_id, case when record_id % 23 = 0 then '' else title end as title, case when record_id % 31 = 0 then null else 'x' end as normalized_title,
 cast(case when record_id % 19 = 0 then 1200 else publication_year end as int) as publication_year,
 cast(case when record_id % 17 = 0 then 0 else source_rank end as int) as source_rank,
 cast(case when record_id % 13 = 0 then -1 else citation_count end as int) as citation_count,
 cast(case when record_id % 37 = 0 then 0 else preprint_version end as int) as preprint_version,
 case when record_id % 41 = 0 then 'biorxiv' else preprint_server end as preprint_server, peer_review_status from rec"""
_Q_ISSUES = """concat_ws(',', case when trim(source_record_id) = '' then 'no_source_record_id' end, case when trim(title) = '' then 'no_title' end,
 case when normalized_title is null then 'no_normalized_title' end, case when publication_year not between 1500 and 3000 then 'year_range' end,
 case when source_rank < 1 then 'rank_range' end, case when citation_count < 0 then 'citation_range' end,
 case when preprint_version < 1 then 'version_range' end, case when preprint_server <> '' and peer_review_status <> 'preprint' then 'server_without_preprint' end)"""


def _faulty(spark, sf_dir):
    return A.spark_sql(spark, _FAULTY, rec=A.records(spark, sf_dir))


@query(
    "p11_validate_records",
    f"with {A.DUCK_REC}, f as ({_FAULTY}) select record_id, {_Q_ISSUES} as issues from f",
)
def validate_records(spark, sf_dir):
    return records.validate_records(_faulty(spark, sf_dir)).select(
        "record_id", F.array_join("issues", ",").alias("issues"))


@query(
    "p12_normalize_with_quarantine",
    f"""with {A.DUCK_REC}, f as ({_FAULTY}), c as (select *, {_Q_ISSUES} as issues from f)
 select search_run_id, count(*) filter (where issues = '') as retrieved_count, count(*) filter (where issues <> '') as invalid_count,
 case when sum(case when issues <> '' then 1 else 0 end) > 0 then 'partial_success' else 'success_with_results' end as status,
 cast(sum(case when issues = '' then record_id else 0 end) as bigint) as good_ids from c group by 1""",
)
def normalize_with_quarantine(spark, sf_dir):
    good, _, runs = records.split_quarantine(_faulty(spark, sf_dir))
    ids = good.groupBy("search_run_id").agg(F.sum("record_id").alias("good_ids"))
    return runs.join(ids, "search_run_id", "left").na.fill(0, ["good_ids"])


_QUESTIONS = """select cast(item_id as string) as query_id, case item_id % 4 when 0 then text || ' Full Text please' when 1 then '全文 ' || text else text end as query,
 case item_id % 3 when 0 then ARR('other') when 1 then ARR('safety', 'prognosis') else EMPTY_LIST end as directions from benchmark"""
_R = search.SOURCE_REASONS


@query(
    "p16_select_sources",
    f"""with q as ({A.duck(_QUESTIONS)}) select query_id, 1 as place, 'pubmed' as source, '{_R["pubmed"]}' as reason from q
 union all select query_id, 2, 'europe_pmc', '{_R["europe_pmc"]}' from q
 union all select query_id, 3, 'pmc', '{_R["pmc"]}' from q where {' or '.join(f"contains(lower(query), '{w}')" for w in search.FULL_TEXT_WORDS)}
 union all select query_id, 4, 'semantic_scholar', '{_R["semantic_scholar"]}' from q where list_contains(directions, 'other')""",
)
def select_sources(spark, sf_dir):
    return search.select_sources(A.spark_sql(spark, _QUESTIONS, benchmark=A.table(spark, sf_dir, "benchmark")))


# Search plans: all words of a question, in three concept groups by their place in it; a group's terms are its long
# words and its pairs of neighbouring words.
_PLAN = f"""w as (select item_id, n, unnest(words) as word, generate_subscripts(words, 1) as pos from
  (select item_id, words, len(words) as n from (select item_id, string_split({A.q_match("text")}, ' ') as words from benchmark))),
 placed as (select cast(item_id as varchar) as query_id, cast((pos - 1) * 3 // n as int) + 1 as group_id, word, lead(word) over (partition by item_id order by pos) as after, pos from w),
 plan as (select query_id, group_id, word as term, 2 * pos as term_order from placed where length(word) >= 8
  union all select query_id, group_id, word || ' ' || after, 2 * pos + 1 from placed where after is not null)"""
DOC_TEXTS = f"docs as (select doc_id, {A.q_match('split_part(text, chr(10), 1)')} as title_n, {A.q_match('text')} as body_n from documents)"


def doc_texts(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", A.text.match_text(F.expr("split_part(text, chr(10), 1)")).alias("title_n"),
        A.text.match_text(F.col("text")).alias("body_n"))


def _plan(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark")
    words = b.select(F.col("item_id").cast("string").alias("query_id"), F.split(A.text.match_text(F.col("text")), " ").alias("words"))
    placed = words.select("query_id", F.size("words").alias("n"), F.posexplode(F.arrays_zip(
        F.col("words").alias("word"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("after"))).alias("at", "w"))
    rows = placed.select("query_id", (F.expr("at * 3 div n") + 1).cast("int").alias("group_id"), "w.word", "w.after", "at")
    long_words = rows.filter(F.length("word") >= 8).select("query_id", "group_id", F.col("word").alias("term"), (2 * F.col("at") + 2).alias("term_order"))
    pairs = rows.filter("after is not null").select(
        "query_id", "group_id", F.concat_ws(" ", "word", "after").alias("term"), (2 * F.col("at") + 3).alias("term_order"))
    return long_words.unionByName(pairs)


_Q_HITS = f"""{DOC_TEXTS}, {_PLAN},
 hits as (select distinct p.query_id, p.group_id, d.doc_id from docs d join plan p on contains(' ' || d.title_n || ' ', ' ' || p.term || ' ') or contains(' ' || d.body_n || ' ', ' ' || p.term || ' ')),
 need as (select query_id, count(distinct group_id) as n from plan group by 1),
 found as (select h.query_id, h.doc_id from hits h join need n on h.query_id = n.query_id group by h.query_id, h.doc_id, n.n having count(distinct h.group_id) = n.n)"""


@query("p17_boolean_concept_search", f"with {_Q_HITS} select query_id, doc_id from found")
def boolean_concept_search(spark, sf_dir):
    return search.concept_search(
        doc_texts(spark, sf_dir), _plan(spark, sf_dir), "doc_id", ["title_n", "body_n"])


@query(
    "p17_representative_search",
    f"""with {_Q_HITS.replace("from docs d join plan p on", "from docs d join (select * from plan qualify row_number() over (partition by query_id, group_id order by term_order) = 1) p on")} select query_id, doc_id from found""",
)
def representative_search(spark, sf_dir):
    return search.concept_search(
        doc_texts(spark, sf_dir), _plan(spark, sf_dir), "doc_id", ["title_n", "body_n"], mode="representative")


@query(
    "j16_phrase_match",
    f"""with {DOC_TEXTS}, terms as (select distinct {A.q_match('p_name')} as term from part union select 'from the' union select 'tion')
 select d.doc_id, t.term, contains(' ' || d.title_n || ' ', ' ' || t.term || ' ') as in_title, contains(' ' || d.body_n || ' ', ' ' || t.term || ' ') as in_body
 from docs d, terms t where contains(' ' || d.title_n || ' ', ' ' || t.term || ' ') or contains(' ' || d.body_n || ' ', ' ' || t.term || ' ')""",
)
def phrase_match(spark, sf_dir):
    names = A.table(spark, sf_dir, "part").select(A.text.match_text(F.col("p_name")).alias("term"))
    terms = names.union(spark.sql("select 'from the' as term union all select 'tion'")).distinct()
    hits = search.phrase_match(doc_texts(spark, sf_dir), terms, "doc_id", ["title_n", "body_n"])
    return hits.groupBy("doc_id", "term").agg(
        F.bool_or(F.col("field") == "title_n").alias("in_title"),
        F.bool_or(F.col("field") == "body_n").alias("in_body"))


_CONSTRAINTS = """select cast(item_id as string) as query_id, 'study_design' as kind, case item_id % 3 when 0 then 'include' when 1 then 'exclude' else 'prefer' end as operator,
 case item_id % 2 when 0 then 'cohort' else 'randomized_controlled_trial' end as value from benchmark where item_id % 5 <> 0
 union all select cast(item_id as string), 'language', 'include', 'en' from benchmark
 union all select cast(item_id as string), 'study_design', 'exclude', 'nonsense' from benchmark where item_id = 7"""


@query(
    "p18_apply_constraints",
    f"""with {DUCK_DESIGN}, {_Q_HITS.replace("placed as", "spots as").replace("from placed", "from spots")}, f as (select * from found), c as ({_CONSTRAINTS}), dv as (select article_id, case inferred when 'randomized_controlled_trial' then 'randomized_controlled_trial' when 'cohort' then 'cohort' end as v from grouped)
 select f.query_id, f.doc_id from f join dv on f.doc_id = dv.article_id where
 not exists (select 1 from c where c.query_id = f.query_id and kind = 'study_design' and operator in ('include', 'prefer') and value is distinct from dv.v)
 and not exists (select 1 from c where c.query_id = f.query_id and kind = 'study_design' and operator = 'exclude' and value = dv.v)
 and not exists (select 1 from c where c.query_id = f.query_id and value = 'nonsense')""",
)
def apply_constraints(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark")
    found = boolean_concept_search(spark, sf_dir)
    g = design(spark, sf_dir)
    inferred = routing.infer_design(F.col("publication_types"), F.col("stated"), F.col("abstract"))
    docs = g.select(
        F.col("article_id").alias("doc_id"),
        search.design_values(inferred, F.col("publication_types"), F.lit("")).alias("design_values"))
    cons = A.spark_sql(spark, _CONSTRAINTS, benchmark=b)
    return search.apply_constraints(found, docs, cons, "doc_id").select("query_id", "doc_id")


CRIT = """select d.doc_id as article_id, c.k as criterion_no, case (d.doc_id * 31 + c.k * 17) % 10 when 0 then 'not_applicable' when 1 then 'not_reported'
 when 2 then 'not_reported' when 3 then 'unclear' when 4 then 'unclear' else 'favorable' end as status
 from documents d cross join (select 1 as k union all select 2 union all select 3 union all select 4 union all select 5) c"""
_CRIT_SPARK = """select doc_id as article_id, criterion_no, case (doc_id * 31 + criterion_no * 17) % 10 when 0 then 'not_applicable' when 1 then 'not_reported'
 when 2 then 'not_reported' when 3 then 'unclear' when 4 then 'unclear' else 'favorable' end as status from documents lateral view explode(sequence(1, 5)) as criterion_no"""


def crit(spark, sf_dir):
    return A.spark_sql(spark, _CRIT_SPARK, documents=A.table(spark, sf_dir, "documents"))


Q_SCORE = "case status when 'favorable' then 1.0 when 'unclear' then -0.5 when 'not_reported' then -1.0 end"
DUCK_QUALITY = f"""crit as ({CRIT}), qual as (select article_id, count({Q_SCORE}) as applicable, 5 + 5 * avg({Q_SCORE}) as quality_score from crit group by 1),
 rel as (select doc_id as article_id, cast(doc_id * 13 % 101 / 10.0 as double) as relevance_score, cast(doc_id * 29 % 101 / 10.0 as double) as answerability_score from documents),
 comp as (select r.*, q.quality_score, 0.5 * relevance_score + 0.25 * quality_score + 0.15 * answerability_score + 0.5 as composite_score from rel r join qual q on r.article_id = q.article_id)"""


def rel(spark, sf_dir):
    return A.spark_sql(
        spark,
        "select doc_id as article_id, cast(doc_id * 13 % 101 / 10.0 as double) as relevance_score, cast(doc_id * 29 % 101 / 10.0 as double) as answerability_score from documents",
        documents=A.table(spark, sf_dir, "documents"))


def comp(spark, sf_dir):
    q = quality.preliminary_quality(crit(spark, sf_dir))
    return quality.composite(rel(spark, sf_dir).join(q.select("article_id", "quality_score"), "article_id"))


@query(
    "p19_threshold_partition",
    f"with {DUCK_QUALITY} select article_id, coalesce(composite_score > 3.0, false) as retained from comp",
)
def threshold_partition(spark, sf_dir):
    kept, dropped = quality.partition_by_threshold(
        comp(spark, sf_dir).withColumn("composite_score", F.round("composite_score", 9)))
    yes = kept.select("article_id", F.lit(True).alias("retained"))
    return yes.unionByName(dropped.select("article_id", F.lit(False).alias("retained")))


_STATED = """select doc_id as article_id, doc_id % 5 as criterion_no, case doc_id % 6 when 0 then 'favorable' when 1 then 'unclear' when 2 then 'not_reported'
 when 3 then 'not_applicable' when 4 then 'strange' else 'favorable' end as status,
 cast(case doc_id % 4 when 0 then 1.0 when 1 then -0.5 when 2 then null else -1.0 end as double) as score,
 case doc_id % 7 when 0 then '' when 1 then text else 'short' end as reason, cast(doc_id % 3 as int) as cited, cast(doc_id % 2 as int) as checked, cast(doc_id % 4 as int) as evidence,
 cast(doc_id % 5 as int) as overlap_count, case doc_id % 4 when 0 then 'none' when 1 then 'low' when 2 then 'medium' else 'high' end as level from documents"""
_E = "case status when 'favorable' then 1.0 when 'unclear' then -0.5 when 'not_reported' then -1.0 end"


@query(
    "p27_criterion_rules",
    f"""with s as ({_STATED}) select article_id, concat_ws(',', case when status = 'strange' then 'unknown_status' end,
 case when status <> 'strange' and score is not null and score is distinct from {_E} then 'score_mismatch' end,
 case when length(reason) < 1 or length(reason) > 200 then 'reason_length' end) as issues from s""",
)
def criterion_rules(spark, sf_dir):
    s = A.spark_sql(spark, _STATED, documents=A.table(spark, sf_dir, "documents"))
    return quality.criterion_issues(s).select("article_id", F.array_join("issues", ",").alias("issues"))


@query(
    "p28_evidence_rules",
    f"""with s as ({_STATED}) select article_id,
 case when status in ('not_reported', 'not_applicable') and cited > 0 then 'spans_not_allowed' when status not in ('not_reported', 'not_applicable') and cited = 0 then 'spans_required' else '' end as criterion_issues,
 case when level = 'none' and (cited > 0 or overlap_count = 0) then 'none_needs_overlap_only' when level <> 'none' and cited = 0 then 'evidence_required' else '' end as contribution_issues,
 case when level = 'none' and (cited > 0 or checked = 0) then 'absent_needs_checked_only' when level <> 'none' and (cited = 0 or evidence = 0) then 'evidence_required' else '' end as coverage_issues from s""",
)
def evidence_rules(spark, sf_dir):
    s = A.spark_sql(spark, _STATED, documents=A.table(spark, sf_dir, "documents"))
    joined = F.array_join("issues", ",")
    out = quality.evidence_issues(s).withColumn("criterion_issues", joined)
    out = quality.contribution_evidence_issues(out).withColumn("contribution_issues", joined)
    out = out.withColumn("status", F.when(F.col("level") == "none", "absent").otherwise("direct"))
    out = quality.coverage_evidence_issues(out).withColumn("coverage_issues", joined)
    return out.select("article_id", "criterion_issues", "contribution_issues", "coverage_issues")


_CAND = """select case when doc_id % 50 = 3 then doc_id + 1 else doc_id end as article_id,
 case when doc_id % 17 = 0 then cast('NaN' as double) when doc_id % 19 = 0 then null else doc_id / 7.0 end as composite_score, doc_id % 11 <> 0 as has_summary,
 case doc_id % 3 when 0 then doc_id when 1 then null else doc_id + 5 end as summary_article_id from documents"""


@query(
    "p31_candidate_contract",
    f"""with c as ({_CAND}) select article_id, issues, count(*) as n from (select article_id, concat_ws(',', case when count(*) over (partition by article_id) > 1 then 'repeated_article_id' end,
 case when composite_score is null or isnan(composite_score) then 'score_not_finite' end, case when not has_summary then 'no_summary' end,
 case when summary_article_id <> article_id then 'summary_of_other_article' end) as issues from c) group by 1, 2""",
)
def candidate_contract(spark, sf_dir):
    c = A.spark_sql(spark, _CAND, documents=A.table(spark, sf_dir, "documents"))
    return portfolio.candidate_issues(c).select(
        "article_id", F.array_join("issues", ",").alias("issues")).groupBy("article_id", "issues").agg(F.count("*").alias("n"))


_SUMM = """select doc_id as article_id, case when doc_id % 3 = 0 then EMPTY_LIST else ARR('s' || cast(doc_id as string), lang) end as strengths,
 case when doc_id % 2 = 0 then EMPTY_LIST else ARR('limit') end as limitations, case when doc_id % 6 = 0 then EMPTY_LIST else ARR(source) end as evidence_gaps,
 case doc_id % 4 when 0 then ' ' when 1 then null else ' fits ' end as relevance_reason, case when doc_id % 5 = 0 then '' else 'answers' end as answerability_reason from documents"""


@query(
    "p32_fallback_summary",
    f"""with s as ({A.duck(_SUMM)}) select article_id, 'fallback' as summary_status,
 coalesce(nullif(array_to_string(list_concat(list_concat(strengths, limitations), evidence_gaps), '；'), ''), '评分理由概括暂不可用。') as summary_text,
 concat_ws('|', 'relevance:' || nullif(trim(relevance_reason), ''), 'answerability:' || nullif(trim(answerability_reason), '')) as reasons from s""",
)
def fallback_summary(spark, sf_dir):
    s = A.spark_sql(spark, _SUMM, documents=A.table(spark, sf_dir, "documents"))
    return quality.fallback_summary(s).select(
        "article_id", "summary_status", "summary_text", F.array_join("dimension_reasons", "|").alias("reasons"))


_INTENT = """select item_id, case item_id % 3 when 0 then 'simple_chat' else 'new_research' end as intent_category,
 cast(item_id % 12 / 10.0 as double) as confidence, case item_id % 4 when 0 then EMPTY_LIST when 1 then ARR('safety') else ARR('a', 'b', 'c', 'd') end as directions,
 item_id % 2 as keyword_count, item_id % 5 as constraint_count, item_id % 6 as max_candidates from benchmark"""


@query(
    "p33_intent_contract",
    f"""with i as ({A.duck(_INTENT)}) select item_id, concat_ws(',', case when intent_category = 'simple_chat' and (len(directions) > 0 or keyword_count > 0 or constraint_count > 0) then 'chat_with_research_fields' end,
 case when not confidence between 0 and 1 then 'confidence_range' end, case when len(directions) > 3 then 'too_many_directions' end,
 case when max_candidates > 3 then 'too_many_candidates' end) as issues from i""",
)
def intent_contract(spark, sf_dir):
    i = A.spark_sql(spark, _INTENT, benchmark=A.table(spark, sf_dir, "benchmark"))
    return records.intent_issues(i).select("item_id", F.array_join("issues", ",").alias("issues"))


@query(
    "p34_search_options",
    f"""with {A.DUCK_REC} select record_id, cast(publication_date as date) as publication_date from rec
 where is_open_access and cast(publication_date as date) between date '2005-01-01' and date '2018-06-30'""",
)
def search_options(spark, sf_dir):
    rec = A.records(spark, sf_dir).withColumn("publication_date", F.col("publication_date").cast("date"))
    return search.search_options(
        rec, dt.date(2005, 1, 1), dt.date(2018, 6, 30), open_access_only=True, order="newest"
    ).select("record_id", "publication_date")


_RESULTS = """select doc_id, case when doc_id % 9 = 0 then ' ' else source end as query,
 case doc_id % 5 when 0 then '' when 1 then '{"overall_summary":"  "}' when 2 then null else '{"overall_summary":" S' || cast(doc_id as string) || ' ","recommendations":[{"a":"1"},{"b":"2"}]}' end as summary,
 case doc_id % 4 when 0 then ' hello ' when 1 then '' end as last_message from documents"""


@query(
    "p35_public_result_contract",
    f"""with r as ({_RESULTS}) select doc_id, concat_ws(',', case when trim(query) = '' then 'no_query' end, case when coalesce(summary, '') = '' then 'no_summary' end,
 case when doc_id % 5 < 3 then 'no_overall_summary' end) as issues, case when doc_id % 4 = 0 then 'hello' when doc_id % 5 >= 3 then 'S' || cast(doc_id as varchar) end as answer,
 case when doc_id % 5 >= 3 then 2 else 0 end as recommendation_count from r""",
)
def public_result_contract(spark, sf_dir):
    r = A.spark_sql(spark, _RESULTS, documents=A.table(spark, sf_dir, "documents"))
    return records.result_issues(r).select(
        "doc_id", F.array_join("issues", ",").alias("issues"), "answer", "recommendation_count")


_RES = """select page_id, url, case page_id % 5 when 0 then 'pdf' when 1 then 'doi' when 2 then 'html' when 3 then null else 'XML' end as original_style,
 case when page_id % 11 = 0 then 'DOI' else 'site' end as site, case page_id % 4 when 0 then 'Open access' when 1 then 'Subscription required' when 2 then 'Free' else 'unsure' end as availability,
 case page_id % 6 when 0 then 'OA' when 1 then 'S' when 2 then null when 3 then 'free' else '' end as availability_code from pages"""


@query(
    "p24_resource_predicates",
    f"""with r as ({_RES}), k as (select *, lower(coalesce(original_style, '')) || ' ' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as hay,
 case when lower(coalesce(availability_code, '')) in ('oa', 'f', 'free') or contains(lower(availability), 'open access') or lower(availability) = 'free' then true
  when lower(coalesce(availability_code, '')) in ('s', 'sub', 'subscription') or contains(lower(availability), 'subscription') then false end as oa
  from r where lower(coalesce(original_style, '')) <> 'doi' and lower(site) <> 'doi' and regexp_matches(url, '^(?i)https?://[^/?#\\s]+'))
 select page_id, case when contains(hay, 'pdf') then 'pdf' when contains(hay, 'epub') then 'epub' when contains(hay, 'htm') then 'html' when contains(hay, 'xml') then 'xml'
 when contains(hay, 'text') or ends_with(hay, '.txt') then 'text' else 'other' end as format, oa as is_open_access, oa as is_downloadable from k""",
)
def resource_predicates(spark, sf_dir):
    r = A.spark_sql(spark, _RES, pages=A.table(spark, sf_dir, "pages"))
    return records.resource_flags(r).select("page_id", "format", "is_open_access", "is_downloadable")


@query(
    "p23_table_rules",
    """select 'status_known' as rule, count(*) filter (where o_orderstatus not in ('O', 'F')) as violations from orders
 union all select 'price_positive', count(*) filter (where not o_totalprice > 1000) from orders
 union all select 'priority_form', count(*) filter (where not regexp_full_match(o_orderpriority, '[1-4]-[A-Z]+')) from orders
 union all select 'line_unique', count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)
 union all select 'order_exists', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
 union all select 'open_order_part_unique', count(*) from (select l_orderkey, l_partkey from lineitem where l_linestatus = 'O' group by 1, 2 having count(*) > 1)
 union all select 'text_not_blank', count(*) filter (where trim(text) = '') from documents""",
)
def table_rules(spark, sf_dir):
    o, li, d = (A.table(spark, sf_dir, t) for t in ("orders", "lineitem", "documents"))
    return (
        quality.table_rules(o, {
            "status_known": F.col("o_orderstatus").isin("O", "F"),
            "price_positive": F.col("o_totalprice") > 1000,
            "priority_form": F.col("o_orderpriority").rlike("^[1-4]-[A-Z]+$"),
        })
        .unionByName(quality.unique_rule(li, "line_unique", ["l_orderkey", "l_linenumber"]))
        .unionByName(quality.reference_rule(li, "order_exists", "l_orderkey", o, "o_orderkey"))
        .unionByName(quality.unique_rule(
            li, "open_order_part_unique", ["l_orderkey", "l_partkey"], F.col("l_linestatus") == "O"))
        .unionByName(quality.table_rules(d, {"text_not_blank": F.trim("text") != ""}))
    )


@query(
    "u01_union_branches",
    """select source, lang, count(*) as n, cast(sum(doc_id) as bigint) as ids from (select doc_id, source, lang from documents where doc_id % 2 = 0
 union all select doc_id, source, null from documents where doc_id % 3 = 0) group by 1, 2""",
)
def union_branches(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    u = records.union_sources(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0").drop("lang"))
    return u.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "u03_set_equality",
    """with l as (select doc_id, count(*) n from labels group by 1), d as (select doc_id, count(*) n from documents group by 1),
 j as (select l.n as a, d.n as b from l full join d on l.doc_id = d.doc_id)
 select count(*) filter (where b is null) as only_left, count(*) filter (where a is null) as only_right, count(*) filter (where a > 1) as repeated_left,
 count(*) filter (where b > 1) as repeated_right, count(*) filter (where a is null or b is null or a > 1 or b > 1) = 0 as equal from j""",
)
def set_equality(spark, sf_dir):
    return audit.set_equal(A.table(spark, sf_dir, "labels"), A.table(spark, sf_dir, "documents"), "doc_id")


@query("u04_difference", "select doc_id from documents except select doc_id from labels")
def difference(spark, sf_dir):
    d, lab = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels")
    return audit.missing(d, lab, ["doc_id"]).select("doc_id")


@query(
    "u05_intersect_available",
    """with w as (select doc_id, case when doc_id % 2 = 0 then ['pubmed', 'pmc', source] else [source, 'europe_pmc'] end as wanted from documents)
 select doc_id, array_to_string(list_filter(wanted, lambda x: list_contains(['pubmed', 'europe_pmc', 'src1', 'src2'], x)), ',') as available from w""",
)
def intersect_available(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    wanted = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("pubmed"), F.lit("pmc"), F.col("source"))).otherwise(
        F.array(F.col("source"), F.lit("europe_pmc")))
    have = F.array(*[F.lit(x) for x in ("pubmed", "europe_pmc", "src1", "src2")])
    return d.select("doc_id", F.array_join(F.array_intersect(wanted, have), ",").alias("available"))


@query(
    "p20_core_match_filter",
    f"""with {DOC_TEXTS} select doc_id, contains(' ' || title_n || ' ', ' thble ') or contains(' ' || body_n || ' ', ' thble ') as core_matched from docs""",
)
def core_match_filter(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    profile = (search.Concept("drug", "thble", ("Thble",)), search.Concept("population", "this", ("this",)))
    return rank.match_concepts(d, profile, F.col("title_n"), F.col("body_n")).select("doc_id", "core_matched")
