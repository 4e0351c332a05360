"""Scalar expression queries: identifiers, text, dates, hashes, vectors, JSON."""

import datetime as dt

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.functions import dates, text, values
from litmill.operators import ordering, quality, rank, records

REF = dt.date(2025, 1, 1)
D = A.q_single

# Raw identifier strings of many forms.
RAW_IDS = """
select doc_id,
 case doc_id % 9 when 0 then 'https://doi.org/10.' || cast(doc_id as string) || '/AbC' when 1 then 'doi: 10.1/X' || cast(doc_id as string)
  when 2 then 'HTTP://dx.doi.org/10.5/y' when 3 then ' 10.77/Z  ' when 4 then '10.noslash' when 5 then '' when 6 then cast(doc_id as string)
  when 7 then source else null end as raw_doi,
 case doc_id % 6 when 0 then ' ' || cast(doc_id as string) || ' ' when 1 then 'x' || cast(doc_id as string) when 2 then '' when 3 then null
  when 4 then '12 34' else cast(n_chars as string) end as raw_pmid,
 case doc_id % 7 when 0 then 'pmc' || cast(doc_id as string) when 1 then cast(doc_id as string) when 2 then 'PMC' when 3 then 'PMCx1'
  when 4 then null when 5 then ' PMC77 ' else '' end as raw_pmcid
from documents"""


def raw_ids(spark, sf_dir):
    return A.spark_sql(spark, RAW_IDS, documents=A.table(spark, sf_dir, "documents"))


_DUCK_IDS = f"ids as ({RAW_IDS})"
_DOI = (
    f"{A.q_fold('trim(regexp_replace(regexp_replace(' + A.q_collapse('raw_doi') + ', ' + chr(39) + '^(?i)https?://(?:dx[.])?doi[.]org/' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '^(?i)doi\\s*:\\s*' + chr(39) + ', ' + chr(39) * 2 + '))')}"
)


@query(
    "p01_normalize_doi",
    f"with {_DUCK_IDS}, c as (select doc_id, {_DOI} as s from ids) "
    "select doc_id, case when starts_with(s, '10.') and contains(s, '/') then s end as doi from c",
)
def normalize_doi(spark, sf_dir):
    return raw_ids(spark, sf_dir).select("doc_id", text.doi(F.col("raw_doi")).alias("doi"))


@query(
    "p02_normalize_pmid",
    f"with {_DUCK_IDS}, c as (select doc_id, {A.q_collapse('raw_pmid')} as s from ids) "
    "select doc_id, case when regexp_full_match(s, '[0-9]+') then s end as pmid from c",
)
def normalize_pmid(spark, sf_dir):
    return raw_ids(spark, sf_dir).select("doc_id", text.pmid(F.col("raw_pmid")).alias("pmid"))


@query(
    "p03_normalize_pmcid",
    f"""with {_DUCK_IDS}, c as (select doc_id, upper({A.q_collapse('raw_pmcid')}) as s from ids),
 e as (select doc_id, case when regexp_full_match(s, '[0-9]+') then 'PMC' || s else s end as s from c)
 select doc_id, case when regexp_full_match(s, 'PMC[0-9]+') then s end as pmcid from e""",
)
def normalize_pmcid(spark, sf_dir):
    return raw_ids(spark, sf_dir).select("doc_id", text.pmcid(F.col("raw_pmcid")).alias("pmcid"))


@query("p04_normalize_title", f"select doc_id, {A.q_title('split_part(text, chr(10), 1)')} as title_norm from documents")
def normalize_title(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.title_text(F.expr("split_part(text, chr(10), 1)")).alias("title_norm"))


@query("p05_normalize_identity_text", f"select doc_id, md5({A.q_title('text')}) as identity_md5 from documents")
def normalize_identity_text(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.identity_text(F.col("text"))).alias("identity_md5"))


@query(
    "p06_normalize_term",
    f"select p_partkey, {A.q_collapse(A.q_fold(chr(39) + '  ' + chr(39) + ' || p_name || ' + chr(39) + ' (' + chr(39) + ' || p_type || ' + chr(39) + ')' + chr(39)))} as term from part",
)
def normalize_term(spark, sf_dir):
    d = A.table(spark, sf_dir, "part")
    return d.select("p_partkey", text.term_text(F.expr("'  ' || p_name || ' (' || p_type || ')'")).alias("term"))


@query("p07_normalize_match_text", f"select doc_id, md5({A.q_match('text')}) as match_md5, length({A.q_match('text')}) as n from documents")
def normalize_match_text(spark, sf_dir):
    m = text.match_text(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(m).alias("match_md5"), F.length(m).alias("n"))


@query(
    "p08_single_multi_line",
    f"""with l as (select doc_id, text, unnest(regexp_split_to_array(text, '{text.LINE_BREAK}')) as line,
  generate_subscripts(regexp_split_to_array(text, '{text.LINE_BREAK}'), 1) as i from documents),
 j as (select doc_id, string_agg({A.q_collapse('line')}, chr(10) order by i) as multi from l where {A.q_collapse('line')} <> '' group by doc_id)
 select d.doc_id, md5({A.q_single('d.text')}) as single_md5, md5(j.multi) as multi_md5 from documents d left join j on d.doc_id = j.doc_id""",
)
def single_multi_line(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(text.single_line(F.col("text"))).alias("single_md5"),
        F.md5(text.multi_line(F.col("text"))).alias("multi_md5"),
    )


_URL = "case page_id % 5 when 0 then url when 1 then '  ' || upper(url) when 2 then 'ftp://' || url when 3 then 'https://' else substr(url, 3) end"


@query(
    "p09_http_url_filter",
    f"""with u as (select page_id, {A.q_single(_URL)} as s from pages)
 select page_id, case when regexp_matches(s, '^(?i)https?://') then s end as url_kept,
 case when regexp_matches(s, '^(?i)https?://[^/?#\\s]+') then s end as url_strict from u""",
)
def http_url_filter(spark, sf_dir):
    raw = F.expr(_URL)
    return A.table(spark, sf_dir, "pages").select(
        "page_id", text.http_url(raw).alias("url_kept"), text.http_url(raw, True).alias("url_strict")
    )


_CASTS = """
select o_orderkey,
 case o_orderkey % 8 when 0 then 'Y' when 1 then ' yes ' when 2 then 'TRUE' when 3 then '0' when 4 then 'No' when 5 then 'maybe' when 6 then '1' end as raw_flag,
 case o_orderkey % 5 when 0 then cast(o_custkey as string) when 1 then ' ' || cast(o_custkey as string) || ' ' when 2 then 'x' when 3 then '' end as raw_int,
 case o_orderkey % 6 when 0 then '2024' when 1 then '2024-05' when 2 then '2024-13-01' when 3 then substr(cast(o_orderdate as string), 1, 10)
  when 4 then substr(cast(o_orderdate as string), 1, 10) || 'T00:00:00Z' end as raw_date
from orders"""


@query(
    "p25_lenient_casts",
    f"""with c as ({_CASTS}) select o_orderkey,
 case when lower(trim(raw_flag)) in ('y', 'yes', 'true', '1') then true when lower(trim(raw_flag)) in ('n', 'no', 'false', '0') then false end as flag,
 try_cast(trim(raw_int) as integer) as number,
 case when regexp_full_match(substr(raw_date, 1, 10), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(substr(raw_date, 1, 10) as date) end as day from c""",
)
def lenient_casts(spark, sf_dir):
    c = A.spark_sql(spark, _CASTS, orders=A.table(spark, sf_dir, "orders"))
    return c.select(
        "o_orderkey",
        values.to_bool(F.col("raw_flag")).alias("flag"),
        values.to_int(F.col("raw_int")).alias("number"),
        dates.iso_date(F.col("raw_date")).alias("day"),
    )


REL = """
select doc_id as article_id, doc_id * 13 % 101 / 10.0 as score, doc_id * 29 % 101 / 10.0 as answerability_score,
 case doc_id % 3 when 0 then 'high' when 1 then 'partial' else 'low' end as level from documents"""


@query(
    "p26_relevance_level",
    f"""with r as ({REL}) select article_id, score, case when score >= 8 then 'high' when score >= 4 then 'partial' else 'low' end as expected_level,
 level <> (case when score >= 8 then 'high' when score >= 4 then 'partial' else 'low' end) as mismatch,
 (case when score < 0 or score > 10 then 'score_range,' else '' end) || (case when answerability_score < 0 or answerability_score > 10 then 'answerability_range,' else '' end)
 || (case when level <> (case when score >= 8 then 'high' when score >= 4 then 'partial' else 'low' end) then 'level_mismatch,' else '' end) as issues from r""",
)
def relevance_level(spark, sf_dir):
    r = A.spark_sql(spark, REL, documents=A.table(spark, sf_dir, "documents"))
    r = r.withColumn("score", F.col("score").cast("double")).withColumn(
        "answerability_score", F.col("answerability_score").cast("double"))
    level = quality.relevance_level(F.col("score"))
    return quality.relevance_issues(r).select(
        "article_id", "score", level.alias("expected_level"), (F.col("level") != level).alias("mismatch"),
        F.concat_ws("", F.transform("issues", lambda x: F.concat(x, F.lit(",")))).alias("issues"),
    )


@query(
    "p29_pick_article_id",
    f"""with {A.DUCK_REC} select record_id, coalesce(nullif(trim(source_article_id), ''), nullif(trim(doi), ''), nullif(trim(source_record_id), '')) as article_key from rec""",
)
def pick_article_id(spark, sf_dir):
    rec = A.records(spark, sf_dir)
    key = text.article_key(*[F.col(c) for c in ("source_article_id", "doi", "source_record_id")])
    return rec.select("record_id", key.alias("article_key"))


_STAGE = """case event_type when 'view' then 'searching' when 'click' then 'articles_grouped' when 'signup' then 'created'
 when 'purchase' then 'completed' else 'unheard_of' end"""


@query(
    "p30_stage_map",
    f"""with s as (select event_id, {_STAGE} as raw from events) select event_id, case raw when 'searching' then 'searching'
 when 'articles_grouped' then 'evaluating_evidence' when 'created' then 'created' when 'completed' then 'completed' end as stage from s""",
)
def stage_map(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", records.public_stage(F.expr(_STAGE)).alias("stage"))


@query(
    "f01_hashing",
    """with h as (select doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(text)) as d,
 sha256(text) as text_sha256, substr(sha1(text), 1, 12) as short_sha1,
 sha256('{"doc_id":' || cast(doc_id as varchar) || ',"lang":"' || lang || '","source":"' || source || '"}') as payload_sha256 from documents)
 select doc_id, text_sha256, short_sha1, payload_sha256, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
 substr('89ab89ab89ab89ab', 1 + cast('0x' || substr(d, 17, 1) as integer) % 4, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) as named_uuid from h""",
)
def hashing(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        "doc_id",
        values.sha256(F.col("text")).alias("text_sha256"),
        values.short_sha1(F.col("text")).alias("short_sha1"),
        values.payload_hash("source", "doc_id", "lang").alias("payload_sha256"),
        values.named_uuid(F.col("text")).alias("named_uuid"),
    )


_DATED = """select o_orderkey, case o_orderkey % 4 when 0 then null else cast(o_orderdate as date) end as day,
 case o_orderkey % 8 when 4 then null else cast(substr(cast(o_orderdate as string), 1, 4) as int) end as yr from orders"""
Q_RECENCY = "coalesce(20 + 80 * exp(-(greatest(0, date_diff('day', coalesce({d}, make_date({y}, 7, 1)), date '2025-01-01') / 365.25)) / 7), 50)"


@query("f02_recency", f"with o as ({_DATED}) select o_orderkey, round({Q_RECENCY.format(d='day', y='yr')}, 6) as recency from o")
def recency(spark, sf_dir):
    o = A.spark_sql(spark, _DATED, orders=A.table(spark, sf_dir, "orders"))
    return o.select("o_orderkey", F.round(dates.recency(F.col("day"), F.col("yr"), REF), 6).alias("recency"))


@query(
    "f03_cosine",
    """with q as (select embedding as e from embeddings where vec_id = 0)
 select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(q.e as double[])), 5) as cosine,
 round((list_cosine_similarity(cast(embedding as double[]), cast(q.e as double[])) + 1) / 2 * 100, 3) as score from embeddings, q""",
)
def cosine(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    # One row by its key: the query vector is a parameter of the scan, not a join.
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    c = values.cosine_to(F.col("embedding"), q)
    return e.select("vec_id", F.round(c, 5).alias("cosine"), F.round(values.similarity_score(c), 3).alias("score"))


@query(
    "f04_embedding_text",
    f"""with {A.DUCK_REC}, b as (select *, {A.q_strip("coalesce(abstract, '')")} as body from rec)
 select record_id, md5('Title: ' || {A.q_strip('title')} || chr(10) || chr(10) || 'Keywords: ' || array_to_string(keywords, ', ')
 || case when body <> '' then chr(10) || chr(10) || 'Abstract: ' || body else '' end) as text_md5 from b""",
)
def embedding_text(spark, sf_dir):
    t = text.embedding_text(F.col("title"), F.col("keywords"), F.col("abstract"))
    return A.records(spark, sf_dir).select("record_id", F.md5(t).alias("text_md5"))


@query(
    "f05_selection_reasons",
    f"""with {A.DUCK_REC} select record_id, concat_ws('|', case when record_id % 2 = 0 then '{rank.REASON_CORE}' end,
 case when record_id % 3 = 0 then '{rank.REASON_MATCH}' || language || '、' || source end,
 case when publication_date is not null or publication_year is not null then '{rank.REASON_DATE}' else '{rank.REASON_NO_DATE}' end) as reasons from rec""",
)
def selection_reasons(spark, sf_dir):
    none = F.array().cast("array<string>")
    matched = F.when(F.col("record_id") % 3 == 0, F.array("language", "source")).otherwise(none)
    r = rank.selection_reasons(
        F.col("record_id") % 2 == 0, matched, F.col("publication_date"), F.col("publication_year"))
    return A.records(spark, sf_dir).select("record_id", F.array_join(r, "|").alias("reasons"))


_NAMES = """select c_custkey, case when c_custkey % 5 = 0 then ' The  Group ' end as collective,
 case when c_custkey % 3 = 0 then null else substr(c_mktsegment, 1, 4) end as given,
 case when c_custkey % 3 <> 2 and c_custkey % 4 <> 1 then c_name end as family, case when c_custkey % 2 = 0 then 'AB' end as initials,
 c_name || ', ' || c_mktsegment as listed from customer"""


@query(
    "f07_author_names",
    f"""with n as ({_NAMES}) select c_custkey, coalesce({D('collective')}, nullif(concat_ws(' ', {D('given')}, {D('family')}), ''), {D('initials')}) as full_name,
 {D('split_part(listed, ' + chr(39) + ',' + chr(39) + ', 1)')} as first_author from n""",
)
def author_names(spark, sf_dir):
    n = A.spark_sql(spark, _NAMES, customer=A.table(spark, sf_dir, "customer"))
    return n.select(
        "c_custkey",
        text.person_name(*[F.col(c) for c in ("collective", "given", "family", "initials")]).alias("full_name"),
        text.first_author(F.col("listed")).alias("first_author"),
    )


_PARTS = """select o_orderkey, case when o_orderkey % 11 = 0 then null else substr(cast(o_orderdate as string), 1, 4) end as y,
 case o_orderkey % 5 when 0 then null when 1 then 'Mar' when 2 then 'december' when 3 then 'zzz' else cast(1 + o_orderkey % 14 as string) end as m,
 case o_orderkey % 3 when 0 then null else cast(1 + o_orderkey % 28 as string) end as d from orders"""
_MONTH = """case when regexp_full_match(m, '[0-9]+') and cast(m as integer) between 1 and 12 then cast(m as integer)
 when lower(substr(m, 1, 3)) = 'mar' then 3 when lower(substr(m, 1, 3)) = 'dec' then 12 end"""


@query(
    "f08_partial_dates",
    f"""with p as ({_PARTS}), q as (select *, {_MONTH.replace("cast(m as integer)", "try_cast(m as integer)")} as mn from p)
 select o_orderkey, case when mn is not null and d is not null then y || '-' || lpad(cast(mn as varchar), 2, '0') || '-' || lpad(d, 2, '0')
 when mn is not null then y || '-' || lpad(cast(mn as varchar), 2, '0') else y end as stated,
 case when y is not null then y || coalesce('-' || case when regexp_full_match(m, '[0-9]') then '0' || m else m end, '')
 || coalesce('-' || case when regexp_full_match(d, '[0-9]') then '0' || d else d end, '') end as padded from q""",
)
def partial_dates(spark, sf_dir):
    p = A.spark_sql(spark, _PARTS, orders=A.table(spark, sf_dir, "orders"))
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    stated = F.when(y.isNotNull(), dates.partial_date(y, m, d))
    return p.select("o_orderkey", stated.alias("stated"), dates.padded_date(y, m, d).alias("padded"))


_FMT = "case page_id % 7 when 0 then 'pdf' when 1 then 'epub' when 2 then 'html' when 3 then 'xml' when 4 then 'text' when 5 then 'other' end"


@query(
    "f09_file_names",
    f"""select page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') || case {_FMT} when 'pdf' then '.pdf' when 'epub' then '.epub'
 when 'html' then '.html' when 'xml' then '.xml' when 'text' then '.txt' else '.bin' end as file_name from pages""",
)
def file_names(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select(
        "page_id", text.safe_file_name(F.col("url"), F.expr(_FMT)).alias("file_name"))


@query(
    "f10_json_navigate",
    "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events where cast(json_extract_string(props, '$.k') as integer) > 50",
)
def json_navigate(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return A.table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k > 50")


@query(
    "f12_array_tests",
    """with a as (select l_orderkey, list(l_partkey order by l_partkey) as parts, list(l_suppkey) as supps from lineitem group by 1)
 select l_orderkey, list_contains(parts, 7) as has_seven, len(parts) <> len(list_distinct(parts)) as repeated,
 array_to_string(list_filter(parts, lambda x: x % 2 = 0), ',') as even_parts,
 len(list_filter(list_distinct(parts), lambda x: not list_contains(supps, x))) as not_supplier from a""",
)
def array_tests(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    # Order lines per order: a handful by the schema of the table.
    a = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list("l_partkey")).alias("parts"), F.collect_list("l_suppkey").alias("supps"))
    return a.select(
        "l_orderkey",
        F.array_contains("parts", 7).alias("has_seven"),
        (F.size("parts") != F.size(F.array_distinct("parts"))).alias("repeated"),
        F.array_join(F.filter("parts", lambda x: x % 2 == 0), ",").alias("even_parts"),
        F.size(F.array_except("parts", "supps")).alias("not_supplier"),
    )


@query(
    "f14_payload_masking",
    f"""select conv_id, string_agg(role || ':' || case when role = 'system' then '{values.MASK}' else text end, chr(10) order by turn) as masked
 from conversations group by 1""",
)
def payload_masking(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    packed = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    masked = values.without_system_text(F.col("m"))
    lines = F.transform(masked, lambda x: F.concat_ws(":", x["role"], x["content"]))
    return packed.select("conv_id", F.array_join(lines, "\n").alias("masked"))


@query(
    "a07_union_text_list",
    f"""with w as (select item_id, unnest(string_split(text, ' ')) as t, generate_subscripts(string_split(text, ' '), 1) as i from benchmark),
 k as (select *, {A.q_match('t')} as nk, row_number() over (partition by item_id, {A.q_match('t')} order by i) as rn from w)
 select item_id, string_agg({A.q_strip('t')}, ' ' order by i) as terms from k where nk <> '' and rn = 1 group by 1""",
)
def union_text_list(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(ordering.distinct_terms(F.split("text", " ")), " ").alias("terms"))
