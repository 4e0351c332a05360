"""Join operators."""

from pyspark.sql import functions as F

from litmill import scale
from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.functions import values
from litmill.operators import audit, logstore, portfolio, spans, store, vocab
from litmill.sources import vocabulary

_RAW_VOCAB = """select 'http://vocab.example/C/' || cast(p_partkey as string) as class_id, case when p_partkey % 31 = 0 then ' ' else p_name || ' ' || cast(p_partkey DIV 3 as string) end as label,
 upper(p_name) || ' ' || cast(p_partkey DIV 3 as string) || '|' || p_type || '|' || lower(p_type) || ' |' || p_brand as synonyms,
 case when p_partkey % 4 = 0 then 'CUI' || cast(p_partkey as string) else '' end as cui, case when p_size % 10 = 0 then 'true' else 'FALSE' end as obsolete, p_partkey from part"""
DUCK_VOCAB = f"""raw as ({A.duck(_RAW_VOCAB)}), concepts as (select cast(p_partkey as varchar) as concept_id, trim(label) as preferred_label, nullif(trim(cui), '') as cui, upper(obsolete) = 'TRUE' as obsolete, synonyms from raw where trim(label) <> ''),
 each as (select concept_id, 0 as position, preferred_label as term from concepts union all
  select concept_id, generate_subscripts(string_split(synonyms, '|'), 1), trim(unnest(string_split(synonyms, '|'))) from concepts),
 terms as (select concept_id, normalized_term, term, case when position = 0 then 'preferred' else 'entry' end as term_type from
  (select *, row_number() over (partition by concept_id, normalized_term order by position) as rn from (select *, {A.q_collapse(A.q_fold('term'))} as normalized_term from each)) where rn = 1 and normalized_term <> '')"""


def raw_vocab(spark, sf_dir):
    r = A.spark_sql(spark, _RAW_VOCAB, part=A.table(spark, sf_dir, "part"))
    return r.select(
        F.col("class_id").alias("Class ID"), F.col("label").alias("Preferred Label"),
        F.col("synonyms").alias("Synonyms"), F.col("cui").alias("CUI"), F.col("obsolete").alias("Obsolete"))


def vocab_tables(spark, sf_dir):
    return vocabulary.ingest_vocab(raw_vocab(spark, sf_dir))


_LOOKUPS = """select cast(c_custkey as string) as keyword_id, 1 as lookup_order, '  Economy ' as lookup_term from customer where c_custkey % 2 = 0
 union all select cast(c_custkey as string), 2, 'red WIDGET ' || cast(c_custkey as string) from customer union all select cast(c_custkey as string), 3, 'Brand#' || cast(c_custkey % 30 as string) from customer"""
_DUCK_MATCH = f"""{DUCK_VOCAB}, looks as ({_LOOKUPS}), met as (select l.keyword_id, c.concept_id, c.preferred_label, t.term as matched_term, t.term_type as matched_type, l.lookup_order,
 row_number() over (partition by l.keyword_id, c.concept_id order by l.lookup_order, t.term) as rn from looks l join terms t on {A.q_collapse(A.q_fold('l.lookup_term'))} = t.normalized_term
 join concepts c on t.concept_id = c.concept_id where not c.obsolete), matches as (select * exclude (rn) from met where rn = 1)"""


def lookup_tables(spark, sf_dir):
    concepts, terms = vocab_tables(spark, sf_dir)
    return A.spark_sql(spark, _LOOKUPS, customer=A.table(spark, sf_dir, "customer")), terms, concepts


@query("j01_vocab_lookup", f"with {_DUCK_MATCH} select keyword_id, concept_id, preferred_label, matched_term, matched_type, lookup_order from matches")
def vocab_lookup(spark, sf_dir):
    return vocab.vocab_lookup(*lookup_tables(spark, sf_dir))


@query(
    "j02_attach_entry_terms",
    f"with {_DUCK_MATCH} select concept_id, term as entry_term, lower(term) as sort_key from terms where term_type = 'entry' and concept_id in (select concept_id from matches)",
)
def attach_entry_terms(spark, sf_dir):
    looks, terms, concepts = lookup_tables(spark, sf_dir)
    return vocab.entry_terms(vocab.matched_concepts(looks, terms, concepts), terms)


# Plans of every question: all its words, and terms of the vocabulary chosen by its number.
_EXPAND = f"""{DUCK_VOCAB}, n as (select count(*) as n from part), qw as (select item_id, string_split({A.q_match("text")}, ' ') as words from benchmark),
 own0 as (select cast(item_id as varchar) as query_id, 1 as group_id, unnest(words) as term, generate_subscripts(words, 1) as term_order from qw
  union all select cast(item_id as varchar), 2, {A.q_match("p_type")}, 1 from benchmark, n join part on true where p_partkey = 1 + item_id * 7 % n.n
  union all select cast(item_id as varchar), 2, {A.q_match("p_name || ' ' || cast(p_partkey // 3 as varchar)")}, 2 from benchmark, n join part on true where p_partkey = 1 + item_id * 11 % n.n),
 own as (select * from own0 where term <> ''),
 known as (select t.concept_id, t.normalized_term, {A.q_match("t.term")} as synonym from terms t join concepts c on t.concept_id = c.concept_id where not c.obsolete),
 more as (select o.query_id, o.group_id, k2.synonym as term, o.term_order, k.concept_id from own o join known k on o.term = k.normalized_term join known k2 on k.concept_id = k2.concept_id where k2.synonym <> ''),
 allr as (select query_id, group_id, term, term_order, null as concept_id, 0 as syn from own union all select *, 1 from more),
 expanded as (select * from allr qualify row_number() over (partition by query_id, group_id, term order by syn, concept_id, term_order) = 1)"""


@query(
    "p34_synonym_expansion",
    f"with {_EXPAND} select query_id, group_id, term, cast(term_order as int) as term_order, case syn when 0 then 'own' else 'synonym' end as origin, concept_id from expanded",
)
def synonym_expansion(spark, sf_dir):
    b, p = A.table(spark, sf_dir, "benchmark"), A.table(spark, sf_dir, "part")
    n = p.count()
    words = b.select(
        F.col("item_id").cast("string").alias("query_id"), F.lit(1).alias("group_id"),
        F.posexplode(F.split(A.text.match_text(F.col("text")), " ")).alias("at", "term"),
    ).select("query_id", "group_id", "term", (F.col("at") + 1).cast("int").alias("term_order"))

    def drawn(step, term, order):
        asked = b.select("item_id", (1 + F.col("item_id") * step % n).alias("p_partkey")).join(p, "p_partkey")
        return asked.select(F.col("item_id").cast("string").alias("query_id"), F.lit(2).alias("group_id"), term.alias("term"), F.lit(order).alias("term_order"))

    name = F.concat_ws(" ", "p_name", F.expr("p_partkey div 3").cast("string"))
    plan = words.unionByName(drawn(7, F.col("p_type"), 1)).unionByName(drawn(11, name, 2))
    concepts, terms = vocab_tables(spark, sf_dir)
    return vocab.expand_plan(plan, terms, concepts)


@query(
    "a13_plan_metrics",
    f"""with {_DUCK_MATCH}, k as (select distinct keyword_id from looks), n as (select k.keyword_id, count(m.concept_id) as n from k left join matches m on k.keyword_id = m.keyword_id group by 1)
 select count(*) as keywords, count(*) filter (where n > 0) as matched, count(*) filter (where n = 0) as unmatched, cast(sum(n) as bigint) as matches from n""",
)
def plan_metrics(spark, sf_dir):
    return vocab.match_metrics(*lookup_tables(spark, sf_dir))


@query(
    "f06_profile_build",
    f"""with {_DUCK_MATCH}, best as (select keyword_id, preferred_label as preferred from (select *, row_number() over (partition by keyword_id order by lookup_order, concept_id) as r2 from matches) where r2 = 1),
 kw as (select cast(c_custkey as varchar) as keyword_id, c_nationkey as query_id, c_mktsegment as kind, c_custkey as keyword_order from customer),
 own as (select k.*, case when k.keyword_order % 3 = 0 then null else lower(kind) || ' study' end as own, b.preferred from kw k left join best b on k.keyword_id = b.keyword_id),
 heads as (select query_id, kind, coalesce(preferred, own) as head, keyword_order from own where coalesce(preferred, own) is not null),
 firsts as (select * from (select *, row_number() over (partition by query_id, kind, {A.q_match('head')} order by keyword_order) as rn from heads) where rn = 1),
 lines as (select query_id, kind, upper(kind) || ': ' || string_agg(head, ', ' order by keyword_order) as line from firsts group by 1, 2)
 select query_id, 'Research question:' || chr(10) || string_agg(line, chr(10) order by kind) as query_text from lines group by 1""",
)
def profile_build(spark, sf_dir):
    m = vocab.first_matches(*lookup_tables(spark, sf_dir))
    c = A.table(spark, sf_dir, "customer")
    own = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(" "))).otherwise(
        F.array(F.concat(F.lower("c_mktsegment"), F.lit(" study")), F.concat(F.lower("c_mktsegment"), F.lit("  Study!"))))
    kw = c.select(
        F.col("c_custkey").cast("string").alias("keyword_id"), F.col("c_nationkey").alias("query_id"),
        F.col("c_mktsegment").alias("kind"), F.col("c_mktsegment").alias("kind_order"),
        F.col("c_custkey").alias("keyword_order"), F.lit(None).cast("string").alias("raw_text"),
        own.alias("english_candidates"))
    return vocab.profile_lines(kw, m)


@query(
    "j03_provenance_outcome",
    f"""with {A.DUCK_REC} select record_id, case when record_id % 7 <> 0 then 'success' else 'failed' end as normalization_status from rec""",
)
def provenance_outcome(spark, sf_dir):
    rec = A.records(spark, sf_dir).select("record_id", "search_run_id", "source_record_id")
    return store.provenance_outcome(rec, rec.filter("record_id % 7 <> 0")).select("record_id", "normalization_status")


@query(
    "j04_link_source_to_article",
    f"""with {A.DUCK_REC} select record_id, case when record_id % 9 <> 0 then record_id + 1000 end as source_record_pk, case when record_id % 4 <> 0 then record_id DIV 2 end as article_id,
 record_id % 9 = 0 as orphan, case when record_id % 9 <> 0 then greatest(record_id, 500) else record_id end as normalized_at from rec""".replace("DIV", "//"),
)
def link_source_to_article(spark, sf_dir):
    rec = A.records(spark, sf_dir).select(
        "record_id", "search_run_id", "source_record_id", F.col("record_id").alias("record_retrieved_at"))
    keys = ["search_run_id", "source_record_id"]
    rows = rec.filter("record_id % 9 <> 0").select(
        *keys, (F.col("record_id") + 1000).alias("source_record_pk"), F.lit(500).cast("long").alias("row_retrieved_at"))
    arts = rec.filter("record_id % 4 <> 0").select(*keys, F.expr("record_id div 2").alias("article_id"))
    return store.link_sources(rec, rows, arts).select(
        "record_id", "source_record_pk", "article_id", "orphan", "normalized_at")


@query(
    "j05_task_articles",
    """select distinct o.o_custkey as task_id, p.p_partkey as article_id, p.p_name as title from orders o join lineitem l on o.o_orderkey = l.l_orderkey
 join part p on p.p_partkey = l.l_partkey""",
)
def task_articles(spark, sf_dir):
    o, li, p = (A.table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    runs = o.select(F.col("o_orderkey").alias("search_run_id"), F.col("o_custkey").alias("task_id"))
    rows = li.select(F.col("l_orderkey").alias("search_run_id"), F.col("l_partkey").alias("article_id"))
    arts = p.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"))
    return store.task_articles(runs, rows, arts)


# Stored half and arriving half of the records.
def halves(spark, sf_dir):
    rec = A.records(spark, sf_dir)
    stored = rec.filter("record_id % 2 = 0").withColumn("article_id", F.concat(F.lit("a"), F.col("record_id").cast("string")))
    return stored.drop("record_id"), rec.filter("record_id % 2 = 1")


# Text fields that an upsert fills, and those that only a founder gives.
UP = ("doi", "pmid", "pmcid", "first_author", "journal_title", "issn", "publication_date", "language", "abstract")
_HELD = "title, normalized_title, " + ", ".join(UP) + ", publication_year, publication_types, is_retracted"


def duck_matches(stored: str, inc: str, tag: str = "") -> str:
    """CTE matches<tag>: the stored article of each record of inc."""
    same = lambda c: f"i.{c} = s.{c}"
    return f"""hits{tag} as (select i.record_id, s.article_id, 1 as n from {inc} i join {stored} s on {A.q_fold(A.q_strip('i.doi'))} = {A.q_fold(A.q_strip('s.doi'))} where i.doi <> ''
  union all select i.record_id, s.article_id, 2 from {inc} i join {stored} s on {same("pmid")} where i.pmid <> '' union all select i.record_id, s.article_id, 3 from {inc} i join {stored} s on upper(i.pmcid) = upper(s.pmcid) where i.pmcid <> ''
  union all select i.record_id, s.article_id, 4 from {inc} i join {stored} s on {same("normalized_title")} and {same("publication_year")}
   and lower({A.q_strip('i.first_author')}) = lower({A.q_strip('s.first_author')}) where {A.q_strip('i.first_author')} <> ''),
 matches{tag} as (select record_id, article_id, n from (select *, row_number() over (partition by record_id order by n, article_id) as rn from hits{tag}) where rn = 1)"""


def duck_upsert(stored: str, inc: str, tag: str = "") -> str:
    """CTE after<tag>: the articles once inc is merged into stored (needs ``with recursive``)."""
    first = lambda c, cond: f"list(i.{c} order by i.record_id) filter (where {cond})[1] as {c}"
    return f"""{duck_matches(stored, inc, tag)}, fresh{tag} as (select * from {inc} where record_id not in (select record_id from matches{tag})),
 fk{tag} as (select record_id, 'd' || {A.q_fold(A.q_strip('doi'))} as k from fresh{tag} where doi <> '' union all select record_id, 'p' || pmid from fresh{tag} where pmid <> ''
  union all select record_id, 'c' || upper(pmcid) from fresh{tag} where pmcid <> ''
  union all select record_id, 't' || normalized_title || '|' || publication_year || '|' || lower({A.q_strip('first_author')}) from fresh{tag} where {A.q_strip('first_author')} <> ''),
 near{tag} as (select distinct x.record_id as a, y.record_id as b from fk{tag} x join fk{tag} y on x.k = y.k),
 reach{tag} as (select record_id as a, record_id as b from fresh{tag} union select r.a, n.b from reach{tag} r join near{tag} n on r.b = n.a),
 firsts{tag} as (select a as record_id, min(b) as first_id from reach{tag} group by 1),
 joined{tag} as (select record_id, article_id from matches{tag} union all select record_id, 'r' || cast(first_id as varchar) from firsts{tag} where record_id <> first_id),
 base{tag} as (select article_id, {_HELD} from {stored}
  union all select 'r' || cast(record_id as varchar), {_HELD} from fresh{tag} where record_id in (select record_id from firsts{tag} where record_id = first_id)),
 off{tag} as (select m.article_id, {", ".join(first(c, f"i.{c} <> ''") for c in UP)}, {first("publication_year", "i.publication_year is not null")},
  {first("publication_types", "len(i.publication_types) > 0")}, bool_or(i.is_retracted) as is_retracted from joined{tag} m join {inc} i on m.record_id = i.record_id group by 1),
 after{tag} as (select s.article_id, s.title, s.normalized_title, {", ".join(f"coalesce(nullif(s.{c}, ''), o.{c}, s.{c}) as {c}" for c in UP)}, coalesce(s.publication_year, o.publication_year) as publication_year,
  case when len(s.publication_types) > 0 then s.publication_types else coalesce(o.publication_types, s.publication_types) end as publication_types,
  s.is_retracted or coalesce(o.is_retracted, false) as is_retracted from base{tag} s left join off{tag} o on s.article_id = o.article_id)"""


DUCK_STORED = f"""{A.DUCK_REC}, stored as (select 'a' || cast(record_id as varchar) as article_id, * exclude (record_id) from rec where record_id % 2 = 0), inc as (select * from rec where record_id % 2 = 1)"""
DUCK_HALVES = f"{DUCK_STORED}, {duck_matches('stored', 'inc')}"


@query(
    "j06_match_existing_article",
    f"with {DUCK_HALVES} select record_id, article_id, case n when 1 then 'doi' when 2 then 'pmid' when 3 then 'pmcid' else 'title_year_author' end as matched_by from matches",
)
def match_existing_article(spark, sf_dir):
    stored, inc = halves(spark, sf_dir)
    return store.match_existing(inc, stored)


@query(
    "j06_match_by_index",
    f"with {DUCK_HALVES} select record_id, article_id, case n when 1 then 'doi' when 2 then 'pmid' when 3 then 'pmcid' else 'title_year_author' end as matched_by from matches",
)
def match_by_index(spark, sf_dir):
    """The same by a stored index, whose side is not shuffled."""
    stored, inc = halves(spark, sf_dir)
    index = logstore.KeyIndex(scale.new_path(spark, "key-index"), stored.schema["article_id"].dataType)
    index.write(store.long_keys(stored, "article_id").withColumnRenamed("article_id", "owner"), 0)
    hits = index.owners(store.long_keys(inc, "record_id"), spark, [0])
    return store.best_match(hits.withColumnRenamed("owner", "article_id"))


@query(
    "j07_hydrate",
    """with ids as (select l_orderkey as list_id, l_linenumber as pos, l_partkey as article_id from lineitem), a as (select p_partkey as article_id, p_name as title from part where p_partkey % 13 <> 0)
 select i.list_id, i.pos, i.article_id, a.title, a.title is null as missing, count(*) over (partition by i.list_id, i.article_id) > 1 as repeated from ids i left join a on i.article_id = a.article_id""",
)
def hydrate(spark, sf_dir):
    li, p = A.table(spark, sf_dir, "lineitem"), A.table(spark, sf_dir, "part")
    ids = li.select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("article_id"))
    arts = p.filter("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"))
    return store.hydrate(ids, arts).select("list_id", "pos", "article_id", "title", "missing", "repeated")


@query(
    "j08_identifier_convert",
    f"""with {A.DUCK_REC}, x as (select doi, min('PMC' || cast(record_id as varchar)) as pmcid from rec where doi is not null and record_id % 5 <> 0 group by 1)
 select r.record_id, x.pmcid from rec r left join x on r.doi = x.doi""",
)
def identifier_convert(spark, sf_dir):
    rec = A.records(spark, sf_dir)
    table = rec.filter("record_id % 5 <> 0").select("doi", F.concat(F.lit("PMC"), F.col("record_id").cast("string")).alias("pmcid"))
    raw = rec.select("record_id", F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"))
    return store.convert_ids(raw, table, "doi").select("record_id", "pmcid")


@query("j12_missing_keys", "select vec_id, label from embeddings where vec_id not in (select doc_id from labels where quality = 1)")
def missing_keys(spark, sf_dir):
    have = A.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return audit.missing(A.table(spark, sf_dir, "embeddings"), have, ["vec_id"]).select("vec_id", "label")


@query(
    "j13_subset_ids",
    "select doc_id, toxic, doc_id in (select doc_id from documents where doc_id % 3 > 0) as candidate from labels",
)
def subset_ids(spark, sf_dir):
    cands = A.table(spark, sf_dir, "documents").filter("doc_id % 3 > 0")
    yes, no = audit.only_candidates(A.table(spark, sf_dir, "labels"), cands, "doc_id")
    yes = yes.select("doc_id", "toxic", F.lit(True).alias("candidate"))
    return yes.unionByName(no.select("doc_id", "toxic", F.lit(False).alias("candidate")))


# Sentences and three-sentence windows, oracle side.
def _q_pieces(x, src):
    return f"""select article_id, '{src}' as source, unnest(ps) as p, generate_subscripts(ps, 1) as i from (select article_id, regexp_extract_all({x}, '(?s)(?:.*?[.!?。！？](?:[\\s\\x{{a0}}]+|\\z)|.+)') as ps from arts)"""


DUCK_SPANS = f"""arts as (select doc_id as article_id, split_part(text, chr(10), 1) as title, text as abstract from documents),
 pieces as ({_q_pieces('title', 'title')} union all {_q_pieces('abstract', 'abstract')}),
 placed as (select *, coalesce(sum(length(p)) over (partition by article_id, source order by i rows between unbounded preceding and 1 preceding), 0) as off from pieces),
 sents as (select article_id, source, i, off + length(p) - length({A.q_strip('p').replace('|' + A.SPACE + '+$', '')}) as s, off + length({A.q_strip('p').replace('^' + A.SPACE + '+|', '')}) as e from placed where {A.q_strip('p')} <> ''),
 numbered as (select *, row_number() over (partition by article_id, source order by i) - 1 as n from sents),
 spans as (select article_id, source, cast(n // 3 + 1 as integer) as sequence, cast(min(s) as integer) as start_offset, cast(max(e) as integer) as end_offset from numbered group by 1, 2, n // 3)"""


def _articles(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("article_id"), F.expr("split_part(text, chr(10), 1)").alias("title"), F.col("text").alias("abstract"))


@query(
    "w09_sentence_split",
    f"with {DUCK_SPANS} select article_id, cast(n as integer) as sentence, cast(s as integer) as start_offset, cast(e as integer) as end_offset from numbered where source = 'abstract'",
)
def sentence_split(spark, sf_dir):
    d = _articles(spark, sf_dir).select("article_id", "abstract")
    return spans.sentences(d, "abstract").select("article_id", "sentence", "start_offset", "end_offset")


@query(
    "w10_evidence_spans",
    f"""with {DUCK_SPANS} select s.article_id, s.source, s.sequence, s.start_offset, s.end_offset, cast(s.article_id as varchar) || ':' || s.source || ':' || lpad(cast(s.sequence as varchar), 3, '0') as span_id,
 md5(substr(case when s.source = 'title' then a.title else a.abstract end, s.start_offset + 1, s.end_offset - s.start_offset)) as text_md5 from spans s join arts a on s.article_id = a.article_id""",
)
def evidence_spans(spark, sf_dir):
    r = spans.span_rows(_articles(spark, sf_dir), "article_id")
    return r.select("article_id", "source", "sequence", "start_offset", "end_offset", "span_id", F.md5("text").alias("text_md5"))


_CITES = """select doc_id as cite_id, doc_id as article_id, case doc_id % 6
 when 0 then ARR(cast(doc_id as string) || ':title:001', cast(doc_id as string) || ':abstract:001') when 1 then ARR(cast(doc_id as string) || ':abstract:999')
 when 2 then ARR('0:title:001', cast(doc_id as string) || ':title:001') when 3 then ARR(cast(doc_id as string) || ':abstract:001', cast(doc_id as string) || ':abstract:001')
 else ARR(cast(doc_id as string) || ':abstract:001', cast(doc_id as string) || ':title:001') end as span_ids from documents"""


@query(
    "j14_resolve_spans",
    f"""with {DUCK_SPANS}, cites as ({A.duck(_CITES)}), c as (select cite_id, article_id, unnest(span_ids) as span_id from cites),
 named as (select s.article_id as owner, s.source, s.sequence, cast(s.article_id as varchar) || ':' || s.source || ':' || lpad(cast(s.sequence as varchar), 3, '0') as span_id,
  substr(case when s.source = 'title' then a.title else a.abstract end, s.start_offset + 1, s.end_offset - s.start_offset) as t from spans s join arts a on s.article_id = a.article_id),
 g as (select c.cite_id, count(*) as cited, count(*) filter (where owner is null) as unknown, count(*) filter (where owner <> c.article_id) as alien, count(distinct c.span_id) as d,
  string_agg(t, chr(10) order by case source when 'title' then 0 else 1 end, sequence) as quote from c left join named n on c.span_id = n.span_id group by 1),
 i as (select *, concat_ws(',', case when unknown > 0 then 'unknown_span' end, case when alien > 0 then 'foreign_span' end, case when d < cited then 'repeated_span' end) as issues from g)
 select cite_id, cited, issues, case when issues = '' then md5(quote) end as quote_md5 from i""",
)
def resolve_spans(spark, sf_dir):
    cites = A.spark_sql(spark, _CITES, documents=A.table(spark, sf_dir, "documents"))
    rows = spans.span_rows(_articles(spark, sf_dir), "article_id")
    got = spans.resolve_spans(cites, rows, ["cite_id"], "article_id")
    return got.select("cite_id", "cited", F.array_join("issues", ",").alias("issues"), F.md5("quote").alias("quote_md5"))


@query(
    "j15_query_x_vectors",
    """with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, label, round(list_cosine_similarity(cast(embedding as double[]), cast(q.e as double[])), 5) as cosine
 from embeddings, q where list_cosine_similarity(cast(embedding as double[]), cast(q.e as double[])) > 0""",
)
def query_x_vectors(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    scored = e.select("vec_id", "label", values.cosine_to(F.col("embedding"), q).alias("c"))
    return scored.filter("c > 0").select("vec_id", "label", F.round("c", 5).alias("cosine"))


@query(
    "j18_status_snapshot_join",
    """select o_orderkey as batch_id, case when o_orderkey % 10 = 0 then null else o_orderstatus end as status, case when o_orderkey % 10 = 0 then 'missing' when o_orderstatus = 'P' then 'unfinished'
 when o_orderstatus = 'F' then 'completed' else 'not_evaluated' end as outcome from orders where o_orderkey % 3 = 0""",
)
def status_snapshot_join(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    expected = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("batch_id"))
    state = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    ledger = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("batch_id"), state.alias("status"), "o_orderstatus")
    return audit.ledger_status(expected, ledger).select("batch_id", F.col("o_orderstatus").alias("status"), "outcome")


RES = """select page_id, regexp_extract(url, '://([^/]+)', 1) as article_id, url, cast(page_id as string) as resource_id, case page_id % 6 when 0 then 'PDF' when 1 then 'epub' when 2 then 'html' when 3 then 'xml' when 4 then 'text' else 'odd' end as format,
 page_id % 2 = 0 as is_downloadable, page_id % 3 <> 0 as is_open_access, page_id % 7 = 0 as is_preferred, page_id % 5 as run_seq from pages"""
Q_FMT = "case lower(format) when 'pdf' then 0 when 'xml' then 1 when 'html' then 2 when 'epub' then 3 when 'text' then 4 when 'other' then 5 else 99 end"


def resources(spark, sf_dir):
    return A.spark_sql(spark, RES, pages=A.table(spark, sf_dir, "pages"))


@query(
    "j19_attach_resources",
    f"""with r as ({RES}), b as (select * from (select *, row_number() over (partition by article_id order by {Q_FMT}, case when is_preferred then 0 else 1 end, resource_id) as rn from r where is_downloadable and is_open_access) where rn = 1)
 select a.article_id, b.resource_id, lower(b.format) as format, b.url from (select distinct article_id from r) a left join b on a.article_id = b.article_id""",
)
def attach_resources(spark, sf_dir):
    r = resources(spark, sf_dir)
    return portfolio.attach_best_resource(r.select("article_id").distinct(), r)


@query(
    "w08_best_resource",
    f"""with r as ({RES}) select article_id, resource_id, format from (select *, row_number() over (partition by article_id order by case lower(format) when 'pdf' then 0 when 'epub' then 1 when 'html' then 2 when 'xml' then 3
 when 'text' then 4 when 'other' then 5 else 99 end, case when is_preferred then 0 else 1 end, resource_id) as rn from r where is_downloadable) where rn = 1""",
)
def best_resource(spark, sf_dir):
    return portfolio.best_resource(resources(spark, sf_dir), "provider", open_only=False).select("article_id", "resource_id", "format")


@query(
    "w07_one_preferred",
    f"""with r as ({RES}) select page_id, is_downloadable and url = first_value(case when is_downloadable then url end) over (partition by article_id order by case when is_downloadable then 0 else 1 end, run_seq desc, {Q_FMT}, url) as is_preferred from r""",
)
def one_preferred(spark, sf_dir):
    return portfolio.one_preferred(resources(spark, sf_dir)).select("page_id", "is_preferred")


