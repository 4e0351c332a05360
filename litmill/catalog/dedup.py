"""Entity resolution queries."""

from pyspark.sql import functions as F

from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.operators import resolve


@query("d01_identity_keys", f"with {A.DUCK_KEYS} select record_id, kind, value from keys")
def identity_keys(spark, sf_dir):
    return resolve.identity_keys(A.records(spark, sf_dir))


@query(
    "d02_connected_components",
    f"with recursive {A.DUCK_CLUSTERS} select record_id, cluster from members",
)
def connected_components(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    return resolve.assign(rec, clusters).select("record_id", "cluster")


@query(
    "d03_matched_keys",
    f"""with recursive {A.DUCK_CLUSTERS} select c.cluster, k.kind, k.value, count(*) as n
 from keys k join clusters c on k.record_id = c.record_id group by 1, 2, 3 having count(*) > 1""",
)
def matched_keys(spark, sf_dir):
    _, keys, clusters = A.resolved(spark, sf_dir)
    return resolve.matched_keys(keys, clusters)


@query(
    "d04_identity_conflicts",
    f"""with recursive {A.DUCK_CLUSTERS} select c.cluster, k.kind, count(distinct k.value) as "values"
 from keys k join clusters c on k.record_id = c.record_id where k.kind <> 'title_year_author'
 group by 1, 2 having count(distinct k.value) > 1""",
)
def identity_conflicts(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    return resolve.conflicts(rec, clusters)


@query(
    "d05_canonical_member",
    f"with recursive {A.DUCK_CLUSTERS} select cluster, record_id as canonical_id from ranked where pos = 1",
)
def canonical_member(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    return resolve.canonical(rec, clusters)


_FIRST = "".join(
    f", list({c} order by pos) filter (where {c} <> '')[1] as {c}"
    for c in ("doi", "pmid", "pmcid", "first_author", "journal_title", "issn",
              "publication_date", "language")
)
_MERGED = f"""merged as (select cluster, count(*) as member_count{_FIRST},
 list(preprint_server order by pos) filter (where preprint_server <> '')[1] as server,
 list(publication_year order by pos) filter (where publication_year is not null)[1] as publication_year,
 list(record_id order by pos)[1] as canonical_id, list(source order by pos)[1] as source,
 list(title order by pos)[1] as title, list(normalized_title order by pos)[1] as normalized_title,
 list(abstract order by length(abstract) desc, pos) filter (where abstract <> '')[1] as abstract,
 max(case peer_review_status when 'peer_reviewed' then 2 when 'unknown' then 1 else 0 end) as st,
 max(preprint_version) as preprint_version, max(citation_count) as citation_count,
 bool_or(is_open_access) as is_open_access, bool_or(abstract_available) as abstract_available,
 bool_or(has_full_text) as has_full_text, bool_or(can_download_full_text) as can_download_full_text,
 bool_or(is_retracted) as is_retracted from ranked group by cluster)"""
DUCK_LISTS = f"""items as (select cluster, pos, i, kw, {A.q_title('kw')} as nk from
  (select cluster, pos, generate_subscripts(keywords, 1) as i, unnest(keywords) as kw from ranked)),
 kept as (select cluster, kw, pos, i, row_number() over (partition by cluster, nk order by pos, i) as rn from items where nk is not null),
 kws as (select cluster, string_agg(kw, ';' order by pos, i) as keywords from kept where rn = 1 group by cluster)"""


@query(
    "d06_merge_cluster",
    f"""with recursive {A.DUCK_CLUSTERS}, {_MERGED}, {DUCK_LISTS}
 select m.cluster, canonical_id, member_count, source, title, normalized_title, md5(abstract) as abstract_md5,
 doi, pmid, pmcid, first_author, journal_title, issn, publication_date, publication_year, language,
 case st when 2 then 'peer_reviewed' when 1 then 'unknown' else 'preprint' end as peer_review_status,
 case when st = 0 then server end as preprint_server, preprint_version, citation_count, is_open_access,
 abstract_available, has_full_text, can_download_full_text, is_retracted, k.keywords
 from merged m left join kws k on m.cluster = k.cluster""",
)
def merge_cluster(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    out = resolve.merge_clusters(rec, clusters)
    return out.select(
        "cluster", "canonical_id", "member_count", "source", "title", "normalized_title",
        F.md5("abstract").alias("abstract_md5"), "doi", "pmid", "pmcid", "first_author",
        "journal_title", "issn", "publication_date", "publication_year", "language",
        "peer_review_status", "preprint_server", "preprint_version", "citation_count",
        "is_open_access", "abstract_available", "has_full_text", "can_download_full_text",
        "is_retracted", F.array_join("keywords", ";").alias("keywords"),
    )


@query(
    "d07_cluster_id",
    f"""with recursive {A.DUCK_CLUSTERS}, idents as (
 select c.cluster, 'keys|' || count(*) || '|' || sum(('0x' || substr(md5(k.kind || ':' || k.value), 1, 15))::bigint)
 || '|' || sum(('0x' || substr(md5(k.kind || ':' || k.value), 16, 15))::bigint) as identity
 from keys k join clusters c on k.record_id = c.record_id group by 1
 union all select record_id, 'unidentified:' || normalized_title || ':' || cast(record_id as varchar) from rec
  where record_id not in (select record_id from keys))
 select cluster, substr(sha256(identity), 1, 24) as cluster_id from idents""",
)
def cluster_id(spark, sf_dir):
    rec, keys, clusters = A.resolved(spark, sf_dir)
    return resolve.cluster_ids(keys, clusters, rec)


@query(
    "d08_dedup_metrics",
    f"""with recursive {A.DUCK_CLUSTERS}, odd as (select c.cluster from keys k join clusters c
  on k.record_id = c.record_id where k.kind <> 'title_year_author' group by c.cluster, k.kind
  having count(distinct k.value) > 1)
 select count(*) as input_count, count(distinct cluster) as unique_count,
 count(*) - count(distinct cluster) as duplicate_count,
 (select count(distinct cluster) from odd) as conflict_count from members""",
)
def dedup_metrics(spark, sf_dir):
    rec, _, clusters = A.resolved(spark, sf_dir)
    return resolve.dedup_metrics(rec, clusters)


@query(
    "d09_link_pairs",
    f"""with recursive {A.DUCK_CLUSTERS}, shared as (select kind, value from keys group by 1, 2 having count(*) > 1),
 kinds as (select k.record_id, string_agg(distinct k.kind, ',' order by k.kind) as kinds from keys k
  join shared s on k.kind = s.kind and k.value = s.value group by 1),
 best as (select cluster, record_id as canonical_id from ranked where pos = 1)
 select c.record_id as member_id, b.canonical_id, n.kinds from clusters c join best b on c.cluster = b.cluster
 left join kinds n on c.record_id = n.record_id where c.record_id <> b.canonical_id""",
)
def link_pairs(spark, sf_dir):
    rec, keys, clusters = A.resolved(spark, sf_dir)
    return resolve.link_pairs(rec, keys, clusters)
