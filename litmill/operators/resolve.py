"""Resolve duplicate records into canonical articles.

``record_id`` is any unique, ordered id; its order is the input order.  Only
thin columns (ids and keys) take part in the graph work; texts join back last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill import scale
from litmill.functions import text

# Source ranking used to choose the canonical member.
SOURCE_PRIORITY = {
    "europe_pmc": 5, "pmc": 4, "pubmed": 3, "semantic_scholar": 2, "biorxiv": 1, "medrxiv": 0,
}
REVIEW_PRIORITY = {"peer_reviewed": 2, "unknown": 1, "preprint": 0}
STRONG_IDS = ("doi", "pmid", "pmcid")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def key_array(with_authors: bool = False) -> Column:
    """All identity keys of a record as an array of (kind, value)."""

    def key(kind: str, present: Column, value: Column) -> Column:
        return F.when(present, F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    strong = [_filled(F.col(c)) for c in STRONG_IDS]
    author = text.identity_text(F.col("first_author"))
    if with_authors:
        author = F.coalesce(
            author, text.identity_text(F.get(F.col("authors"), F.lit(0))["full_name"])
        )
    weak = F.concat_ws(
        "|", F.col("normalized_title"), F.col("publication_year").cast("string"), author
    )
    use_weak = (
        ~(strong[0] | strong[1] | strong[2])
        & F.col("publication_year").isNotNull()
        & author.isNotNull()
        & F.col("normalized_title").isNotNull()
    )
    return F.array_compact(
        F.array(
            key("doi", strong[0], text.fold(text.strip(F.col("doi")))),
            key("pmid", strong[1], text.strip(F.col("pmid"))),
            key("pmcid", strong[2], F.upper(text.strip(F.col("pmcid")))),
            key("title_year_author", use_weak, weak),
        )
    )


def identity_keys(records: DataFrame) -> DataFrame:
    """(record_id, kind, value): strong identifiers, or title+year+author if there is none."""
    # The outer form does not test the array's size first, which would build it twice.
    keys = F.explode_outer(key_array("authors" in records.columns)).alias("k")
    return records.select("record_id", keys).filter("k is not null").select(
        "record_id", "k.kind", "k.value"
    )


def _best(edges: DataFrame) -> DataFrame:
    """Least out-neighbour of each node."""
    return edges.groupBy("src").agg(F.min("dst").alias("best"))


def _jump(edges: DataFrame) -> DataFrame:
    """Point every node at the least out-neighbour of what it points at (large star)."""
    best = _best(edges).withColumnRenamed("src", "dst")
    moved = edges.join(best, ["dst"], "left")
    return moved.select("src", F.coalesce("best", "dst").alias("dst")).distinct()


def _gather(edges: DataFrame) -> DataFrame:
    """Point every node and all its out-neighbours at the least of them (small star)."""
    best = _best(edges)
    met = edges.join(best, ["src"], "inner")
    pairs = met.select(F.col("dst").alias("src"), F.col("best").alias("dst"))
    own = best.withColumnRenamed("best", "dst")
    return pairs.filter("src <> dst").unionByName(own).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True when each node has one target and no target points further; one pass over the ends of all edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    wrong = (F.sum("out") > 1) | ((F.sum("out") > 0) & (F.sum("into") > 0))
    return not ends.groupBy("node").agg(wrong.alias("wrong")).agg(F.bool_or("wrong")).first()[0]


def staged_keys(records: DataFrame) -> DataFrame:
    """Identity keys, written once: components and digests read them without the records."""
    return scale.stage(identity_keys(records), "identity-keys")


def components(keys: DataFrame, max_rounds: int = 60, staged: bool = False) -> DataFrame:
    """(record_id, cluster): records that share a key, directly or through others.

    ``cluster`` is the least record id of the component.  A key's holders are
    joined to its least holder (a star, never a clique), so a key held by a
    third of all records costs one row per record.  Large-star and small-star
    rounds then run until every component is one star; each round is written
    out, which bounds lineage.  Records without keys are not listed.  ``staged``
    keys are a table already and are not written again.
    """
    keys = keys.select("record_id", "kind", "value")
    if not staged:
        keys = scale.stage(keys, "identity-keys")
    hubs = (
        keys.groupBy("kind", "value")
        .agg(F.min("record_id").alias("hub"), F.max("record_id").alias("_last"))
        .filter("hub <> _last")
        .drop("_last")
    )
    edges = (
        keys.join(hubs, ["kind", "value"], "inner")
        .filter("record_id <> hub")
        .select(F.col("record_id").alias("src"), F.col("hub").alias("dst"))
        .distinct()
    )
    edges = scale.stage(edges, "edges")
    for _ in range(max_rounds):
        if _is_forest_of_stars(edges):
            break
        # Both halves of the round read the same jumped edges, whose exchange Spark computes once.
        edges = scale.stage(_gather(_jump(edges)), "edges")
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    stars = edges.select(F.col("src").alias("record_id"), F.col("dst").alias("cluster"))
    nodes = keys.select("record_id").distinct()
    return nodes.join(stars, "record_id", "left").select(
        "record_id", F.coalesce("cluster", "record_id").alias("cluster")
    )


def assign(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Records with their cluster; a record without keys is its own cluster."""
    return records.join(clusters, "record_id", "left").withColumn(
        "cluster", F.coalesce("cluster", "record_id")
    )


def _keys_in_clusters(keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct keys per cluster with how often each occurs."""
    return (
        keys.join(clusters, "record_id")
        .groupBy("cluster", "kind", "value")
        .agg(F.count("*").alias("n"))
    )


def matched_keys(keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """Keys held by more than one member of their cluster."""
    return _keys_in_clusters(keys, clusters).filter("n > 1")


def conflicts(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters that hold two or more values of one strong identifier (kept, only reported)."""
    strong = identity_keys(records).filter(F.col("kind") != "title_year_author")
    values = _keys_in_clusters(strong, clusters).groupBy("cluster", "kind").agg(
        F.count("*").alias("values")
    )
    return values.filter("values > 1")


def member_order() -> Column:
    """Sort key of cluster members, best first."""
    rank = F.coalesce(-F.col("source_rank"), F.lit(-100_000))
    ids = sum((_filled(F.col(c)).cast("int") for c in STRONG_IDS), F.lit(0))
    ids = F.coalesce(ids, F.lit(0))
    flags = [
        F.coalesce(F.col(c).cast("int"), F.lit(0))
        for c in ("can_download_full_text", "abstract_available", "has_full_text")
    ]
    parts = [
        F.coalesce(F.try_element_at(_map(REVIEW_PRIORITY), F.col("peer_review_status")), F.lit(0)),
        *flags,
        ids,
        F.coalesce(F.try_element_at(_map(SOURCE_PRIORITY), F.col("source")), F.lit(0)),
        rank,
    ]
    return F.struct(*[(-p).alias(f"p{i}") for i, p in enumerate(parts)], F.col("record_id"))


def canonical(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, canonical_id): the best member of each cluster."""
    return (
        assign(records, clusters)
        .groupBy("cluster")
        .agg(F.min(member_order())["record_id"].alias("canonical_id"))
    )


# ---- aggregate expressions; ``order`` ranks the members of a group, best first ----


def first_filled(name: str, order: Column) -> Column:
    """First value, in the given order, that is neither null nor an empty text."""
    c = F.col(name)
    return F.min_by(F.when(_filled(c), c), F.when(_filled(c), order))


def first_value(name: str, order: Column) -> Column:
    """First value that is not null (0 and false count as values)."""
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), order))


def longest_text(name: str, order: Column) -> Column:
    """Longest non-empty text, first in order on ties."""
    c = F.col(name)
    return F.min_by(c, F.when(_filled(c), F.struct(-F.length(c), order)))


def tri_state_or(name: str) -> Column:
    """True if any is true, else false if any is false, else null."""
    return F.bool_or(F.col(name))


def any_flag(name: str) -> Column:
    return F.coalesce(F.bool_or(F.col(name)), F.lit(False))


def best_review_status(name: str = "peer_review_status") -> Column:
    rank = F.coalesce(F.try_element_at(_map(REVIEW_PRIORITY), F.col(name)), F.lit(0))
    return F.max_by(F.col(name), rank)


def union_texts(
    members: DataFrame, by: str, order: Column, name: str, key=text.identity_text
) -> DataFrame:
    """(by, item, item_order): distinct list items per group, first seen first.

    Long form: a hot group's list is never gathered in one task.  Sort by
    ``item_order`` to read a list in order.
    """
    items = members.select(
        by, order.alias("_o"), F.posexplode(F.col(name)).alias("_at", "item")
    ).withColumn("_key", key(F.col("item")))
    first = F.min(F.struct(F.struct("_o", "_at").alias("item_order"), F.col("item")))
    return (
        items.filter("_key is not null and _key <> ''")
        .groupBy(by, "_key")
        .agg(first.alias("_f"))
        .select(by, "_f.item", "_f.item_order")
    )


def union_resources(members: DataFrame, by: str, order: Column) -> DataFrame:
    """Distinct full-text resources per group on (format, folded URL), first seen first."""
    res = members.select(
        by, order.alias("_o"), F.posexplode("full_text_resources").alias("_at", "resource")
    )
    return (
        res.groupBy(
            by,
            F.col("resource.format").alias("_fmt"),
            text.fold(F.col("resource.url")).alias("_url"),
        )
        .agg(F.min_by("resource", F.struct("_o", "_at")).alias("resource"),
             F.min(F.struct("_o", "_at")).alias("item_order"))
        .select(by, "resource", "item_order")
    )


def _pack(items: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Lists again, for the record contract: one array per group of distinct items."""
    return items.groupBy(by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("item_order", F.col(value).alias("v")))),
            lambda x: x["v"],
        ).alias(name)
    )


def _pack_texts(members: DataFrame, by: str, order: Column, names: list[str]) -> DataFrame:
    """Several text lists united in one pass; one array column per list."""

    def tagged(name: str) -> Column:
        return F.transform(
            F.coalesce(name, F.array().cast("array<string>")),
            lambda x, i: F.struct(F.lit(name).alias("list"), i.alias("at"), x.alias("item")),
        )

    rows = members.select(
        by, order.alias("_o"), F.explode(F.concat(*[tagged(n) for n in names])).alias("x")
    ).withColumn("_key", text.identity_text(F.col("x.item")))
    firsts = (
        rows.filter("_key is not null")
        .groupBy(by, F.col("x.list").alias("list"), "_key")
        .agg(F.min(F.struct(F.struct("_o", "x.at").alias("o"), F.col("x.item").alias("v"))).alias("f"))
    )
    packed = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("list") == n, F.col("f")))), lambda x: x["v"]
        ).alias(n)
        for n in names
    ]
    return firsts.groupBy(by).agg(*packed)


_FIRST_FILLED = (
    "doi", "pmid", "pmcid", "published_doi", "first_author", "journal_title",
    "journal_abbreviation", "issn", "electronic_issn", "publication_date", "study_design",
    "publication_status", "language", "preprint_server", "license", "landing_url",
)


def merge_clusters(records: DataFrame, clusters: DataFrame, pack_lists: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """One merged row per cluster.

    Lists are united into arrays of distinct items, whole at every size; where an
    article may list more than a row should hold, turn ``pack_lists`` off and take
    the long forms that ``union_texts`` and ``union_resources`` give.

    Thin fields are merged with map-side-combined aggregates.  Titles and
    abstracts stay out of that shuffle: only the winning record ids travel, and
    the texts join back by record id.  A preprint server is kept only when the
    merged status is preprint, as the record contract demands.  ``texts`` holds
    the same records, others too, where reading them costs less than ``records``.
    """
    texts = records if texts is None else texts
    order = member_order()
    members = assign(records, clusters)
    have = set(records.columns)
    aggs = [first_filled(c, F.col("_o")).alias(c) for c in _FIRST_FILLED if c in have]
    if "publication_year" in have:
        aggs.append(first_value("publication_year", F.col("_o")).alias("publication_year"))
    if "authors" in have:
        filled = F.size("authors") > 0
        aggs.append(
            F.min_by(F.col("authors"), F.when(filled, F.col("_o"))).alias("authors")
        )
    aggs += [best_review_status().alias("peer_review_status")]
    aggs += [F.max(c).alias(c) for c in ("preprint_version", "citation_count") if c in have]
    aggs += [tri_state_or("is_open_access").alias("is_open_access")]
    aggs += [
        any_flag(c).alias(c)
        for c in ("abstract_available", "has_full_text", "can_download_full_text", "is_retracted")
        if c in have
    ]
    if "retrieved_at" in have:
        aggs.append(F.max("retrieved_at").alias("retrieved_at"))

    # Written once without the texts: the thin fields and the lists are read from it.
    heavy = {"title", "normalized_title", "abstract"}
    members = scale.stage(
        members.select(*[c for c in members.columns if c not in heavy], F.length("abstract").alias("_len")).withColumn("_o", order),
        "members",
    )
    order = F.col("_o")
    thin = members.drop("publication_types", "keywords", "full_text_resources")
    merged = thin.groupBy("cluster").agg(
        F.min("_o")["record_id"].alias("canonical_id"),
        F.min_by(
            "record_id", F.when(F.col("_len") > 0, F.struct(-F.col("_len"), F.col("_o")))
        ).alias("_abstract_id"),
        F.count("*").alias("member_count"),
        *aggs,
    )
    if "preprint_server" in have:
        merged = merged.withColumn(
            "preprint_server",
            F.when(F.col("peer_review_status") == "preprint", F.col("preprint_server")),
        )
    identity = texts.select(
        F.col("record_id").alias("canonical_id"), "source", "source_record_id",
        "search_run_id", "title", "normalized_title",
    )
    abstracts = texts.select(F.col("record_id").alias("_abstract_id"), "abstract")
    # Without any abstract the canonical member's own (blank) one is looked up, so that
    # no crowd of null keys meets in one task.
    merged = merged.withColumn("_abstract_id", F.coalesce("_abstract_id", "canonical_id"))
    out = merged.join(identity, "canonical_id").join(abstracts, "_abstract_id")
    out = out.drop("_abstract_id").withColumn("abstract", text.null_if_empty(F.col("abstract")))
    if pack_lists:
        names = [n for n in ("publication_types", "keywords") if n in have]
        if names:
            out = out.join(_pack_texts(members, "cluster", order, names), "cluster", "left")
            out = out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in names})
        if "full_text_resources" in have:
            res = _pack(
                union_resources(members, "cluster", order), "cluster", "resource",
                "full_text_resources",
            )
            out = out.join(res, "cluster", "left")
    return out


def cluster_ids(keys: DataFrame, clusters: DataFrame, records: DataFrame) -> DataFrame:
    """(cluster, cluster_id): hash of a digest of all members' keys, repeats counted, in no order.

    The digest is the number of keys and two sums of 60 bits each of their MD5
    values, so a cluster of any size is summed where its rows lie.  A cluster
    without keys hashes its title and input position.
    """
    bits = F.md5(F.concat_ws(":", "kind", "value"))
    part = lambda at: F.sum(F.conv(F.substring(bits, at, 15), 16, 10).cast("decimal(38,0)"))
    digests = (
        keys.join(clusters, "record_id")
        .groupBy("cluster")
        .agg(F.concat_ws("|", F.lit("keys"), F.count("*"), part(1), part(16)).alias("identity"))
    )
    bare = records.join(keys.select("record_id").distinct(), "record_id", "left_anti").select(
        F.col("record_id").alias("cluster"),
        F.concat_ws(
            ":", F.lit("unidentified"), "normalized_title", F.col("record_id").cast("string")
        ).alias("identity"),
    )
    return digests.unionByName(bare).select(
        "cluster", F.substring(F.sha2(F.col("identity"), 256), 1, 24).alias("cluster_id")
    )


def dedup_metrics(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: input, unique, duplicate and conflicting-cluster counts."""
    all_members = assign(records.select("record_id"), clusters)
    counts = all_members.groupBy("cluster").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_count"),
        F.count("*").alias("unique_count"),
    )
    odd = conflicts(records, clusters).select("cluster").distinct().agg(
        F.count("*").alias("conflict_count")
    )
    return counts.select(
        "input_count",
        "unique_count",
        (F.col("input_count") - F.col("unique_count")).alias("duplicate_count"),
        odd.scalar().alias("conflict_count"),
    )


def link_pairs(records: DataFrame, keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """(member, canonical, kinds): each duplicate, what it was merged into, and by which kinds."""
    shared = keys.groupBy("kind", "value").count().filter("count > 1").select("kind", "value")
    kinds = (
        keys.join(shared, ["kind", "value"], "left_semi")
        .groupBy("record_id")
        .agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    )
    members = clusters.withColumnRenamed("record_id", "member_id")
    best = canonical(records, clusters)
    pairs = members.join(best, ["cluster"], "inner")
    return (
        pairs.filter("member_id <> canonical_id")
        .join(kinds.withColumnRenamed("record_id", "member_id"), "member_id", "left")
        .select("member_id", "canonical_id", "kinds")
    )
