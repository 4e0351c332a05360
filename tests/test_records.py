"""Identifiers, duplicates, merging, matching and upserts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from litmill.functions import dates, exact, text, values
from litmill.operators import records, resolve, routing, store
from litmill.operators.rubrics import RUBRICS, STUDY_TYPES, mapping_rows, question_rows
from litmill.plans import corpus


def one(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("https://doi.org/10.1/AbC", "10.1/abc"), ("HTTP://DX.DOI.ORG/10.1/a", "10.1/a"), ("doi : 10.2/B", "10.2/b"),
    ("10.3", None), ("x10.1/a", None), ("  ", None), (None, None)])
def test_doi(spark, raw, want):
    assert one(spark, text.doi(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [("PMC12", "PMC12"), ("pmc3", "PMC3"), ("12", "PMC12"), ("PMC", None), ("x", None), ("", None)])
def test_pmcid(spark, raw, want):
    assert one(spark, text.pmcid(F.col("a")), a=raw) == want


def test_strict_pmcid_raises(spark):
    with pytest.raises(Exception):
        one(spark, text.pmcid(F.col("a"), strict=True), a="nope")


def test_exact_fold_goes_beyond_the_built_in(spark):
    assert one(spark, exact.match_text(F.col("a")), a="Ｆｕｌｌ–width ﬁne²") == "full width fine2"
    assert one(spark, text.match_text(F.col("a")), a="Straße, X_1!") == "strasse x_1"


@pytest.mark.parametrize("raw, want", [("2024", None), ("2024-05", None), ("2024-05-01", "2024-05-01"), ("2024-13-01", None),
                                       ("2024-05-01T10:00", "2024-05-01"), (None, None)])
def test_iso_date(spark, raw, want):
    assert one(spark, dates.iso_date(F.col("a")).cast("string"), a=raw) == want


def test_named_uuid(spark):
    import uuid

    assert one(spark, values.named_uuid(F.col("a")), a="Grüße") == str(uuid.uuid5(uuid.NAMESPACE_URL, "Grüße"))


def test_zero_and_ragged_vectors_raise(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    for row in (0, 1):
        with pytest.raises(Exception):
            df.limit(2).filter(F.size("a") == (2 if row == 0 else 1)).select(values.cosine(F.col("a"), F.col("b"))).collect()


REC = ("record_id long, source string, source_record_id string, source_rank int, search_run_id string, doi string, pmid string, "
       "pmcid string, title string, normalized_title string, abstract string, abstract_available boolean, first_author string, "
       "publication_year int, publication_types array<string>, keywords array<string>, peer_review_status string, preprint_server string, "
       "is_open_access boolean, has_full_text boolean, can_download_full_text boolean, citation_count int, is_retracted boolean, preprint_version int")


def rec(i, doi=None, pmid=None, pmcid=None, title="T", author="A", year=2020, **kw):
    base = dict(
        record_id=i, source="pubmed", source_record_id=str(i), source_rank=1, search_run_id="r", doi=doi, pmid=pmid, pmcid=pmcid,
        title=title, normalized_title=title.lower(), abstract=None, abstract_available=False, first_author=author, publication_year=year,
        publication_types=[], keywords=[], peer_review_status="unknown", preprint_server=None, is_open_access=None,
        has_full_text=False, can_download_full_text=False, citation_count=None, is_retracted=False, preprint_version=None)
    return {**base, **kw}


def frame(spark, rows):
    names = [c.split()[0] for c in REC.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], REC)


def clusters_of(spark, rows):
    df = frame(spark, rows)
    c = resolve.components(resolve.identity_keys(df))
    got = {r["record_id"]: r["cluster"] for r in resolve.assign(df, c).collect()}
    return df, c, got


def test_chain_conflict_and_missing_parts(spark):
    rows = [
        rec(0, doi="10.1/A"), rec(1, doi="10.1/a ", pmid="5"), rec(2, pmid="5", doi="10.1/zz"),  # chain, two DOIs
        rec(3, author=None), rec(4, author=None),  # no strong id and no author: never merged
        rec(5, title="Same"), rec(6, title="Same"),  # title, year, author
        rec(7, title="Same", doi="10.1/q"),  # strong id: the title key is not used
    ]
    df, c, got = clusters_of(spark, rows)
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    assert [(r["cluster"], r["kind"], r["values"]) for r in resolve.conflicts(df, c).collect()] == [(0, "doi", 2)]
    ids = {r["cluster"]: r["cluster_id"] for r in resolve.cluster_ids(resolve.identity_keys(df), c, df).collect()}
    md5 = [hashlib.md5(k.encode()).hexdigest() for k in ("doi:10.1/a", "doi:10.1/a", "pmid:5", "pmid:5", "doi:10.1/zz")]
    want = f"keys|5|{sum(int(m[:15], 16) for m in md5)}|{sum(int(m[15:30], 16) for m in md5)}"
    assert ids[0] == hashlib.sha256(want.encode()).hexdigest()[:24]
    assert ids[3] == hashlib.sha256(b"unidentified:t:3").hexdigest()[:24]


def test_merge_rules(spark):
    rows = [
        rec(0, doi="10.1/a", peer_review_status="preprint", preprint_server="biorxiv", abstract="longest text", first_author="",
            publication_types=["Review", "review."], keywords=["B"], is_open_access=False, citation_count=3),
        rec(1, doi="10.1/a", peer_review_status="peer_reviewed", title="Best", abstract="short", publication_types=["REVIEW", "Trial"],
            keywords=["a", "b"], citation_count=2, is_retracted=True),
        rec(2, doi="10.1/a", abstract="same length!", is_open_access=None),
    ]
    df, c, _ = clusters_of(spark, rows)
    m = resolve.merge_clusters(df, c).first()
    assert (m["canonical_id"], m["title"], m["member_count"]) == (1, "Best", 3)
    assert m["peer_review_status"] == "peer_reviewed" and m["preprint_server"] is None
    assert m["abstract"] == "same length!"  # equal length: the better member's text
    assert (m["is_open_access"], m["citation_count"], m["is_retracted"], m["first_author"]) == (False, 3, True, "A")
    assert m["publication_types"] == ["REVIEW", "Trial"] and m["keywords"] == ["a", "b"]


def test_lists_are_whole_packed_and_in_long_form(spark):
    rows = [rec(i, doi="10.1/a", keywords=[f"k{i}"]) for i in range(6)] + [rec(9, doi="10.1/b", keywords=["x"])]
    df, c, _ = clusters_of(spark, rows)
    m = {r["cluster"]: r["keywords"] for r in resolve.merge_clusters(df, c).collect()}
    assert m == {0: [f"k{i}" for i in range(6)], 9: ["x"]}
    members = resolve.assign(df, c)
    longer = resolve.union_texts(members, "cluster", resolve.member_order(), "keywords").filter("cluster = 0")
    assert [r["item"] for r in longer.orderBy("item_order").collect()] == [f"k{i}" for i in range(6)]


def test_input_order_does_not_change_clusters(spark, sf):
    from litmill.catalog import adapters as A

    r = A.records(spark, sf)
    keys = resolve.identity_keys(r)
    a = set(map(tuple, resolve.components(keys).collect()))
    b = set(map(tuple, resolve.components(keys.orderBy(F.rand(3))).collect()))
    assert a == b


def test_every_record_is_in_one_cluster(spark, sf):
    from litmill.catalog import adapters as A

    out = corpus.resolve_corpus(A.records(spark, sf))
    assert out.articles.agg(F.sum("member_count")).first()[0] == A.records(spark, sf).count()
    assert out.bad.count() == 0


def test_store_match_falls_back_to_title_even_with_strong_ids(spark):
    stored = frame(spark, [rec(0, doi="10.1/a", title="X"), rec(1, pmid="7", title="Y")]).withColumn(
        "article_id", F.concat(F.lit("a"), F.col("record_id").cast("string"))).drop("record_id")
    inc = frame(spark, [rec(10, doi="10.1/b", title="X"), rec(11, doi="10.1/a", pmid="7"), rec(12, title="Z", author=None)])
    got = {r["record_id"]: (r["article_id"], r["matched_by"]) for r in store.match_existing(inc, stored).collect()}
    assert got == {10: ("a0", "title_year_author"), 11: ("a0", "doi")}
    once = store.upsert_articles(stored, inc, store.match_existing(inc, stored))
    twice = store.upsert_articles(once, inc, store.match_existing(inc, once))
    assert set(map(str, once.collect())) == set(map(str, twice.collect())) and once.count() == 3


def test_contract_rules_and_strict_mode(spark):
    bad = frame(spark, [rec(0, title=" ", year=1200), rec(1, preprint_server="biorxiv")])
    got = {r["record_id"]: r["issues"] for r in records.validate_records(bad).collect()}
    assert got == {0: ["no_title", "no_normalized_title", "year_range"], 1: ["server_without_preprint"]}
    with pytest.raises(Exception):
        records.validate_records(bad, strict=True).collect()


@pytest.mark.parametrize("types, stated, abstract, want", [
    ([], None, "A systematic review of metabolic disease", "meta_analysis"),
    ([], None, "This systematic review discusses randomized controlled trial data", "systematic_review"),
    ([], "cross_sectional_prevalence", "a cross-sectional study", "cross_sectional_analytical"),
    ([], "cross_sectional_prevalence", None, "cross_sectional_prevalence"),
    (["Randomised Controlled Trial"], None, None, "randomized_controlled_trial"),
    (["Review"], None, "nothing", "narrative_review"),
    (["Letter"], None, None, "unknown"),
])
def test_study_group(spark, types, stated, abstract, want):
    df = spark.createDataFrame([(types, stated, abstract)], "t array<string>, d string, a string")
    assert df.select(routing.study_group(F.col("t"), F.col("d"), F.col("a"))).first()[0] == want


def test_strict_meta(spark):
    df = spark.createDataFrame([([], None, "A systematic review of metabolic disease")], "t array<string>, d string, a string")
    assert df.select(routing.infer_design(F.col("t"), F.col("d"), F.col("a"), True)).first()[0] == "systematic_review"


def test_rubric_tables_are_complete():
    known = {q for q, _ in question_rows()}
    assert len(known) == 65 and len(STUDY_TYPES) == 10
    assert {q for _, q in mapping_rows()} <= known and sum(map(len, RUBRICS.values())) == 55


def test_new_records_that_match_each_other_make_one_article(spark):
    from litmill.operators import store as S

    schema = (
        "doi string, pmid string, pmcid string, first_author string, normalized_title string, publication_year int, "
        "title string, is_retracted boolean, authors array<string>, publication_types array<string>"
    )
    old = spark.createDataFrame([("a1", "10.1/s", None, None, None, "t", 2000, "T", False, [], ["Letter"])], "article_id string, " + schema)
    new = spark.createDataFrame(
        [
            (1, "10.1/x", None, None, "A", "one", 2001, "One", False, [], []),
            (2, "10.1/X ", "7", None, None, "two", None, "Two", True, ["A B"], ["Review"]),
            (3, None, None, None, "a", "one", 2001, "One", False, ["C D"], []),
            (4, "10.1/s", None, None, None, "t", None, "Other", False, ["E F"], ["Trial"]),
        ],
        "record_id long, " + schema,
    )
    out = {r["article_id"]: r for r in S.upsert_articles(old, new, S.match_existing(new, old)).collect()}
    assert set(out) == {"a1", "r1"}
    assert out["r1"]["pmid"] == "7" and out["r1"]["is_retracted"] and out["r1"]["title"] == "One"
    assert out["r1"]["authors"] == ["A B"] and out["r1"]["publication_types"] == ["Review"]
    assert out["a1"]["authors"] == ["E F"] and out["a1"]["publication_types"] == ["Letter"]
