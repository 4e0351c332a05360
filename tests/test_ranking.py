"""Coarse bands, screening, spans, batches, truncation, readers and hooks."""

import re

import pytest
from pyspark.sql import functions as F

from litmill.functions import hooks, markup
from litmill.operators import ordering, portfolio, quality, rank, spans
from litmill.operators.search import Concept
from litmill.sources import bibliographic as B


def scored(spark, n, core=lambda i: i % 2 == 0, hit=lambda i: i % 4 == 0):
    rows = [(i, 70.0 if hit(i) else 0.0, float(i % 50), core(i), 2000 + i % 20) for i in range(n)]
    return spark.createDataFrame(
        rows, "article_id long, keyword_score double, recency_score double, core_matched boolean, publication_year int")


@pytest.mark.parametrize("n, want", [(200, 200), (201, 51), (400, 100), (401, 200)])
def test_coarse_bands(spark, n, want):
    assert rank.coarse_filter(scored(spark, n), 200).filter("coarse_status = 'passed'").count() == want


def test_coarse_fallbacks(spark):
    few_core = scored(spark, 300, core=lambda i: i < 8)
    assert rank.coarse_filter(few_core, 200).filter("coarse_status = 'passed'").count() == 75
    nothing = scored(spark, 300, hit=lambda i: False)
    assert rank.coarse_filter(nothing, 200).filter("coarse_status = 'passed'").count() == 200


def test_no_core_concepts_means_matched(spark):
    df = spark.createDataFrame([("plain words", "")], "t string, a string")
    out = rank.match_concepts(df, [Concept("population", "p", ("zzz",))], F.col("t"), F.col("a")).first()
    assert out["core_matched"] and out["keyword_score"] == 0.0 and out["matched_concepts"] == []


def test_phrases_match_on_word_borders_only(spark):
    df = spark.createDataFrame([("heart failures seen", "the heart failure ward")], "t string, a string")
    out = rank.match_concepts(df, [Concept("drug", "hf", ("Heart-Failure",))], F.col("t"), F.col("a")).first()
    assert out["keyword_score"] == 70.0


def test_threshold_is_strict_and_covers_all(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0000001), (3, None)], "article_id long, composite_score double")
    kept, dropped = quality.partition_by_threshold(df)
    assert [r[0] for r in kept.collect()] == [2] and sorted(r[0] for r in dropped.collect()) == [1, 3]


def test_quality_without_applicable_criteria(spark):
    df = spark.createDataFrame([(1, "not_applicable"), (2, "favorable"), (2, "unclear")], "article_id long, status string")
    got = {r["article_id"]: (r["quality_score"], r["issues"]) for r in quality.preliminary_quality(df).collect()}
    assert got == {1: (None, ["nothing_applicable"]), 2: (6.25, [])}


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        quality.Weights(relevance=0.9)


@pytest.mark.parametrize("n, kept", [(25, 25), (50, 50), (51, 25)])
def test_truncate(spark, n, kept):
    df = spark.range(n).select(F.col("id").alias("article_id"), F.col("id").cast("double").alias("composite_score"))
    out = portfolio.truncate(df, portfolio.fallback_order(), 50)
    assert out.filter("window = 'kept'").count() == kept and out.count() == n


@pytest.mark.parametrize("n, size, want", [(0, 3, []), (1, 3, [1]), (3, 3, [3]), (4, 3, [2, 2]), (7, 3, [3, 2, 2])])
def test_balanced_batches(spark, n, size, want):
    df = spark.range(n).select(F.lit("g").alias("g"), "id")
    out = ordering.balanced_batches(df, "g", size, [F.asc("id")]).groupBy("batch_index").count().orderBy("batch_index")
    assert [r["count"] for r in out.collect()] == want


TEXTS = ["", "   ", "No end", "One. Two! Three? Four.", "  Lead. Tail  ", "中文。再来！结束", "See Fig. 3 et al. now. Done.", "A.B c. D", "x\n\ny. z\n"]


def brute_sentences(t):
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?。！？])(?:[\s ]+|(?=[一-鿿]))", t):
        if t[start:m.start()].strip():
            out.append((start, m.start()))
        start = m.end()
    if t[start:].strip():
        out.append((start, len(t)))
    trim = lambda a, b: (a + len(t[a:b]) - len(t[a:b].lstrip()), a + len(t[a:b].rstrip()))
    return [trim(a, b) for a, b in out]


def test_spans_cite_the_original_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "article_id long, abstract string").withColumn("title", F.lit("T"))
    rows = spans.span_rows(df, "article_id").filter("source = 'abstract'").collect()
    for r in rows:
        assert TEXTS[r["article_id"]][r["start_offset"]:r["end_offset"]] == r["text"]
    for i, t in enumerate(TEXTS):
        s = brute_sentences(t)
        want = [(s[k][0], s[min(k + 2, len(s) - 1)][1]) for k in range(0, len(s), 3)]
        got = sorted((r["start_offset"], r["end_offset"]) for r in rows if r["article_id"] == i)
        assert got == want, t


def test_abbreviation_guard(spark):
    df = spark.createDataFrame([("See Fig. 3 now. Done.",)], "t string")
    row = df.select(F.size(markup.sentence_bounds(F.col("t"))), F.size(markup.sentence_bounds(F.col("t"), True))).first()
    assert tuple(row) == (6, 4)


def test_html_to_text(spark):
    html = "<h4>Aim</h4>To <b>see</b> a &lt; b &#233;&#x65e5;&unknown;.<!-- gone --><p>Two<br/>lines</p>\n\n"
    df = spark.createDataFrame([(html,), ("<p> </p>",), (None,)], "h string")
    got = [r[0] for r in df.select(markup.html_text(F.col("h"))).collect()]
    assert got == ["Aim\nTo see a < b é日&unknown;.\nTwo\nlines", None, None]


def test_pubmed_reader_quarantines(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<S><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>H<sub>2</sub>O is &lt; good</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
        "<PubmedArticle><MedlineCitation><Article><ArticleTitle>No id</ArticleTitle></Article></MedlineCitation></PubmedArticle></S>")
    good, bad = B.scan_pubmed_xml(spark, str(tmp_path), "r")
    assert [(r["pmid"], r["title"]) for r in good.collect()] == [("1", "H2O is < good")]
    assert [r["issues"] for r in bad.collect()] == [["no_pmid"]]


def test_preprint_reader_checks_doi_and_server(spark, tmp_path):
    lines = [
        '{"requested_doi":"10.1/a","requested_server":"biorxiv","collection":[{"doi":"10.1/A","title":"old","version":"1"},{"doi":"10.1/A","title":"new","version":"2"}]}',
        '{"requested_doi":"10.1/b","requested_server":"biorxiv","collection":[{"doi":"10.1/x","title":"t"}]}',
        '{"requested_doi":"10.1/c","requested_server":"biorxiv","collection":[{"doi":"10.1/c","title":"t","server":"medRxiv"}]}',
        '{"requested_doi":"10.1/d","requested_server":"biorxiv","collection":[]}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    good, bad = B.scan_preprint_json(spark, str(tmp_path), "r")
    assert [(r["title"], r["preprint_version"]) for r in good.collect()] == [("new", 2)]
    assert sorted(r["issues"][0] for r in bad.collect()) == ["doi_mismatch", "server_mismatch"]


def test_failed_hooks_fall_back(spark):
    df = spark.range(5).select(F.col("id").alias("article_id"), F.lit("fb").alias("fallback_text"))

    def broken(rows):
        raise RuntimeError("down")

    got = hooks.summarise(df, broken).collect()
    assert {(r["summary_text"], r["summary_status"]) for r in got} == {("fb", "fallback")}


def test_vectors_must_match_the_texts(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    with pytest.raises(Exception):
        hooks.embed(df, "t", lambda: (lambda texts: [[1.0]] * (len(texts) + 1))).collect()


def test_hydrated_plans_do_not_use_nested_loops(spark, sf):
    from litmill.catalog import adapters as A
    from litmill.catalog import joins
    from litmill.operators import store

    stored, inc = joins.halves(spark, sf)
    plan = store.match_existing(inc, stored)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and A.TABLES


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey = 5").select("o_custkey")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in df._jdf.queryExecution().executedPlan().toString()


def test_scores_round_as_their_sql(spark):
    import duckdb

    from litmill.functions import values

    # Keyword, semantic and recency scores whose sum has a 5 behind its fourth digit.
    cases = [(7.0, -0.05383, 60.0815), (7.0, -0.04285, 60.0815), (18.9, -0.15748, 60.0815), (44.1, -0.12284, 60.0815), (0.0, -0.02663, 60.0815)]
    sums = [0.5 * k + 0.4 * ((c + 1) / 2 * 100) + 0.1 * r for k, c, r in cases]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sums], "x double").select(values.rounded(F.col("x"), 4)).collect()]
    assert got == [duckdb.connect().execute("select round(cast(? as double), 4)", [x]).fetchone()[0] for x in sums]
