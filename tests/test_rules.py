"""Rules and searches against brute force on awkward rows."""

import html
import random
import re

import numpy as np
from pyspark.sql import functions as F

from litmill.functions import markup
from litmill.operators import payloads, rank, search, vocab


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_references_are_read_as_html_reads_them(spark):
    texts = [
        "&amp; &lt;b&gt; &quot;x&quot; &apos;", "&copy 2 &copy; &notit; &notin; &not;", "&#65;&#x41;&#X41 &#0; &#128; &#x80;&#159;", "&hellip;&HELLIP; &zwnj;",
        "&#1114112; &#xD800; &#99999999999; &#x; &#; &;", "a&b &nope; &ampamp;", "&NotEqualTilde; &ngE;", "&acE;x", "日本 &eacute;é", "", "&", "&&amp;&",
        "&lt &LT &gt;= &ltx", "&#38;amp;", "x&#10;y&#9;",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", markup.decode_entities(F.col("t")).alias("x")).collect()}
    # Control characters and code points that are no characters are dropped by the library and become U+FFFD here.
    assert got == {**{i: html.unescape(t) for i, t in enumerate(texts)}, 99: None}


def test_html_with_quoted_signs(spark):
    cases = {
        '<p title="a>b">x</p>': "x", "<p title='a > b' id=1>x<br data=\"</p>\">y": "x\ny", "<p title=a>b>x</p>": "b>x", "<a href=\"x\"y='>'>z</a>": "z",
        '<p title="open>x</p>': "x", "a < b <3 </ p> c": "a < b <3 c", "<!-- <p> --><h1>T</h1>t<!-- open": "T\nt", "<p>" + "<i a=1>" * 400 + "x": "x",
        "<i " + "a='>' " * 200 + ">x</i>": "x", '<script>var a = "</p>&amp;";</script><p>b&amp;</p>': 'var a = "</p>&amp;";\nb&', " \n ": None, "": None,
        "<div>a</div>\r\n<li>b c\x0bd": "a\nb\nc\nd",
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", markup.html_text(F.col("t")).alias("x")).collect()}
    assert got == {**dict(enumerate(cases.values())), 99: None}


def test_phrases(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))), " ".join(rnd.choice("abcdef") for _ in range(30))) for i in range(60)]
    docs += [(100, None, "a b"), (101, "", None), (102, None, None)]
    terms = [("a",), ("a b",), ("a b c",), ("f e d c",), ("zz",), ("b a b a",), ("c c",), ("a b",)]
    d = spark.createDataFrame(docs, "doc_id long, t string, b string")
    t = spark.createDataFrame([(x[0], i) for i, x in enumerate(terms)], "term string, n int")
    has = lambda text, term: f" {term} " in f" {text or ''} "
    want = [(i, f, x[0], n) for i, a, b in docs for f, text in (("t", a), ("b", b)) for n, x in enumerate(terms) if has(text, x[0])]
    got = search.phrase_match(d, t, "doc_id", ["t", "b"]).select("doc_id", "field", "term", "n")
    assert rows(got) == sorted(want, key=repr)
    any_field = {(i, x, n) for i, _, x, n in want if len(x.split()) <= 3}
    got = search.phrase_match(d, t, "doc_id", ["t", "b"], max_words=3, any_field=True).select("doc_id", "term", "n")
    assert rows(got) == sorted(any_field, key=repr)
    assert rows(search.phrase_match(d, t.limit(0), "doc_id", ["t"])) == []


def test_queries_with_more_groups_than_bits(spark):
    words = [f"w{i}" for i in range(130)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, None)], "doc_id long, b string")
    plan = [("q", g, w, 1) for g, w in enumerate(words)] + [("p", 5, "w1", 1), ("p", 5, "none", 2), ("r", 1, "none", 1)]
    p = spark.createDataFrame(plan, "query_id string, group_id int, term string, term_order int")
    assert rows(search.concept_search(docs, p, "doc_id", ["b"])) == [("p", 1), ("p", 2), ("q", 1)]
    assert rows(search.concept_search(docs, p.limit(0), "doc_id", ["b"])) == []


def test_nearest_of_many_queries(spark):
    rnd = np.random.default_rng(0)
    vectors = [(i, rnd.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)] + [(200, None), (201, [0.0] * 6)]
    asked = [(i, v) for i, v in vectors if i % 10 == 0]
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = []
    for q, qv in asked:
        if qv is not None:
            found = sorted((-round(float(unit(qv) @ unit(v)), 9) + 0.0, i) for i, v in vectors if v is not None)[:7]
            want += [(q, i, k) for k, (_, i) in enumerate(found, 1)]
    v = spark.createDataFrame(vectors, "id long, e array<double>").repartition(4)
    a = spark.createDataFrame(asked, "query_id long, e array<double>")
    got = rank.nearest_many(v, a, 7, "id", "e", block=6).select("query_id", "id", "position")
    assert rows(got) == sorted(want, key=repr)
    assert rows(rank.nearest_many(v, a.limit(0), 7, "id", "e")) == [] == rows(rank.nearest_many(v.limit(0), a, 7, "id", "e"))


def test_plan_expansion(spark):
    plan = spark.createDataFrame(
        [("q", 1, "Old", 1), ("q", 1, "other", 2), ("q", 1, "old", 3), ("q", 2, "gone", 1), ("q", 1, None, 4)],
        "query_id string, group_id int, term string, term_order int")
    concepts = spark.createDataFrame([("c1", False), ("c2", True), ("c3", False)], "concept_id string, obsolete boolean")
    terms = spark.createDataFrame(
        [("c1", "old", "Old"), ("c1", "new name", "New-name"), ("c1", "other", "Other"), ("c2", "gone", "Gone"), ("c2", "x", "X"), ("c3", "new name", "new name")],
        "concept_id string, normalized_term string, term string")
    got = rows(vocab.expand_plan(plan, terms, concepts))
    assert got == sorted([
        ("q", 1, "old", 1, "own", None), ("q", 1, "other", 2, "own", None), ("q", 1, "new name", 1, "synonym", "c1"), ("q", 2, "gone", 1, "own", None),
    ], key=repr)


def test_ledger_rows_without_anything(spark):
    schema = ("batch_id long, task_id long, group_id string, study_type string, status string, article_ids array<string>, "
              "input_payload string, assessment_payload string, score_payload string, issues string, _a string")
    ledger = spark.createDataFrame(
        [
            (1, None, None, None, None, None, None, None, None, "own", "own"), (2, 1, "g", "cohort", "completed", [], "{", "[]", "{}", "own", "own"),
            (3, 1, "g", "portfolio", "completed", None, '{"input": {"candidate_articles": []}}', "{}", None, "own", "own"),
            (4, 1, "g", "portfolio", "completed", None, '{"input": {"candidate_articles": [{"article_id": "a"}]}}', "1", None, "own", "own"),
            (5, 1, "g", "cohort", "failed", ["x"], None, None, None, "own", "own"),
        ], schema)
    articles = spark.createDataFrame([("x",)], "article_id string")
    got = {r["batch_id"]: (r["class"], r["issues"]) for r in payloads.check_ledger(ledger, articles).collect()}
    assert got[1] == ("invalid", ["unsupported_status", "empty_article_ids", "unknown_study_type", "missing_assessment_payload", "missing_score_payload"])
    assert got[2] == ("invalid", ["empty_article_ids", "invalid_assessment_payload"])
    assert got[3] == ("invalid", ["missing_portfolio_input"])
    assert got[4] == ("invalid", ["invalid_portfolio_payload"]) and got[5] == ("failed", [])
    assert payloads.check_ledger(ledger.limit(0), articles).count() == 0


def _lookup_case(spark):
    """Twelve keywords that share a common term with forty concepts, some of which share a second one as well."""
    terms = [(f"c{i}", "common", "Common", "entry") for i in range(40)]
    terms += [(f"c{i}", "rare", "Rare", "preferred") for i in range(0, 40, 5)] + [("c1", "alone", "Alone", "entry")]
    concepts = [(f"c{i}", f"label {i}", i == 39) for i in range(40)]
    looks = [(f"k{k}", 1 + k % 2, " COMMON ") for k in range(12)] + [(f"k{k}", 2 - k % 2, "rare") for k in range(0, 12, 3)]
    looks += [("k0", 1, "rare"), ("k0", 3, "common"), ("none", 1, "unknown")]
    return (
        spark.createDataFrame(looks, "keyword_id string, lookup_order int, lookup_term string"),
        spark.createDataFrame(terms, "concept_id string, normalized_term string, term string, term_type string"),
        spark.createDataFrame(concepts, "concept_id string, preferred_label string, obsolete boolean"),
    )


def _lookup_by_hand(looks, terms, concepts):
    label = {r.concept_id: r.preferred_label for r in concepts.collect() if not r.obsolete}
    pairs = {}
    for q in looks.collect():
        for t in terms.collect():
            if t.concept_id in label and t.normalized_term == q.lookup_term.strip().lower():
                row = (q.lookup_order, t.term, t.term_type)
                key = (q.keyword_id, t.concept_id)
                pairs[key] = min(row, pairs.get(key, row))
    return sorted((k, c, label[c], term, kind, at) for (k, c), (at, term, kind) in pairs.items())


def test_lookup_pairs_by_cells(spark, monkeypatch):
    case = _lookup_case(spark)
    monkeypatch.setattr(vocab, "CELL", 7)
    found = vocab.vocab_lookup(*case)
    assert sorted(tuple(r) for r in found.collect()) == _lookup_by_hand(*case)
    # Nothing is grouped once pairs exist: the plan above the join of pairs has no exchange.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < (plan.index("Aggregate") if "Aggregate" in plan else len(plan))


def test_lookup_pairs_are_dealt_to_tasks(spark, monkeypatch):
    case = _lookup_case(spark)
    monkeypatch.setattr(vocab, "CELL", 4)
    monkeypatch.setattr(vocab, "TASK_PAIRS", 60, raising=False)
    found = vocab.vocab_lookup(*case).withColumn("_task", F.spark_partition_id())
    rows = [tuple(r) for r in found.collect()]
    assert sorted(r[:-1] for r in rows) == _lookup_by_hand(*case)
    # About 500 pairs: so few rows meet that Spark alone would give them to one task.
    assert len({r[-1] for r in rows}) > 3


def test_first_match_of_each_keyword(spark):
    case = _lookup_case(spark)
    best = {}
    for row in _lookup_by_hand(*case):
        best[row[0]] = min((row[5], row[1], row), best.get(row[0], (9, "", None)))
    assert sorted(tuple(r) for r in vocab.first_matches(*case).collect()) == sorted(b[2] for b in best.values())


def test_match_metrics_without_pairs(spark):
    case = _lookup_case(spark)
    want = _lookup_by_hand(*case)
    keys = {r[0] for r in want}
    assert tuple(vocab.match_metrics(*case).first()) == (13, len(keys), 13 - len(keys), len(want))


def test_concepts_that_a_lookup_meets(spark):
    case = _lookup_case(spark)
    got = {r[0] for r in vocab.matched_concepts(*case).collect()}
    assert got == {r[1] for r in _lookup_by_hand(*case)}


def test_ledger_payloads_meet_no_join(spark):
    schema = ("batch_id long, task_id long, group_id string, study_type string, status string, article_ids array<string>, "
              "input_payload string, assessment_payload string, score_payload string")
    ledger = spark.createDataFrame([(1, 1, "g", "cohort", "completed", ["x", "y"], "{", "{", "{}")], schema)
    articles = spark.createDataFrame([("x",)], "article_id string")
    out = payloads.check_ledger(ledger, articles)
    assert out.collect()[0]["issues"] == ["missing_articles", "invalid_assessment_payload"]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # Above the topmost join nothing is parsed or judged.
    top = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any(word in line for line in plan[:top] for word in ("from_json", "assessment_payload", "forall"))


def test_html_is_read_once(spark):
    df = spark.createDataFrame([("a   b\t\tc&nbsp;&eacute;&notit;<br> <style>x  &amp;</style>",), ("<p> </p>",), (None,)], "h string")
    out = df.select(markup.html_text(F.col("h")).alias("x"))
    assert [r["x"] for r in out.collect()] == ["a b c é¬it;\nx &amp;", None, None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(h#", plan)) == 1
