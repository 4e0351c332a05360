"""Checks of the JSON payloads that the batch ledger keeps, row by row.

A ledger row holds all that its check needs, so everything here is one
expression over parsed, nested values: no row is exploded and nothing is
shuffled but the ids of the articles.  Each payload is parsed once, for the
kind of batch it belongs to.  A field that is missing and one that is null
count alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.quality import NOT_REPORTED_QUOTE, STATUSES, codes, relevance_level, status_score
from litmill.operators.rubrics import RUBRICS, STUDY_TYPES

PORTFOLIO = "portfolio"
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"

# What the fields of a payload may say, and how long texts may be.
SOURCES = ("title", "abstract", "provided_metadata", "rubric")
COVERAGE = ("direct", "partial", "indirect", "absent", "conflicting")
ROLES = (
    "core_evidence", "population_complement", "outcome_complement", "design_complement", "time_complement",
    "replication", "limited_contribution",
)
LEVELS = ("high", "medium", "low", "none")
REASON, CRITERION_REASON, REMARK, ADVICE = 300, 200, 120, 600
MOST_ARTICLES, MOST_REMARKS, MOST_GAPS = 10, 5, 10

_SPANS = "struct<title: array<struct<span_id: string>>, abstract: array<struct<span_id: string>>>"
_ARTICLES = f"array<struct<article_id: string, evidence_spans: {_SPANS}>>"
INPUT = f"batch struct<articles: {_ARTICLES}>, input struct<candidate_articles: {_ARTICLES}>, _bad string"
ASSESSMENT = """task_id string, group_id string, study_type string, article_ids array<string>,
 relevance_assessments array<struct<article_id: string, score: double, level: string, reason: string, answerability_score: double,
  answerability_reason: string, evidence_span_ids: array<string>>>,
 quality_assessments array<struct<article_id: string, study_type: string, criteria: array<struct<criterion_id: string, status: string, score: double,
  evidence_quote: string, reason: string, evidence_source: string, evidence_span_ids: array<string>>>, strengths: array<string>,
  limitations: array<string>, evidence_gaps: array<string>, confidence: double>>, _bad string"""
SCORES = "array<struct<article_id: string, quality_score: double>>"
_COVERED = """array<struct<concept: string, status: string, evidence_article_ids: array<string>, reason: string, checked_article_ids: array<string>,
 evidence_span_ids: array<string>>>"""
EVALUATION = f"""candidate_article_ids array<string>,
 query_coverage struct<required_concepts: array<string>, explicit_constraints: array<string>, keyword_coverage: {_COVERED}, constraint_coverage: {_COVERED}>,
 joint_query_coverage struct<status: string, evidence_article_ids: array<string>, reason: string, evidence_span_ids: array<string>,
  checked_article_ids: array<string>, evidence_by_article: map<string, array<string>>>,
 coverage_gaps array<string>,
 redundancy_and_conflicts array<struct<status: string, article_ids: array<string>, reason: string, evidence_span_ids_by_article: map<string, array<string>>>>,
 article_contributions array<struct<article_id: string, role: string, contribution_level: string, coverage_contribution_score: double, reason: string,
  evidence_span_ids: array<string>, evidence_source: string, overlap_article_ids: array<string>>>,
 recommendation string, _bad string"""


def _parsed(c: str, schema: str) -> Column:
    return F.from_json(F.col(c), schema, {"columnNameOfCorruptRecord": "_bad"})


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return _yes(out)


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _each(c: Column, holds) -> Column:
    """Whether all items hold; true for none."""
    return F.coalesce(F.forall(c, lambda x: _yes(holds(x))), F.lit(True))


def _size(c: Column) -> Column:
    return F.greatest(F.size(c), F.lit(0))


def _ids(c: Column, field: str | None = None) -> Column:
    """Ids of a list in lower case, null list as empty."""
    return _list(F.transform(c, lambda x: F.lower(x[field] if field else x)))


def _same(a: Column, b: Column) -> Column:
    """Equal as sets."""
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def _distinct(c: Column) -> Column:
    return F.size(F.array_distinct(c)) == F.size(c)


def _within(c: Column, other: Column) -> Column:
    return F.size(F.array_except(c, other)) == 0


def _text(c: Column, most: int, least: int = 1) -> Column:
    # Few texts are long enough to count again without their blanks.
    short = (F.length(c) <= most) | (F.length(F.trim(c)) <= most)
    return short & (F.trim(c) != "") if least else c.isNull() | short


def _one_of(c: Column, values: tuple[str, ...], optional: bool = False) -> Column:
    known = F.trim(c).isin(*values)
    return c.isNull() | known if optional else known


def _uuids(c: Column) -> Column:
    return _each(c, lambda x: x.rlike(UUID))


def _remarks(c: Column, most: int) -> Column:
    return (_size(c) <= most) & _each(c, lambda x: _text(x, REMARK, 0))


def span_lists(articles: Column) -> Column:
    """(article_id, ids of its spans) of frozen articles."""
    names = lambda spans: _list(F.transform(spans, lambda s: s["span_id"]))
    return F.transform(
        articles,
        lambda a: F.struct(
            F.lower(a["article_id"]).alias("id"),
            F.concat(names(a["evidence_spans"]["title"]), names(a["evidence_spans"]["abstract"])).alias("spans"),
        ),
    )


def _cited(frozen: Column, article: Column, ids: Column) -> Column:
    """Whether all ids are spans of that article, none twice."""
    own = F.flatten(F.transform(F.filter(frozen, lambda f: f["id"] == F.lower(article)), lambda f: f["spans"]))
    return _all(F.exists(frozen, lambda f: f["id"] == F.lower(article)), _within(ids, own), _distinct(ids))


def criteria_of(study_type: Column) -> Column:
    """Criteria of a study type in order; null for an unknown one."""
    pairs = [x for t, c in RUBRICS.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in sorted(c)]))]
    return F.try_element_at(F.create_map(*pairs), study_type)


def valid_assessment(a: Column, study_type: Column, rubric: Column, given: Column, rel: Column, qual: Column, ids: Column) -> Column:
    """Whether a parsed assessment keeps the contract of a batch of the given study type.

    rubric: its criteria.  given, rel, qual, ids: the articles that the
    assessment names, rates for relevance, rates for quality and is about.
    """

    def criterion(c: Column) -> Column:
        status = F.trim(c["status"])
        return _all(
            _one_of(c["status"], STATUSES), c["score"].isNull() | c["score"].eqNullSafe(status_score(status)),
            (status != "not_reported") | (F.trim(c["evidence_quote"]) == NOT_REPORTED_QUOTE),
            _text(c["reason"], CRITERION_REASON), _one_of(c["evidence_source"], SOURCES, True),
        )

    def relevance(r: Column) -> Column:
        return _all(
            r["article_id"].rlike(UUID), r["score"].between(0, 10), F.trim(r["level"]) == relevance_level(r["score"]),
            _text(r["reason"], REASON), r["answerability_score"].between(0, 10), _text(r["answerability_reason"], REASON),
        )

    def quality(q: Column) -> Column:
        named = F.sort_array(F.transform(q["criteria"], lambda c: F.trim(c["criterion_id"])))
        return _all(
            q["article_id"].rlike(UUID), F.coalesce(F.trim(q["study_type"]), study_type) == study_type,
            named == rubric, _each(q["criteria"], criterion),
            *(_remarks(q[k], MOST_REMARKS) for k in ("strengths", "limitations", "evidence_gaps")), q["confidence"].between(0, 1),
        )

    return _all(
        a["_bad"].isNull(), F.size(a["relevance_assessments"]).between(1, MOST_ARTICLES),
        F.size(a["quality_assessments"]).between(1, MOST_ARTICLES), _each(a["relevance_assessments"], relevance),
        _each(a["quality_assessments"], quality), _uuids(given), _distinct(given), _distinct(rel), _distinct(qual), _same(rel, ids),
        _same(qual, ids), F.coalesce(F.trim(a["study_type"]), study_type) == study_type,
    )


def valid_evaluation(e: Column, frozen: Column, candidates: Column, named: Column, own: Column, expected: Column) -> Column:
    """Whether a parsed portfolio evaluation keeps its contract and cites frozen spans only.

    candidates, named, own, expected: the articles that are frozen, that the
    evaluation names, that it rates and that it is about.
    """

    def covered(c: Column) -> Column:
        evidence, checked, ids = _ids(c["evidence_article_ids"]), _ids(c["checked_article_ids"]), _list(c["evidence_span_ids"])
        cited = lambda article: F.filter(ids, lambda x: F.startswith(x, F.concat(article, F.lit(":"))))
        absent = F.trim(c["status"]) == "absent"
        return _all(
            _text(c["concept"], 1 << 30), _one_of(c["status"], COVERAGE), _text(c["reason"], REASON), _distinct(evidence),
            _within(F.concat(evidence, checked), candidates),
            F.when(absent, (F.size(ids) == 0) & (F.size(checked) > 0)).otherwise(
                _all(
                    F.size(evidence) > 0, F.size(ids) > 0,
                    F.aggregate(evidence, F.lit(0), lambda n, x: n + F.size(cited(x))) == F.size(ids),
                    _each(evidence, lambda x: (F.size(cited(x)) > 0) & _cited(frozen, x, cited(x))),
                )
            ),
        )

    def by_article(m: Column, articles: Column) -> Column:
        """Each of the articles and no other has spans, and they are its own."""
        entries = F.map_entries(m)
        return _all(
            _same(_ids(F.map_keys(m)), articles),
            _each(entries, lambda x: (F.size(x["value"]) > 0) & _cited(frozen, x["key"], x["value"])),
        )

    j, q, contributions = e["joint_query_coverage"], e["query_coverage"], e["article_contributions"]
    evidence, checked = _ids(j["evidence_article_ids"]), _ids(j["checked_article_ids"])
    spans, positive = _list(j["evidence_span_ids"]), j["evidence_by_article"]
    none = F.coalesce(F.cardinality(positive), F.lit(0)) <= 0
    joint = _all(
        j.isNotNull(), _one_of(j["status"], COVERAGE), _text(j["reason"], REASON), _distinct(evidence),
        F.when(
            F.trim(j["status"]) == "absent", none & (F.size(evidence) == 0) & (F.size(spans) == 0) & (F.size(checked) > 0)
        ).otherwise(
            _all(
                F.size(evidence) > 0, by_article(positive, evidence),
                (F.size(spans) == 0) | _same(spans, F.flatten(F.map_values(positive))),
            )
        ),
        _within(F.concat(evidence, checked), candidates), _within(F.concat(evidence, checked), expected),
    )

    def related(r: Column) -> Column:
        ids = _ids(r["article_ids"])
        return _all(
            F.trim(r["status"]).isin("conflicting", "redundant"), F.size(ids) >= 2, _distinct(ids), _text(r["reason"], REASON),
            by_article(r["evidence_span_ids_by_article"], ids), _within(ids, candidates), _within(ids, expected),
        )

    def contribution(c: Column) -> Column:
        ids, overlap = _list(c["evidence_span_ids"]), _ids(c["overlap_article_ids"])
        score = c["coverage_contribution_score"]
        return _all(
            c["article_id"].rlike(UUID), _one_of(c["role"], ROLES, True), _one_of(c["contribution_level"], LEVELS, True),
            score.isNull() | score.between(0, 10), _text(c["reason"], REASON), _one_of(c["evidence_source"], SOURCES, True),
            F.when(F.coalesce(F.trim(c["contribution_level"]), F.lit("")) == "none", (F.size(ids) == 0) & (F.size(overlap) > 0)).otherwise(
                (F.size(ids) > 0) & _cited(frozen, c["article_id"], ids)
            ),
            _within(overlap, expected),
        )

    def all_covered(asked: Column, rows: Column) -> Column:
        names = _list(F.transform(rows, lambda x: F.trim(x["concept"])))
        asked = _list(F.transform(asked, F.trim))
        return _all(_distinct(asked), _distinct(names), _same(asked, names), _each(rows, covered))

    used = lambda rows: F.flatten(F.coalesce(F.transform(rows, lambda x: _ids(x["evidence_article_ids"])), F.array().cast("array<array<string>>")))
    return _all(
        e["_bad"].isNull(), q.isNotNull(), F.size(q["required_concepts"]) > 0, F.size(q["keyword_coverage"]) > 0,
        all_covered(q["required_concepts"], q["keyword_coverage"]), all_covered(q["explicit_constraints"], q["constraint_coverage"]),
        joint, _each(e["redundancy_and_conflicts"], related), F.size(contributions) > 0, _each(contributions, contribution),
        _uuids(named), _distinct(expected), _distinct(own), _same(expected, own),
        _within(F.concat(used(q["keyword_coverage"]), used(q["constraint_coverage"])), expected),
        _remarks(e["coverage_gaps"], MOST_GAPS), _text(F.coalesce(e["recommendation"], F.lit("")), ADVICE, 0),
    )


def check_ledger(ledger: DataFrame, articles: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Class and issue codes of every batch of a ledger with JSON payloads, portfolio batches included.

    ledger: batch_id, task_id, group_id, study_type, status, article_ids (array
    of text) and the texts input_payload, assessment_payload, score_payload,
    null where nothing is stored.  articles: article_id.  Failed and unfinished
    batches are classed by their status; the others are eligible without issues.
    """
    listed = ledger.withColumn("_ids", _ids(F.col("article_ids")))
    # An id without its article is looked up once for all batches that name it.
    asked = listed.select("batch_id", F.explode(F.array_distinct("_ids")).alias("_id"))
    known = articles.select(F.lower(F.col("article_id").cast("string")).alias("_id")).distinct()
    lost = asked.join(known, "_id", "left_anti").select("batch_id").distinct().withColumn("_lost", F.lit(True))
    t, ids, state = F.col("study_type"), F.col("_ids"), F.col("status")
    has_a, has_s = F.col("assessment_payload").isNotNull(), F.col("score_payload").isNotNull()
    known_type, is_portfolio = _yes(t.isin(*STUDY_TYPES)), _yes(t == PORTFOLIO)
    over = state.isin("failed", "pending", "processing")
    rated = known_type & ~is_portfolio & ~_yes(over)
    offering = is_portfolio & ~_yes(over)
    rows = listed.withColumns(
        {
            "_a": F.when(rated, _parsed("assessment_payload", ASSESSMENT)),
            "_e": F.when(offering, _parsed("assessment_payload", EVALUATION)),
            "_i": F.when(rated | offering, _parsed("input_payload", INPUT)),
            "_s": F.when(rated, F.from_json("score_payload", SCORES)),
            "_rubric": F.when(rated, criteria_of(t)),
        }
    )
    a, e = F.col("_a"), F.col("_e")
    empty = F.array().cast("array<struct<id: string, spans: array<string>>>")
    rows = rows.withColumns(
        {
            "_given": _ids(a["article_ids"]), "_rel": _ids(a["relevance_assessments"], "article_id"),
            "_qual": _ids(a["quality_assessments"], "article_id"),
            "_frozen": F.when(rated, F.coalesce(span_lists(F.col("_i.batch.articles")), empty)).otherwise(empty),
            "_offered": F.when(offering, F.coalesce(span_lists(F.col("_i.input.candidate_articles")), empty)).otherwise(empty),
        }
    )
    given, rel, qual = F.col("_given"), F.col("_rel"), F.col("_qual")
    # Articles an assessment is about: those it names, or those it rates for relevance.
    rows = rows.withColumn("_about", F.when(F.size(given) > 0, given).otherwise(F.array_distinct(rel)))
    rows = rows.withColumn(
        "_valid", F.when(rated & has_a, valid_assessment(a, t, F.col("_rubric"), given, rel, qual, F.col("_about")))
    )
    # What cites spans: relevance ratings and criteria, each with its article.
    cite = lambda x, ids_: F.struct(F.lower(x["article_id"]).alias("id"), _list(ids_).alias("spans"))
    citing = lambda c: F.filter(c, lambda x: F.size(x["evidence_span_ids"]) > 0)
    cites = F.concat(
        F.transform(citing(a["relevance_assessments"]), lambda r: cite(r, r["evidence_span_ids"])),
        F.flatten(
            F.transform(a["quality_assessments"], lambda q: F.transform(citing(q["criteria"]), lambda c: cite(q, c["evidence_span_ids"])))
        ),
    )
    frozen, sound = F.col("_frozen"), _yes(F.col("_valid"))
    is_frozen = lambda c: F.exists(frozen, lambda f: f["id"] == c["id"])
    own_prefix = lambda c: _each(c["spans"], lambda s: F.startswith(s, F.concat(c["id"], F.lit(":"))))

    def calculated(q: Column) -> Column:
        """Quality score of an assessed article: none without an applicable criterion."""
        scores = F.array_compact(F.transform(q["criteria"], lambda c: status_score(F.trim(c["status"]))))
        mean = lambda x: F.lit(5.0) + F.lit(5.0) * F.aggregate(x, F.lit(0.0), lambda n, y: n + y) / F.size(x)
        return F.get(F.transform(F.filter(F.array(scores), lambda x: F.size(x) > 0), mean), F.lit(0))

    # The assessment of a scored article is found by the place of its id, and its criteria are read once.
    stored = F.transform(
        F.col("_s"),
        lambda s: F.struct(
            F.lower(s["article_id"]).alias("id"), s["quality_score"].alias("stored"),
            calculated(F.get(a["quality_assessments"], F.array_position(qual, F.lower(s["article_id"])).cast("int") - 1)).alias("score"),
        ),
    )
    empty = F.array().cast("array<struct<id: string, stored: double, score: double>>")
    rows = rows.withColumn("_cites", F.when(sound, cites)).withColumn("_stored", F.when(sound, F.coalesce(stored, empty)).otherwise(empty))
    usable = lambda s: s["stored"].isNotNull() & s["score"].isNotNull()
    scored = F.transform(F.filter("_stored", usable), lambda s: s["id"])
    some = lambda c, holds: _yes(F.exists(c, lambda x: _yes(holds(x))))
    any_frozen = F.size(frozen) > 0
    listing_issues = codes((F.size(ids) == 0, "empty_article_ids"), (~_distinct(ids), "duplicate_article_ids"))
    article_issues = codes(
        (~known_type, "unknown_study_type"),
        (~has_a, "missing_assessment_payload"),
        (~has_s, "missing_score_payload"),
        (known_type & has_a & ~sound, "invalid_assessment_payload"),
        (sound & (F.coalesce(F.trim(a["task_id"]), F.lit("")) != F.col("task_id").cast("string")), "task_id_mismatch"),
        (sound & (F.coalesce(F.trim(a["group_id"]), F.lit("")) != F.coalesce(F.col("group_id"), F.lit(""))), "group_id_mismatch"),
        (sound & (F.coalesce(F.trim(a["study_type"]), t) != t), "study_type_mismatch"),
        (sound & ~_same(F.col("_about"), ids), "assessment_articles_mismatch"),
        (sound & any_frozen & some("_cites", lambda c: ~is_frozen(c)), "missing_frozen_spans"),
        (
            sound & any_frozen
            & some("_cites", lambda c: is_frozen(c) & ~(_cited(frozen, c["id"], c["spans"]) & own_prefix(c))),
            "invalid_evidence_span",
        ),
        (sound & some("_stored", lambda s: ~usable(s)), "invalid_score_payload"),
        (sound & some("_stored", lambda s: F.abs(s["stored"] - s["score"]) > tolerance), "quality_score_mismatch"),
        (sound & ~_distinct(scored), "duplicate_score_articles"),
        (sound & ~_same(scored, ids), "score_articles_mismatch"),
    )
    offered = F.col("_offered")
    checkable = has_a & (F.size(offered) > 0)
    rows = rows.withColumns(
        {
            "_candidates": F.transform(offered, lambda f: f["id"]), "_named": _ids(e["candidate_article_ids"]),
            "_own": _ids(e["article_contributions"], "article_id"),
        }
    )
    candidates, named, own, expected = (F.col(c) for c in ("_candidates", "_named", "_own", "_expected"))
    rows = rows.withColumn("_expected", F.when(F.size(named) > 0, named).otherwise(own))
    valid = valid_evaluation(e, offered, candidates, named, own, expected)
    portfolio_issues = codes(
        (F.size(offered) == 0, "missing_portfolio_input"),
        (~has_a, "missing_portfolio_payload"),
        (checkable & F.col("_sound_e") & ~_same(expected, candidates), "portfolio_articles_mismatch"),
        (checkable & ~F.col("_sound_e"), "invalid_portfolio_payload"),
    )
    stale = codes((~state.eqNullSafe("completed"), "unsupported_status"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_sound_e", F.when(offering & checkable, valid).otherwise(F.lit(False)))
    # Lost articles are told to rows that no longer hold their payloads.
    thin = rows.select(
        "batch_id", "task_id", "study_type", F.size("_ids").alias("article_count"), state.alias("_state"),
        F.when(over, none).otherwise(F.concat(stale, F.when(is_portfolio, portfolio_issues).otherwise(listing_issues))).alias("_head"),
        F.when(_yes(over) | is_portfolio, none).otherwise(article_issues).alias("_tail"),
        (~_yes(over) & ~is_portfolio).alias("_asks"),
    ).join(lost, "batch_id", "left")
    missing = F.when(F.col("_asks") & _yes(F.col("_lost")), F.array(F.lit("missing_articles"))).otherwise(none)
    state = F.col("_state")
    return thin.withColumn("issues", F.concat("_head", missing, "_tail")).select(
        "batch_id", "task_id", "study_type", "article_count", "issues",
        F.when(state == "failed", F.lit("failed"))
        .when(state.isin("pending", "processing"), F.lit("pending"))
        .when(F.size("issues") > 0, F.lit("invalid"))
        .otherwise(F.lit("eligible")).alias("class"),
    )
