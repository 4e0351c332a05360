"""Readers, driven over files that Spark derives from the test tables."""

from pyspark.sql import functions as F

from litmill import scale
from litmill.catalog import adapters as A
from litmill.catalog import query
from litmill.catalog.joins import DUCK_VOCAB, raw_vocab
from litmill.functions import markup, text
from litmill.sources import bibliographic as B
from litmill.sources import vocabulary

BAD = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{85}\x{fffe}\x{ffff}]"


def _xml(c):
    c = F.regexp_replace(c, BAD, " ")
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def wrapped(root):
    """Batches of lines between the tags of a root element; they pass through as they are, none is unpacked."""

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [f"<{root}>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": [f"</{root}>"]})

    return run


def _write_lines(df, col, root=None):
    """Write one text per row into a new folder, each file inside a root element if one is named."""
    path = scale.new_path(df.sparkSession, "derived")
    lines = df.select(F.col(col).alias("value"))
    if root:

        lines = lines.mapInArrow(wrapped(root), "value string")
    lines.write.text(path)
    return path


def _tag(name, body, attrs=""):
    return F.concat(F.lit(f"<{name}{attrs}>"), body, F.lit(f"</{name}>"))


def q_clean(x):
    """Single-line text of an XML element, oracle side."""
    return A.q_single(f"regexp_replace({x}, '{BAD}', ' ', 'g')")


def _docs(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.withColumn("title", F.expr("split_part(text, chr(10), 1)")).withColumn("s", F.col("doc_id").cast("string"))


_T = "split_part(text, chr(10), 1)"


@query("s01_vocab_ingest", f"with {DUCK_VOCAB} select t.concept_id, c.preferred_label, c.cui, c.obsolete, t.normalized_term, t.term, t.term_type from terms t join concepts c on t.concept_id = c.concept_id")
def vocab_ingest(spark, sf_dir):
    path = scale.new_path(spark, "vocab")
    raw_vocab(spark, sf_dir).write.option("header", "true").option("escape", '"').option("compression", "gzip").csv(path)
    concepts, terms = vocabulary.ingest_vocab(vocabulary.read_vocab_csv(spark, path))
    return terms.join(concepts, "concept_id").select(
        "concept_id", "preferred_label", "cui", "obsolete", "normalized_term", "term", "term_type")


@query(
    "s02_scan_pubmed_xml",
    f"""select cast(doc_id as varchar) as pmid, case when doc_id % 3 = 0 then 'PMC' || cast(doc_id as varchar) end as pmcid, case when doc_id % 2 = 0 then '10.1/' || cast(doc_id as varchar) end as doi,
 {q_clean(_T)} as title, md5('AIM: ' || {q_clean('text')} || chr(10) || 'Second part') as abstract_md5, 'Ann ' || source || ';The Group' as authors, 'Ann ' || source as first_author,
 '1111-' || cast(1000 + doc_id % 9 as varchar) as issn, '2222' as electronic_issn,
 case doc_id % 4 when 0 then '2020-03-0' || cast(1 + doc_id % 9 as varchar) when 1 then '2019-12' when 2 then '2018' else '1999 Winter' end as publication_date,
 case doc_id % 4 when 0 then 2020 when 1 then 2019 when 2 then 2018 else 1999 end as publication_year, 'Journal Article;Review' as publication_types, lang as language, 'k1;k ' || lang as keywords
 from documents where doc_id % 7 <> 6 and {q_clean(_T)} is not null""".replace("else '1999 Winter' end", "else '1999' end"),
)
def scan_pubmed_xml(spark, sf_dir):
    d = _docs(spark, sf_dir)
    s = F.col("s")
    pub = (
        F.when(F.col("doc_id") % 4 == 1, F.lit("<Year>2019</Year><Month>Dec</Month>"))
        .when(F.col("doc_id") % 4 == 2, F.lit("<Year>2018</Year><Month>zzz</Month>"))
        .when(F.col("doc_id") % 4 == 3, F.lit("<MedlineDate>1999 Winter</MedlineDate>")).otherwise("")
    )
    art_date = F.when(
        F.col("doc_id") % 4 == 0,
        F.concat(F.lit("<ArticleDate><Year>2020</Year><Month>3</Month><Day>"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("</Day></ArticleDate>")),
    ).otherwise("")
    journal = _tag("Journal", F.concat(
        F.lit('<ISSN IssnType="Electronic">2222</ISSN>'),
        _tag("ISSN", F.concat(F.lit("1111-"), (1000 + F.col("doc_id") % 9).cast("string")), ' IssnType="Print"'),
        _tag("JournalIssue", _tag("PubDate", pub)), F.lit("<Title>J &amp; J</Title><ISOAbbreviation>JJ</ISOAbbreviation>")))
    abstract = _tag("Abstract", F.concat(
        _tag("AbstractText", _xml(F.col("text")), ' Label="AIM"'), F.lit("<AbstractText>Second <b>part</b></AbstractText><AbstractText> </AbstractText>")))
    people = F.concat(
        F.lit("<AuthorList><Author><LastName>"), F.col("source"), F.lit("</LastName><ForeName>Ann</ForeName><Initials>A</Initials></Author>"),
        F.lit("<Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>"))
    article = _tag("Article", F.concat(
        journal, _tag("ArticleTitle", _xml(F.col("title"))), abstract, people, _tag("Language", F.col("lang")),
        F.lit("<PublicationTypeList><PublicationType>Journal Article</PublicationType><PublicationType>Review</PublicationType></PublicationTypeList>"), art_date))
    pmid = F.when(F.col("doc_id") % 7 != 6, _tag("PMID", s, ' Version="1"')).otherwise("")
    words = F.concat(F.lit("<KeywordList><Keyword>k1</Keyword><Keyword>k <i>"), F.col("lang"), F.lit("</i></Keyword></KeywordList>"))
    ids = F.concat(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<ArticleId IdType="doi">10.1/'), s, F.lit("</ArticleId>"))).otherwise(""),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<ArticleId IdType="pmc">PMC'), s, F.lit("</ArticleId>"))).otherwise(""),
        F.lit('<ArticleId IdType="pii">x</ArticleId>'))
    xml = _tag("PubmedArticle", F.concat(
        _tag("MedlineCitation", F.concat(pmid, article, words)),
        _tag("PubmedData", F.concat(F.lit("<PublicationStatus>ppublish</PublicationStatus>"), _tag("ArticleIdList", ids)))))
    good, _ = B.scan_pubmed_xml(spark, _write_lines(d.withColumn("xml", xml), "xml", "PubmedArticleSet"), "run")
    names = F.array_join(F.transform("authors", lambda a: a["full_name"]), ";")
    return good.select(
        "pmid", "pmcid", "doi", "title", F.md5("abstract").alias("abstract_md5"), names.alias("authors"), "first_author",
        "issn", "electronic_issn", "publication_date", "publication_year",
        F.array_join("publication_types", ";").alias("publication_types"), "language", F.array_join("keywords", ";").alias("keywords"))


@query(
    "s03_scan_jats_xml",
    f"""select 'PMC' || cast(doc_id as varchar) as pmcid, {q_clean(_T)} as title, case when doc_id % 2 = 0 then md5('Aim: ' || {q_clean('text')}) else md5({q_clean('text')} || chr(10) || 'last') end as abstract_md5,
 'Bo ' || source as authors, case when doc_id % 3 = 0 then '2021-04-09' else '2020' end as publication_date, case when doc_id % 3 = 0 then 2021 else 2020 end as publication_year,
 'research-article;Biology' as publication_types, 'https://licence.example' as license, 'Journal of ' || lang as journal_title from documents where doc_id % 11 <> 5 and {q_clean(_T)} is not null""",
)
def scan_jats_xml(spark, sf_dir):
    d = _docs(spark, sf_dir)
    body = _xml(F.col("text"))
    abstract = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("<sec><title>Aim</title><p>"), body, F.lit("</p></sec>"))
    ).otherwise(F.concat(F.lit("<p>"), body, F.lit("</p><p>last</p>")))
    date = F.when(
        F.col("doc_id") % 3 == 0,
        F.lit('<pub-date pub-type="ppub"><year>2020</year></pub-date><pub-date pub-type="epub"><year>2021</year><month>4</month><day>9</day></pub-date>'),
    ).otherwise(F.lit('<pub-date pub-type="ppub"><year>2020</year></pub-date>'))
    people = F.concat(
        F.lit('<contrib-group><contrib contrib-type="author"><name><surname>'), F.col("source"),
        F.lit('</surname><given-names>Bo</given-names></name></contrib><contrib contrib-type="editor"><name><surname>Ed</surname></name></contrib></contrib-group>'))
    ids = F.when(F.col("doc_id") % 11 == 5, F.lit("")).otherwise(
        F.concat(F.lit('<article-id pub-id-type="pmc">'), F.col("s"), F.lit("</article-id>")))
    meta = _tag("article-meta", F.concat(
        ids, F.lit('<article-id pub-id-type="publisher-id">p</article-id><article-categories><subj-group><subject>Biology</subject></subj-group></article-categories>'),
        _tag("title-group", _tag("article-title", _xml(F.col("title")))), people, date,
        F.lit('<permissions><license xlink:href="https://licence.example"><license-p>free</license-p></license></permissions>'), _tag("abstract", abstract)))
    front = _tag("front", F.concat(
        _tag("journal-meta", _tag("journal-title-group", _tag("journal-title", F.concat(F.lit("Journal of "), F.col("lang"))))), meta))
    xml = _tag("article", front, ' article-type="research-article" xmlns:xlink="http://www.w3.org/1999/xlink"')
    good, _ = B.scan_jats_xml(spark, _write_lines(d.withColumn("xml", xml), "xml", "articles"), "run")
    return good.select(
        "pmcid", "title", F.md5("abstract").alias("abstract_md5"), F.array_join(F.transform("authors", lambda a: a["full_name"]), ";").alias("authors"),
        "publication_date", "publication_year", F.array_join("publication_types", ";").alias("publication_types"), "license", "journal_title")


@query(
    "s04_scan_epmc_json",
    f"""select coalesce(case when doc_id % 4 <> 0 then 'E' || cast(doc_id as varchar) end, case when doc_id % 3 = 0 then 'PMC' || cast(doc_id as varchar) end, cast(doc_id as varchar)) as source_record_id,
 {A.q_single(_T)} as title, 'F ' || source as first_author, 'Review;Letter' as publication_types, 2001 as publication_year, cast(doc_id % 7 as integer) as citation_count,
 case doc_id % 3 when 0 then true when 1 then false end as is_open_access, 1 as files, doc_id % 2 = 0 as can_download_full_text,
 case when doc_id % 3 = 0 then 'https://europepmc.org/article/PMC/PMC' || cast(doc_id as varchar) else 'https://europepmc.org/article/MED/' || cast(doc_id as varchar) end as landing_url
 from documents where {A.q_single(_T)} is not null""",
)
def scan_epmc_json(spark, sf_dir):
    d = _docs(spark, sf_dir)
    s = F.col("s")
    result = F.struct(
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("E"), s)).alias("id"), F.lit("MED").alias("source"), s.alias("pmid"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("PMC"), s)).alias("pmcid"), F.col("title").alias("title"),
        F.concat(F.lit("F "), F.col("source"), F.lit(", Other")).alias("authorString"), F.lit("2001").alias("pubYear"),
        F.concat(F.lit("<h4>Aim</h4>"), F.col("text")).alias("abstractText"),
        F.struct(F.array(F.lit("Review"), F.lit("review"), F.lit("Letter")).alias("pubType")).alias("pubTypeList"),
        F.when(F.col("doc_id") % 3 == 0, "Y").when(F.col("doc_id") % 3 == 1, "N").alias("isOpenAccess"), F.lit("N").alias("inEPMC"),
        (F.col("doc_id") % 7).cast("string").alias("citedByCount"),
        F.struct(F.array(
            F.struct(F.lit("https://doi.org/x").alias("url"), F.lit("doi").alias("documentStyle"), F.lit("DOI").alias("site"), F.lit("Free").alias("availability"), F.lit("F").alias("availabilityCode")),
            F.struct(F.concat(F.lit("https://x.org/"), s, F.lit(".pdf")).alias("url"), F.lit("pdf").alias("documentStyle"), F.lit("S").alias("site"),
                     F.when(F.col("doc_id") % 2 == 0, "Open access").otherwise("Subscription required").alias("availability"), F.lit(None).cast("string").alias("availabilityCode")),
        ).alias("fullTextUrl")).alias("fullTextUrlList"))
    page = F.to_json(F.struct(F.lit(1).alias("hitCount"), F.struct(F.array(result).alias("result")).alias("resultList")))
    good, _ = B.scan_epmc_json(spark, _write_lines(d.withColumn("j", page), "j"), "run")
    return good.select(
        "source_record_id", "title", "first_author", F.array_join("publication_types", ";").alias("publication_types"), "publication_year",
        "citation_count", "is_open_access", F.size("full_text_resources").alias("files"), "can_download_full_text", "landing_url")


@query(
    "s05_scan_s2_json",
    f"""select 'p' || cast(doc_id as varchar) as source_record_id, '10.2/' || cast(doc_id as varchar) as doi, {A.q_single(_T)} as title, md5({A.q_single('text')}) as abstract_md5,
 case doc_id % 3 when 0 then 'JN' when 1 then 'PV' else 'VE' end as journal_title, 'N ' || source as first_author, 'Medicine;Biology' as keywords, doc_id % 2 = 0 as has_full_text,
 case when doc_id % 2 = 0 then substr(sha1('https://x.org/' || cast(doc_id as varchar)), 1, 12) end as digest from documents where doc_id % 13 <> 1 and {A.q_single(_T)} is not null""",
)
def scan_s2_json(spark, sf_dir):
    d = _docs(spark, sf_dir)
    s = F.col("s")
    j = F.to_json(F.struct(
        F.when(F.col("doc_id") % 13 != 1, F.concat(F.lit("p"), s)).alias("paperId"), F.create_map(F.lit("doi"), F.concat(F.lit("10.2/"), s), F.lit("CorpusId"), s).alias("externalIds"),
        F.col("title"), F.col("text").alias("abstract"), F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("JN").alias("name"))).alias("journal"),
        F.when(F.col("doc_id") % 3 == 1, F.struct(F.lit("PV").alias("name"))).alias("publicationVenue"), F.lit("VE").alias("venue"),
        F.array(F.struct(s.alias("authorId"), F.concat(F.lit("N "), F.col("source")).alias("name"))).alias("authors"),
        F.array(F.lit("Medicine"), F.lit("medicine"), F.lit("Biology")).alias("fieldsOfStudy"),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.concat(F.lit("https://x.org/"), s).alias("url"), F.lit("GOLD").alias("status"))).alias("openAccessPdf")))
    good, _ = B.scan_s2_json(spark, _write_lines(d.withColumn("j", j), "j"), "run")
    return good.select(
        "source_record_id", "doi", "title", F.md5("abstract").alias("abstract_md5"), "journal_title", "first_author", F.array_join("keywords", ";").alias("keywords"),
        "has_full_text", F.substring_index(F.get("full_text_resources", F.lit(0))["resource_id"], ":", -1).alias("digest"))


@query(
    "s06_scan_preprint_json",
    f"""select '10.1101/' || cast(doc_id as varchar) as doi, {A.q_single("'v3 ' || " + _T)} as title, 3 as preprint_version, 'A One;B Two' as authors, 2022 as publication_year, '10.5/p' as published_doi,
 'https://www.biorxiv.org/content/10.1101/' || cast(doc_id as varchar) || 'v3' as landing_url from documents where doc_id % 5 <> 2 and doc_id % 7 <> 3""",
)
def scan_preprint_json(spark, sf_dir):
    d = _docs(spark, sf_dir)
    own = F.concat(F.lit("10.1101/"), F.col("s"))

    def version(v):
        return F.struct(
            F.when(F.col("doc_id") % 5 == 2, F.lit("10.1101/other")).otherwise(F.upper(own)).alias("doi"), F.concat(F.lit(f"v{v} "), F.col("title")).alias("title"),
            F.lit("A One| B Two").alias("authors"), F.lit("2022-05-01").alias("date"), F.lit(str(v)).alias("version"),
            F.when(F.col("doc_id") % 7 == 3, "medRxiv").otherwise("bioRxiv").alias("server"), F.lit("10.5/p").alias("published"), F.col("text").alias("abstract"))

    j = F.to_json(F.struct(own.alias("requested_doi"), F.lit("biorxiv").alias("requested_server"), F.array(version(1), version(3), version(2)).alias("collection")))
    good, _ = B.scan_preprint_json(spark, _write_lines(d.withColumn("j", j), "j"), "run")
    return good.select(
        text.doi(F.col("doi")).alias("doi"), "title", "preprint_version", F.array_join(F.transform("authors", lambda a: a["full_name"]), ";").alias("authors"),
        "publication_year", "published_doi", F.replace("landing_url", F.upper(F.col("doi")), F.lower("doi")).alias("landing_url"))


@query(
    "s07_scan_oa_links",
    """select 'PMC' || cast(page_id as varchar) as pmcid, u.url, u.format, 'PMC' || cast(page_id as varchar) || ':' || u.format || ':' || substr(sha1(u.url), 1, 12) as resource_id, 'PMC' || cast(page_id as varchar) || '.' || u.ext as suggested_file_name
 from pages, lateral (select 'https://ftp.x.org/a/' || cast(page_id as varchar) || '.tar.gz' as url, 'tgz' as format, 'tar.gz' as ext union all select 'https://x.org/' || cast(page_id as varchar) || '/f.pdf', 'pdf', 'pdf') u""",
)
def scan_oa_links(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").withColumn("s", F.col("page_id").cast("string"))
    s = F.col("s")
    xml = F.concat(
        F.lit('<record id="PMC'), s, F.lit('" license="CC"><link format="tgz" href="ftp://ftp.x.org/a/'), s, F.lit('.tar.gz"/><link format="pdf" href="https://x.org/'), s,
        F.lit('/f.pdf"/><link format="pdf" href="HTTPS://X.org/ignored"/><link format="pdf" href="https://x.org/'), s, F.lit('/F.pdf"/></record>'))
    return B.scan_oa_links(spark, _write_lines(p.withColumn("x", xml), "x", "OA")).select("pmcid", "url", "format", "resource_id", "suggested_file_name")


@query(
    "s08_scan_id_crosswalk",
    f"""with {A.DUCK_REC} select pmid, pmcid, {A.q_fold('doi')} as doi, case when record_id % 2 = 0 then true else false end as live, case when record_id % 3 = 0 then date '2020-01-31' end as release_date,
 case when pmcid is not null then 'pmcid' when pmid is not null then 'pmid' when doi is not null then 'doi' end as kind from rec""",
)
def scan_id_crosswalk(spark, sf_dir):
    rec = A.records(spark, sf_dir)
    path = scale.new_path(spark, "crosswalk")
    rec.select(
        "pmid", F.lower("pmcid").alias("pmcid"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.lit("m").alias("mid"),
        F.when(F.col("record_id") % 2 == 0, "true").otherwise("no").alias("live"),
        F.when(F.col("record_id") % 3 == 0, "2020-01-31").otherwise("2020-01").alias("release_date"),
    ).write.option("header", "true").csv(path)
    x = B.scan_id_crosswalk(spark, path)
    kind = B.identifier_kind(F.coalesce("pmcid", "pmid", "doi"))
    return x.select("pmid", "pmcid", "doi", "live", "release_date", kind.alias("kind"))


@query(
    "s09_scan_query_set",
    """with q as (select case when item_id % 10 = 9 then 'q1' else 'q' || cast(item_id as varchar) end as id, case when item_id % 8 = 7 then ' ' else text end as query, item_id from benchmark)
 select id, md5(query) as query_md5, concat_ws(',', case when count(*) over (partition by id) > 1 then 'repeated_id' end, case when trim(query) = '' then 'blank_query' end) as issues from q""",
)
def scan_query_set(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark")
    rows = b.select(
        F.when(F.col("item_id") % 10 == 9, "q1").otherwise(F.concat(F.lit("q"), F.col("item_id").cast("string"))).alias("id"),
        F.when(F.col("item_id") % 8 == 7, " ").otherwise(F.col("text")).alias("query"), F.lit("new_research").alias("expected_intent"))
    path = scale.new_path(spark, "questions")
    rows.write.json(path)
    return B.load_questions(spark, path, strict=False, multi_line=False).select("id", F.md5("query").alias("query_md5"), F.array_join("issues", ",").alias("issues"))


_BLOCKS = "|".join(markup.BLOCK_TAGS)


# Pages have one script each, whose content is text; it is cut out, cleaned apart and put back.
_REFERENCES = "replace(" * 6 + "{t}" + "".join(
    f", '{name}', '{char}')" for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp", "&")))


def _plain(x):
    tags = rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->|<[!?][^>]*>', '', 'g'), '(?i)</?(?:{_BLOCKS})(?:[\s/][^>]*)?>', chr(10), 'g'), '</?[A-Za-z][^>]*>', '', 'g')"
    return _REFERENCES.format(t=f"replace({tags}, '&amp;', '&amp')")


@query(
    "s13_html_to_text",
    rf"""with cut as (select page_id, regexp_extract(html, '(?s)^(.*)<script>(.*)</script>(.*)$', ['head', 'script', 'rest']) as x from pages),
 plain as (select page_id, {_plain("x.head")} || x.script || {_plain("x.rest")} as t from cut)
select page_id, nullif(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {A.q_single('x')}), lambda x: x <> ''), chr(10)), '') as body from plain""",
)
def html_to_text(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    return p.select("page_id", markup.html_text(F.col("html")).alias("body"))


_CLEAN = "replace(replace(text, '<', ' '), '&', ' ')"
_FRAG = f"""'<h4 title="a>b">Aim</h4><p class=''x > y'' id = "1">' || {_CLEAN} || ' &amp; more &apos;x&apos; &hellip;&notin; &copy 5 &notit &#x41;&#066;&#128; &nope; &</p>tail<br data-x="</p>">  <b>end</b>  '"""
_TAIL = "' & more ''x'' …∉ © 5 ¬it AB€ &nope; &'"


@query(
    "s13_html_fragment",
    f"""select doc_id, array_to_string(list_filter(list_transform(string_split_regex('Aim' || chr(10) || {_CLEAN} || {_TAIL} || chr(10) || 'tail' || chr(10) || 'end',
  '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {A.q_single('x')}), lambda x: x <> ''), chr(10)) as body from documents""",
)
def html_fragment(spark, sf_dir):
    """Quoted signs and references of every kind around each whole text."""
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", markup.html_text(F.expr(_FRAG)).alias("body"))
