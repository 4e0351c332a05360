"""Bulk readers for the formats the literature providers deliver.

Every reader uses Spark's own splittable XML or JSON source with a declared
schema and returns (good, bad): provider rows ready for ``records.unify``, and
the rows that lack an identifier or title, with an issue code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import dates, markup, text, values
from litmill.operators import records

_TAG = r"</?[A-Za-z][\w:.-]*(?:\s[^<>]*)?/?>"


def xml_text(c: Column) -> Column:
    """Text of an element that may hold inline markup: tags dropped, entities decoded, one line."""
    s = F.regexp_replace(c, _TAG, "")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(code), F.lit(char))
    return text.single_line(s)


def _read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("mode", "PERMISSIVE")
        .schema(f"{schema}, _corrupt_record string")
        .load(path)
    )


def _split(rows: DataFrame, run_id: str, *rules: tuple[Column, str]) -> tuple[DataFrame, DataFrame]:
    """Rows without issues, and the others with their codes."""
    from litmill.operators.quality import codes

    checked = rows.withColumn("search_run_id", F.lit(run_id)).withColumn("issues", codes(*rules))
    good = checked.filter(F.size("issues") == 0).drop("issues")
    return good, checked.filter(F.size("issues") > 0)


def _filled(values_: Column, clean=text.single_line) -> Column:
    return F.filter(
        F.coalesce(F.transform(values_, clean), F.array().cast("array<string>")),
        lambda x: x.isNotNull(),
    )


def _author(full: Column, **parts: Column) -> Column:
    names = (
        "first_name", "last_name", "initials", "collective_name", "orcid", "source_author_id",
    )
    rest = [parts.get(n, F.lit(None)).cast("string").alias(n) for n in names]
    return F.struct(full.alias("full_name"), *rest)


def _named(authors: Column) -> Column:
    return F.filter(authors, lambda a: a["full_name"].isNotNull())


PUBMED_SCHEMA = """
MedlineCitation struct<
  PMID: string,
  Article: struct<
    Journal: struct<
      ISSN: array<struct<_VALUE: string, _IssnType: string>>,
      JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string, MedlineDate: string>>,
      Title: string, ISOAbbreviation: string>,
    ArticleTitle: string,
    Abstract: string,
    AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, Initials: string, CollectiveName: string>>>,
    Language: array<string>,
    PublicationTypeList: struct<PublicationType: array<string>>,
    ArticleDate: array<struct<Year: string, Month: string, Day: string>>>,
  KeywordList: array<struct<Keyword: array<string>>>>,
PubmedData struct<
  PublicationStatus: string,
  ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>
"""


def _labelled_sections(inner: Column) -> Column:
    """Abstract text from inner XML: labelled sections joined by line breaks."""
    pattern = r"(?s)<AbstractText\b([^>]*)>(.*?)</AbstractText>"
    attrs = F.regexp_extract_all(inner, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(inner, F.lit(pattern), F.lit(2))

    def attribute(a: Column, name: str) -> Column:
        return text.null_if_empty(F.regexp_extract(a, rf'\b{name}="([^"]*)"', 1))

    def section(pair: Column) -> Column:
        label = F.coalesce(attribute(pair["a"], "Label"), attribute(pair["a"], "NlmCategory"))
        body = xml_text(pair["b"])
        return F.when(
            body.isNotNull(), F.when(label.isNotNull(), F.concat_ws(": ", label, body)).otherwise(body)
        )

    pairs = F.transform(
        F.arrays_zip(attrs.alias("a"), bodies.alias("b")), section
    )
    joined = text.null_if_empty(F.array_join(F.array_compact(pairs), "\n"))
    return F.when(F.size(bodies) > 0, joined).otherwise(xml_text(inner))


def scan_pubmed_xml(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Article sets in PubMed XML."""
    raw = _read_xml(spark, path, "PubmedArticle", PUBMED_SCHEMA)
    art, journal = "MedlineCitation.Article", "MedlineCitation.Article.Journal"
    pmid = xml_text(F.col("MedlineCitation.PMID"))

    def id_of(kind: str) -> Column:
        found = F.filter(
            F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: F.lower(x["_IdType"]) == kind
        )
        # The last id of a kind counts.
        return text.single_line(F.try_element_at(found, F.lit(-1))["_VALUE"])

    def issn_of(kind: str) -> Column:
        found = F.filter(F.col(f"{journal}.ISSN"), lambda x: F.lower(x["_IssnType"]) == kind)
        return text.single_line(F.try_element_at(found, F.lit(-1))["_VALUE"])

    any_issn = text.single_line(F.get(F.col(f"{journal}.ISSN"), F.lit(0))["_VALUE"])
    first = F.get(F.col(f"{art}.ArticleDate"), F.lit(0))
    issue = F.col(f"{journal}.JournalIssue.PubDate")
    loose = text.single_line(issue["MedlineDate"])
    loose_year = text.null_if_empty(F.regexp_extract(loose, r"\b(\d{4})\b", 1))

    def part(name: str) -> Column:
        return text.single_line(F.when(first.isNotNull(), first[name]).otherwise(issue[name]))

    year = F.coalesce(part("Year"), F.when(first.isNull(), loose_year))
    stated = dates.partial_date(year, part("Month"), part("Day"))
    authors = _named(
        F.transform(
            F.coalesce(F.col(f"{art}.AuthorList.Author"), F.array()),
            lambda a: _author(
                text.person_name(a["CollectiveName"], a["ForeName"], a["LastName"], a["Initials"]),
                first_name=text.single_line(a["ForeName"]),
                last_name=text.single_line(a["LastName"]),
                initials=text.single_line(a["Initials"]),
                collective_name=text.single_line(a["CollectiveName"]),
            ),
        )
    )
    rows = raw.select(
        pmid.alias("source_record_id"),
        F.concat(F.lit("pubmed:pmid:"), pmid).alias("source_article_id"),
        pmid.alias("pmid"),
        id_of("pmc").alias("pmcid"),
        id_of("doi").alias("doi"),
        xml_text(F.col(f"{art}.ArticleTitle")).alias("title"),
        _labelled_sections(F.col(f"{art}.Abstract")).alias("abstract"),
        authors.alias("authors"),
        F.get(authors, F.lit(0))["full_name"].alias("first_author"),
        xml_text(F.col(f"{journal}.Title")).alias("journal_title"),
        xml_text(F.col(f"{journal}.ISOAbbreviation")).alias("journal_abbreviation"),
        F.coalesce(issn_of("print"), any_issn).alias("issn"),
        issn_of("electronic").alias("electronic_issn"),
        F.coalesce(stated, F.when(first.isNull(), loose)).alias("publication_date"),
        dates.year_number(year).alias("publication_year"),
        _filled(F.col(f"{art}.PublicationTypeList.PublicationType"), xml_text).alias("publication_types"),
        text.single_line(F.col("PubmedData.PublicationStatus")).alias("publication_status"),
        text.single_line(F.get(F.col(f"{art}.Language"), F.lit(0))).alias("language"),
        _filled(F.flatten(F.col("MedlineCitation.KeywordList.Keyword")), xml_text).alias("keywords"),
        F.lit(False).alias("has_full_text"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("landing_url"),
        "_corrupt_record",
    )
    return _split(
        rows, run_id, (F.col("pmid").isNull(), "no_pmid"), (F.col("title").isNull(), "no_title")
    )


JATS_SCHEMA = """
`_article-type` string,
front struct<
  `journal-meta`: struct<`journal-title-group`: struct<`journal-title`: string>, `journal-title`: string>,
  `article-meta`: struct<
    `article-id`: array<struct<_VALUE: string, `_pub-id-type`: string>>,
    `article-categories`: struct<`subj-group`: array<struct<subject: array<string>>>>,
    `title-group`: struct<`article-title`: string>,
    `contrib-group`: array<struct<contrib: array<struct<
      `_contrib-type`: string, collab: string, name: struct<surname: string, `given-names`: string>>>>>,
    `pub-date`: array<struct<`_pub-type`: string, `_publication-format`: string, year: string, month: string, day: string>>,
    permissions: struct<license: struct<`_xlink:href`: string, `_href`: string, `license-p`: string>>,
    abstract: array<string>>>
"""


def _jats_abstract(inner: Column) -> Column:
    """Titled sections one per line, else paragraphs one per line, else the whole text."""
    secs = F.regexp_extract_all(inner, F.lit(r"(?s)<sec\b[^>]*>(.*?)</sec>"), F.lit(1))
    p_pattern = r"(?s)<p\b[^>]*>(.*?)</p>"

    def paragraphs(c: Column, sep: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(p_pattern), F.lit(1))
        return text.null_if_empty(
            F.array_join(F.array_compact(F.transform(found, xml_text)), sep)
        )

    def section(c: Column) -> Column:
        title = xml_text(F.regexp_extract(c, r"(?s)<title\b[^>]*>(.*?)</title>", 1))
        return text.null_if_empty(F.concat_ws(": ", title, paragraphs(c, " ")))

    titled = text.null_if_empty(
        F.array_join(F.array_compact(F.transform(secs, section)), "\n")
    )
    return F.coalesce(titled, paragraphs(inner, "\n"), xml_text(inner))


def scan_jats_xml(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Full-text articles in JATS XML."""
    raw = _read_xml(spark, path, "article", JATS_SCHEMA)
    meta = F.col("front.`article-meta`")

    def id_of(kind: str) -> Column:
        found = F.filter(meta["article-id"], lambda x: F.lower(x["_pub-id-type"]) == kind)
        return text.single_line(F.try_element_at(found, F.lit(-1))["_VALUE"])

    pmcid = text.pmcid(F.coalesce(id_of("pmcid"), id_of("pmc")))
    people = F.flatten(F.transform(meta["contrib-group"], lambda g: g["contrib"]))
    people = F.filter(
        people, lambda p: F.lower(F.coalesce(p["_contrib-type"], F.lit("author"))) == "author"
    )
    authors = _named(
        F.transform(
            F.coalesce(people, F.array()),
            lambda p: _author(
                text.person_name(
                    xml_text(p["collab"]), xml_text(p["name"]["given-names"]),
                    xml_text(p["name"]["surname"]), F.lit(None).cast("string"),
                ),
                first_name=xml_text(p["name"]["given-names"]),
                last_name=xml_text(p["name"]["surname"]),
                collective_name=xml_text(p["collab"]),
            ),
        )
    )
    pub_dates = meta["pub-date"]
    electronic = F.filter(
        pub_dates,
        lambda d: F.coalesce(d["_pub-type"], d["_publication-format"]).isin("epub", "electronic"),
    )
    day = F.coalesce(F.get(electronic, F.lit(0)), F.get(pub_dates, F.lit(0)))
    subjects = F.flatten(
        F.transform(meta["article-categories"]["subj-group"], lambda g: g["subject"])
    )
    types = records.distinct_texts(
        F.array_compact(
            F.concat(
                F.array(F.col("`_article-type`")),
                F.coalesce(F.transform(subjects, xml_text), F.array().cast("array<string>")),
            )
        )
    )
    licence = meta["permissions"]["license"]
    rows = raw.select(
        pmcid.alias("source_record_id"),
        F.concat(F.lit("pmc:pmcid:"), pmcid).alias("source_article_id"),
        pmcid.alias("pmcid"),
        id_of("pmid").alias("pmid"),
        id_of("doi").alias("doi"),
        xml_text(meta["title-group"]["article-title"]).alias("title"),
        _jats_abstract(F.get(meta["abstract"], F.lit(0))).alias("abstract"),
        authors.alias("authors"),
        F.get(authors, F.lit(0))["full_name"].alias("first_author"),
        F.coalesce(
            xml_text(F.col("front.`journal-meta`.`journal-title-group`.`journal-title`")),
            xml_text(F.col("front.`journal-meta`.`journal-title`")),
        ).alias("journal_title"),
        dates.padded_date(day["year"], day["month"], day["day"]).alias("publication_date"),
        dates.year_number(text.single_line(day["year"])).alias("publication_year"),
        types.alias("publication_types"),
        F.coalesce(
            text.single_line(licence["_xlink:href"]), text.single_line(licence["_href"]),
            xml_text(licence["license-p"]),
        ).alias("license"),
        F.lit(True).alias("has_full_text"),
        F.lit(False).alias("can_download_full_text"),
        F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid, F.lit("/")).alias("landing_url"),
        "_corrupt_record",
    )
    return _split(
        rows, run_id, (F.col("pmcid").isNull(), "no_pmcid"), (F.col("title").isNull(), "no_title")
    )


EPMC_SCHEMA = """
hitCount long,
resultList struct<result: array<struct<
  id: string, source: string, pmid: string, pmcid: string, doi: string, title: string,
  authorString: string,
  authorList: struct<author: array<struct<fullName: string, firstName: string, lastName: string,
    initials: string, authorId: struct<type: string, value: string>>>>,
  journalTitle: string, journalIssn: string,
  journalInfo: struct<printPublicationDate: string, dateOfPublication: string,
    journal: struct<title: string, ISOAbbreviation: string, medlineAbbreviation: string, ISSN: string, ESSN: string>>,
  pubYear: string, firstPublicationDate: string, electronicPublicationDate: string,
  abstractText: string, publicationStatus: string, language: string, license: string,
  pubTypeList: struct<pubType: array<string>>, keywordList: struct<keyword: array<string>>,
  isOpenAccess: string, inEPMC: string, inPMC: string, hasPDF: string, citedByCount: string,
  fullTextUrlList: struct<fullTextUrl: array<struct<url: string, documentStyle: string, site: string,
    availability: string, availabilityCode: string>>>>>>
"""


def _read_json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return (
        spark.read.option("multiLine", str(multi_line).lower())
        .option("mode", "PERMISSIVE")
        .schema(f"{schema}, _corrupt_record string")
        .json(path)
    )


def _epmc_resources(article: Column, raw: Column) -> Column:
    def made(r: Column) -> Column:
        url = text.single_line(r["url"])
        fmt = records.sniff_format(text.single_line(r["documentStyle"]), url)
        open_access = records.resource_open_access(r["availability"], r["availabilityCode"])
        digest = values.short_sha1(url)
        return F.struct(
            F.lit("europe_pmc").alias("source"),
            F.concat_ws(":", article, fmt, digest).alias("resource_id"),
            fmt.alias("format"),
            text.single_line(r["documentStyle"]).alias("original_style"),
            url.alias("url"),
            text.single_line(r["site"]).alias("site"),
            text.single_line(r["availability"]).alias("availability"),
            text.single_line(r["availabilityCode"]).alias("availability_code"),
            F.lit(None).cast("string").alias("license"),
            open_access.alias("is_open_access"),
            open_access.alias("is_downloadable"),
            text.safe_file_name(
                F.concat_ws("_", F.replace(article, F.lit(":"), F.lit("_")), digest), fmt
            ).alias("suggested_file_name"),
        )

    def wanted(r: Column) -> Column:
        landing = F.lit(False)
        for c in ("documentStyle", "site"):
            landing = landing | F.coalesce(F.lower(F.trim(r[c])) == "doi", F.lit(False))
        return text.http_url(r["url"], need_host=True).isNotNull() & ~landing

    made_all = F.transform(F.filter(F.coalesce(raw, F.array()), wanted), made)
    urls = F.transform(made_all, lambda r: text.fold(r["url"]))
    return F.filter(
        made_all, lambda r, i: F.array_position(urls, text.fold(r["url"])) == i + 1
    )


def scan_epmc_json(
    spark: SparkSession, path: str, run_id: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Pages of Europe PMC core results, one JSON document per line (or per file)."""
    pages = _read_json(spark, path, EPMC_SCHEMA, multi_line)
    r = pages.select(F.explode("resultList.result").alias("r"), "_corrupt_record")
    pmid, pmcid, doi = (text.single_line(F.col(f"r.{c}")) for c in ("pmid", "pmcid", "doi"))
    own = F.coalesce(text.single_line(F.col("r.id")), pmcid, pmid, doi)
    base = F.coalesce(text.single_line(F.col("r.source")), F.lit("unknown"))
    article = F.concat_ws(":", F.lit("europe_pmc"), base, own)
    authors = _named(
        F.transform(
            F.coalesce(F.col("r.authorList.author"), F.array()),
            lambda a: _author(
                text.single_line(a["fullName"]),
                first_name=text.single_line(a["firstName"]),
                last_name=text.single_line(a["lastName"]),
                initials=text.single_line(a["initials"]),
                orcid=F.when(
                    F.lower(F.trim(a["authorId"]["type"])) == "orcid",
                    text.single_line(a["authorId"]["value"]),
                ),
            ),
        )
    )
    journal = F.col("r.journalInfo.journal")
    info = F.col("r.journalInfo")
    one = text.single_line
    in_full = F.coalesce(values.to_bool(F.col("r.inEPMC")), F.lit(False)) | F.coalesce(
        values.to_bool(F.col("r.inPMC")), F.lit(False)
    )
    rows = r.select(
        own.alias("source_record_id"),
        article.alias("source_article_id"),
        pmid.alias("pmid"), pmcid.alias("pmcid"), doi.alias("doi"),
        one(F.col("r.title")).alias("title"),
        markup.html_text(one(F.col("r.abstractText"))).alias("abstract"),
        authors.alias("authors"),
        F.coalesce(
            F.get(authors, F.lit(0))["full_name"], text.first_author(one(F.col("r.authorString")))
        ).alias("first_author"),
        F.coalesce(one(journal["title"]), one(F.col("r.journalTitle"))).alias("journal_title"),
        F.coalesce(one(journal["ISOAbbreviation"]), one(journal["medlineAbbreviation"])).alias(
            "journal_abbreviation"
        ),
        F.coalesce(one(journal["ISSN"]), one(F.col("r.journalIssn"))).alias("issn"),
        one(journal["ESSN"]).alias("electronic_issn"),
        F.coalesce(
            one(F.col("r.firstPublicationDate")), one(F.col("r.electronicPublicationDate")),
            one(info["printPublicationDate"]), one(info["dateOfPublication"]),
        ).alias("publication_date"),
        values.to_int(F.col("r.pubYear")).alias("publication_year"),
        records.distinct_texts(F.col("r.pubTypeList.pubType")).alias("publication_types"),
        one(F.col("r.publicationStatus")).alias("publication_status"),
        one(F.col("r.language")).alias("language"),
        records.distinct_texts(F.col("r.keywordList.keyword")).alias("keywords"),
        values.to_bool(F.col("r.isOpenAccess")).alias("is_open_access"),
        one(F.col("r.license")).alias("license"),
        _epmc_resources(article, F.col("r.fullTextUrlList.fullTextUrl")).alias("full_text_resources"),
        in_full.alias("_in_full"),
        values.to_int(F.col("r.citedByCount")).alias("citation_count"),
        F.when(pmcid.isNotNull(), F.concat(F.lit("https://europepmc.org/article/PMC/"), pmcid))
        .when(pmid.isNotNull(), F.concat(F.lit("https://europepmc.org/article/MED/"), pmid))
        .when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi))
        .alias("landing_url"),
        "_corrupt_record",
    )
    any_file = F.exists(
        "full_text_resources", lambda x: F.coalesce(x["is_downloadable"], F.lit(False))
    )
    rows = rows.withColumn(
        "has_full_text", (F.size("full_text_resources") > 0) | F.col("_in_full")
    ).withColumn("can_download_full_text", any_file).drop("_in_full")
    return _split(
        rows, run_id, (F.col("source_record_id").isNull(), "no_stable_id"),
        (F.col("title").isNull(), "no_title"),
    )


S2_SCHEMA = """
paperId string, externalIds map<string,string>, title string, abstract string, year string,
publicationDate string, venue string, journal struct<name: string>, publicationVenue struct<name: string>,
authors array<struct<authorId: string, name: string>>, publicationTypes array<string>,
fieldsOfStudy array<string>, citationCount string, isOpenAccess string,
openAccessPdf struct<url: string, status: string, license: string>, url string
"""


def scan_s2_json(
    spark: SparkSession, path: str, run_id: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Semantic Scholar papers, one JSON object per line (or per file)."""
    raw = _read_json(spark, path, S2_SCHEMA, multi_line)
    one = text.single_line

    def external(key: str) -> Column:
        same = F.map_filter(F.col("externalIds"), lambda k, v: F.lower(k) == key.lower())
        return one(F.get(F.map_values(same), F.lit(0)))

    authors = _named(
        F.transform(
            F.coalesce("authors", F.array()),
            lambda a: _author(one(a["name"]), source_author_id=one(a["authorId"])),
        )
    )
    paper = one(F.col("paperId"))
    url = text.http_url(F.col("openAccessPdf.url"), need_host=True)
    digest = values.short_sha1(url)
    resource = F.struct(
        F.lit("semantic_scholar").alias("source"),
        F.concat_ws(":", F.lit("semantic_scholar"), paper, F.lit("pdf"), digest).alias("resource_id"),
        F.lit("pdf").alias("format"),
        F.lit("pdf").alias("original_style"),
        url.alias("url"),
        F.lit(None).cast("string").alias("site"),
        one(F.col("openAccessPdf.status")).alias("availability"),
        F.lit(None).cast("string").alias("availability_code"),
        one(F.col("openAccessPdf.license")).alias("license"),
        F.lit(True).alias("is_open_access"),
        F.lit(True).alias("is_downloadable"),
        F.concat(F.lit("semantic_scholar_"), paper, F.lit("_"), digest, F.lit(".pdf")).alias(
            "suggested_file_name"
        ),
    )
    resources = F.array_compact(F.array(F.when(url.isNotNull(), resource)))
    rows = raw.select(
        paper.alias("source_record_id"),
        F.concat(F.lit("semantic_scholar:paper:"), paper).alias("source_article_id"),
        external("DOI").alias("doi"),
        external("PubMed").alias("pmid"),
        external("PubMedCentral").alias("pmcid"),
        one(F.col("title")).alias("title"),
        one(F.col("abstract")).alias("abstract"),
        authors.alias("authors"),
        F.get(authors, F.lit(0))["full_name"].alias("first_author"),
        F.coalesce(
            one(F.col("journal.name")), one(F.col("publicationVenue.name")), one(F.col("venue"))
        ).alias("journal_title"),
        one(F.col("publicationDate")).alias("publication_date"),
        values.to_int(F.col("year")).alias("publication_year"),
        records.distinct_texts(F.col("publicationTypes")).alias("publication_types"),
        records.distinct_texts(F.col("fieldsOfStudy")).alias("keywords"),
        values.to_int(F.col("citationCount")).alias("citation_count"),
        values.to_bool(F.col("isOpenAccess")).alias("is_open_access"),
        (F.size(resources) > 0).alias("has_full_text"),
        resources.alias("full_text_resources"),
        F.get(resources, F.lit(0))["license"].alias("license"),
        text.http_url(F.col("url"), need_host=True).alias("landing_url"),
        "_corrupt_record",
    )
    return _split(
        rows, run_id, (F.col("source_record_id").isNull(), "no_paper_id"),
        (F.col("title").isNull(), "no_title"),
    )


PREPRINT_SCHEMA = """
requested_doi string, requested_server string,
collection array<struct<doi: string, title: string, authors: string, date: string, version: string,
  server: string, category: string, type: string, license: string, abstract: string,
  jatsxml: string, published: string>>
"""


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Row with the highest version per key (no version counts as 0); earliest on ties."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(version, F.lit(0)), -F.col("_place")))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def scan_preprint_json(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Preprint details, one response per line; one row per DOI at its highest version."""
    raw = _read_json(spark, path, PREPRINT_SCHEMA, False)
    one = text.single_line
    versions = raw.select(
        "requested_doi", "requested_server", F.posexplode("collection").alias("_place", "c")
    ).withColumn("version", values.to_int(F.col("c.version")))
    best = latest_version(versions, "requested_doi", "version")
    doi = one(F.col("c.doi"))
    server = F.col("requested_server")
    names = F.transform(
        F.split(F.replace(F.coalesce(one(F.col("c.authors")), F.lit("")), F.lit("|"), F.lit(";")), ";"),
        lambda n: F.trim(n),
    )
    names = F.filter(names, lambda n: n != "")
    day = one(F.col("c.date"))
    head = F.substring(day, 1, 4)
    xml_url = text.http_url(F.col("c.jatsxml"), need_host=True)
    host = F.when(server == "biorxiv", "www.biorxiv.org").otherwise("www.medrxiv.org")
    suffix = F.when(
        F.coalesce("version", F.lit(0)) != 0, F.concat(F.lit("v"), F.col("version").cast("string"))
    ).otherwise("")
    published = one(F.col("c.published"))
    article = F.concat_ws(":", server, F.lit("doi"), text.fold(doi))
    resource = F.struct(
        server.alias("source"),
        F.concat(article, F.lit(":xml")).alias("resource_id"),
        F.lit("xml").alias("format"),
        F.lit("jatsxml").alias("original_style"),
        xml_url.alias("url"),
        F.lit(None).cast("string").alias("site"),
        F.lit(None).cast("string").alias("availability"),
        F.lit(None).cast("string").alias("availability_code"),
        one(F.col("c.license")).alias("license"),
        F.lit(None).cast("boolean").alias("is_open_access"),
        F.lit(True).alias("is_downloadable"),
        text.safe_file_name(F.concat_ws("_", server, doi), F.lit("xml")).alias("suggested_file_name"),
    )
    rows = best.select(
        server.alias("source"),
        doi.alias("source_record_id"),
        article.alias("source_article_id"),
        doi.alias("doi"),
        one(F.col("c.title")).alias("title"),
        one(F.col("c.abstract")).alias("abstract"),
        F.transform(names, lambda n: _author(n)).alias("authors"),
        F.get(names, F.lit(0)).alias("first_author"),
        server.alias("journal_title"),
        day.alias("publication_date"),
        F.when(head.rlike("^[0-9]{4}$"), head.cast("int")).alias("publication_year"),
        F.array_compact(F.array(one(F.col("c.type")))).alias("publication_types"),
        F.array_compact(F.array(one(F.col("c.category")))).alias("keywords"),
        server.alias("preprint_server"),
        F.col("version").alias("preprint_version"),
        F.when(published.startswith("10."), published).alias("published_doi"),
        xml_url.isNotNull().alias("has_full_text"),
        F.array_compact(F.array(F.when(xml_url.isNotNull(), resource))).alias("full_text_resources"),
        one(F.col("c.license")).alias("license"),
        F.concat(F.lit("https://"), host, F.lit("/content/"), doi, suffix).alias("landing_url"),
        F.col("requested_doi"),
        one(F.col("c.server")).alias("_server"),
    )
    good, bad = _split(
        rows,
        run_id,
        (~text.fold(F.col("doi")).eqNullSafe(text.fold(F.col("requested_doi"))), "doi_mismatch"),
        (F.col("title").isNull(), "no_title"),
        (
            F.col("_server").isNotNull() & (F.lower("_server") != F.col("source")),
            "server_mismatch",
        ),
    )
    return good.drop("_server", "requested_doi"), bad


OA_SCHEMA = """
_id string, _license string,
link array<struct<_format: string, _href: string, _updated: string>>
"""


def scan_oa_links(spark: SparkSession, path: str) -> DataFrame:
    """Open-access file lists: one row per distinct URL of an article."""
    raw = _read_xml(spark, path, "record", OA_SCHEMA)
    rows = raw.select(
        F.col("_id").alias("pmcid"), F.posexplode("link").alias("place", "l")
    )
    href = text.single_line(F.col("l._href"))
    rows = rows.select(
        "pmcid",
        "place",
        F.when(href.rlike(r"^https?://[^/?#]+"), href)
        .when(
            href.rlike(r"^ftp://[^/?#]+"),
            F.concat(F.lit("https://"), F.regexp_extract(href, r"^ftp://([^?#]*)", 1)),
        )
        .alias("url"),
        text.single_line(F.col("l._format")).alias("original_format"),
        text.single_line(F.col("l._updated")).alias("updated_at"),
    ).filter("url is not null")
    first = F.min_by(F.struct("url", "original_format", "updated_at"), "place").alias("r")
    rows = rows.groupBy("pmcid", text.fold(F.col("url")).alias("_u")).agg(first).select("pmcid", "r.*")
    hay = F.concat_ws(" ", F.lower(F.coalesce("original_format", F.lit(""))), F.lower(
        F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)))
    fmt = (
        F.when(hay.contains("pdf"), "pdf").when(hay.contains("epub"), "epub")
        .when(hay.contains("htm"), "html").when(hay.contains("xml"), "xml")
        .when(hay.contains("tgz") | hay.contains("tar.gz") | hay.contains("tarball"), "tgz")
        .when(hay.contains("text") | hay.endswith(".txt"), "text").otherwise("other")
    )
    ext = (
        F.when(fmt == "tgz", "tar.gz").when(fmt == "text", "txt")
        .when(
            fmt == "other",
            F.coalesce(
                text.null_if_empty(F.regexp_extract("url", r"\.([A-Za-z0-9]{1,10})$", 1)), F.lit("bin")
            ),
        )
        .otherwise(fmt)
    )
    return rows.select(
        "pmcid",
        F.concat_ws(":", "pmcid", fmt, values.short_sha1(F.col("url"))).alias("resource_id"),
        fmt.alias("format"),
        "url",
        "original_format",
        "updated_at",
        F.concat_ws(".", "pmcid", ext).alias("suggested_file_name"),
    )


def identifier_kind(c: Column) -> Column:
    """pmcid, pmid or doi by the form of the text, else null."""
    s = F.trim(c)
    return (
        F.when(s.rlike(r"^(?i)PMC\d+$"), "pmcid")
        .when(s.rlike(r"^\d+$"), "pmid")
        .when(s.contains("/") | s.startswith("10."), "doi")
    )


def scan_id_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Identifier mapping table: pmid, pmcid, doi, mid, live, release date."""
    raw = (
        spark.read.option("header", "true")
        .schema("pmid string, pmcid string, doi string, mid string, live string, release_date string")
        .csv(path)
    )
    return raw.select(
        text.pmid(F.col("pmid")).alias("pmid"),
        text.pmcid(F.col("pmcid")).alias("pmcid"),
        text.doi(F.col("doi")).alias("doi"),
        text.single_line(F.col("mid")).alias("mid"),
        values.to_bool(F.col("live")).alias("live"),
        dates.iso_date(F.col("release_date")).alias("release_date"),
    )


def load_questions(
    spark: SparkSession,
    path: str,
    strict: bool = True,
    required: Sequence[str] = ("query", "expected_intent"),
    multi_line: bool = True,
) -> DataFrame:
    """Test questions from JSON; blank or repeated ids and blank texts are issues (or raise)."""
    from litmill.operators.quality import codes, demand

    raw = (
        spark.read.option("multiLine", str(multi_line).lower())
        .schema("id string, query string, expected_intent string")
        .json(path)
    )
    if strict and not raw.limit(1).count():
        raise ValueError("the question set is empty")
    counts = raw.groupBy("id").agg(F.count("*").alias("_n"))
    rows = raw.join(counts, "id", "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rows = rows.withColumn(
        "issues",
        codes(
            (blank("id"), "blank_id"),
            (F.col("_n") > 1, "repeated_id"),
            *[(blank(c), f"blank_{c}") for c in required],
        ),
    ).drop("_n")
    return demand(rows, strict)
