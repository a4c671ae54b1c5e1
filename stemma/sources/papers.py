"""Parsers of literature payloads held in a text column: each gives title, text, source_uri, doi, evidence_grade.

Fetching is left to the caller; a payload frame has one response a row in ``payload``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_grade, normalize_doi


def _plain(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def _record(rows: DataFrame, source: str, title: Column, abstract: Column, uri: Column, doi: Column, kind: Column | None = None, pub: Column | None = None) -> DataFrame:
    title, abstract = _plain(title), _plain(abstract)
    text = F.array_join(F.filter(F.array(title, abstract), lambda x: x != ""), "\n\n")
    d = normalize_doi(doi)
    link = F.coalesce(F.when(uri != "", uri), F.concat(F.lit("https://doi.org/"), d))
    kind = kind if kind is not None else F.lit(None).cast("string")
    carried = [c for c in ("page", "pos") if c in rows.columns]
    out = rows.select(*carried, F.lit(source).alias("source"), title.alias("title"), text.alias("text"), link.alias("source_uri"), d.alias("doi"), evidence_grade(F.lit(source), kind, pub).alias("evidence_grade"))
    return out.where((F.col("text") != "") & F.col("source_uri").isNotNull())


def _items(payloads: DataFrame, schema: str, path: str) -> DataFrame:
    return _each(payloads, F.from_json("payload", schema), F.col(f"p.{path}"))


def _each(payloads: DataFrame, parsed: Column, items: Column) -> DataFrame:
    """A row ``r`` for each item; rows that are told apart by ``page`` keep it, with the item's place in it."""
    if "page" not in payloads.columns:
        return payloads.select(parsed.alias("p")).select(F.explode(items).alias("r"))
    return payloads.select("page", parsed.alias("p")).select("page", F.posexplode(items).alias("pos", "r"))


def parse_arxiv(payloads: DataFrame) -> DataFrame:
    schema = "entry array<struct<id: string, title: string, summary: string>>"
    rows = _each(payloads, F.from_xml(F.regexp_replace("payload", r'\sxmlns(:\w+)?="[^"]*"', ""), schema, {"rowTag": "feed"}), F.col("p.entry")).where("trim(r.id) <> ''")
    return _record(rows, "arxiv", F.col("r.title"), F.col("r.summary"), F.trim("r.id"), F.lit(None).cast("string"))


def parse_crossref(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "message struct<items: array<struct<DOI: string, URL: string, title: array<string>, abstract: string, type: string>>>", "message.items")
    return _record(rows, "crossref", F.array_join("r.title", " "), F.col("r.abstract"), F.col("r.URL"), F.col("r.DOI"), F.col("r.type"))


def inverted_abstract(index: Column) -> Column:
    """Words in the order of their positions, from a map of word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def parse_openalex(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "results array<struct<id: string, doi: string, title: string, type: string, abstract_inverted_index: map<string, array<int>>>>", "results")
    return _record(rows, "openalex", F.col("r.title"), inverted_abstract(F.col("r.abstract_inverted_index")), F.col("r.id"), F.col("r.doi"), F.col("r.type"))


def parse_semanticscholar(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "data array<struct<title: string, abstract: string, url: string, externalIds: struct<DOI: string>, publicationTypes: array<string>>>", "data")
    return _record(rows, "semanticscholar", F.col("r.title"), F.col("r.abstract"), F.col("r.url"), F.col("r.externalIds.DOI"), F.array_join("r.publicationTypes", ","))


def parse_europepmc(payloads: DataFrame) -> DataFrame:
    """A record's address is its DOI's where it has one; see ``europepmc_links`` for its texts."""
    rows = _europepmc(payloads)
    r = F.col("r")
    doi = F.trim(F.coalesce(r["doi"], F.lit("")))
    uri = F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.concat(F.lit("https://europepmc.org/abstract/"), r["source"], F.lit("/"), r["id"]))
    return _record(rows, "europepmc", r["title"], r["abstractText"], uri, r["doi"], r["source"], r["pubType"])


def _europepmc(payloads: DataFrame) -> DataFrame:
    return _items(payloads, "resultList struct<result: array<struct<id: string, source: string, title: string, abstractText: string, doi: string, pubType: string, pmcid: string, inEPMC: string, fullTextUrlList: struct<fullTextUrl: array<struct<documentStyle: string, availability: string, url: string>>>>>>", "resultList.result")


def europepmc_links(payloads: DataFrame) -> DataFrame:
    """id, doi, pdf_url (the first open-access PDF listed) and fulltext_url (where the service itself holds the text)."""
    is_ = lambda c, v: F.lower(F.trim(c)) == v
    open_pdf = F.filter("r.fullTextUrlList.fullTextUrl", lambda x: is_(x["documentStyle"], "pdf") & is_(x["availability"], "open access"))
    own = europepmc_fulltext(F.trim(F.col("r.pmcid")), F.upper(F.trim(F.col("r.inEPMC"))))
    return _europepmc(payloads).select("r.id", normalize_doi(F.col("r.doi")).alias("doi"), F.get(open_pdf, F.lit(0))["url"].alias("pdf_url"), own.alias("fulltext_url"))


def europepmc_fulltext(pmcid: Column, in_epmc: Column) -> Column:
    return F.when((in_epmc == "Y") & pmcid.rlike(r"^PMC\d{1,12}$"), F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), pmcid, F.lit("/fullTextXML")))


#: The service has no search: a window of so many days is read and filtered here.
BIORXIV_DAYS = 28


def biorxiv_window(today: Column) -> tuple[Column, Column]:
    """First and last day of the window."""
    return F.date_sub(today, BIORXIV_DAYS), F.to_date(today)


def parse_biorxiv(payloads: DataFrame, query: str | None = None, today: str | None = None) -> DataFrame:
    """With a query, records that share one of its terms of three characters or more (none, if it has no such term);
    with a day, those dated within the window before it (undated ones stay)."""
    rows = _items(payloads, "collection array<struct<doi: string, title: string, abstract: string, date: string>>", "collection")
    if today is not None:
        first, last = biorxiv_window(F.lit(today).cast("date"))
        day = F.expr("try_cast(r.date AS date)")
        rows = rows.where(day.isNull() | day.between(first, last))
    out = _record(rows, "biorxiv", F.col("r.title"), F.col("r.abstract"), F.concat(F.lit("https://doi.org/"), F.col("r.doi")), F.col("r.doi"))
    if query is None:
        return out
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9가-힣]{3,}"), F.lit(0))
    return out.where(F.arrays_overlap(terms(F.col("text")), terms(F.lit(query))))


def parse_pubmed(payloads: DataFrame) -> DataFrame:
    schema = "PubmedArticle array<struct<MedlineCitation: struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>>>, PubmedData: struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>>>"
    rows = _each(payloads, F.from_xml("payload", schema, {"rowTag": "PubmedArticleSet"}), F.col("p.PubmedArticle"))
    article = "r.MedlineCitation.Article"
    doi = F.get(F.filter("r.PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    uri = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("r.MedlineCitation.PMID"), F.lit("/"))
    return _record(rows, "pubmed", F.col(f"{article}.ArticleTitle"), F.array_join(F.col(f"{article}.Abstract.AbstractText"), " "), uri, doi)


def parse_clinicaltrials(payloads: DataFrame) -> DataFrame:
    """A body is required; no DOI."""
    rows = _items(payloads, "studies array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string>, descriptionModule: struct<briefSummary: string, detailedDescription: string>>>>", "studies")
    p = "r.protocolSection"
    body = F.concat_ws("\n\n", F.col(f"{p}.descriptionModule.briefSummary"), F.col(f"{p}.descriptionModule.detailedDescription"))
    rows = rows.where(F.trim(body) != "").where(F.col(f"{p}.identificationModule.nctId").isNotNull())
    return _record(rows, "clinicaltrials", F.col(f"{p}.identificationModule.briefTitle"), body, F.concat(F.lit("https://clinicaltrials.gov/study/"), F.col(f"{p}.identificationModule.nctId")), F.lit(None).cast("string"))


def parse_elsevier(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "`search-results` struct<entry: array<struct<`dc:title`: string, `dc:description`: string, `prism:doi`: string, `prism:url`: string, error: string>>>", "`search-results`.entry").where("r.error IS NULL")
    return _record(rows, "elsevier", F.col("r.`dc:title`"), F.col("r.`dc:description`"), F.col("r.`prism:url`"), F.col("r.`prism:doi`"))


def parse_springer(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "records array<struct<title: string, abstract: string, doi: string, url: array<struct<value: string>>>>", "records")
    return _record(rows, "springer", F.col("r.title"), F.col("r.abstract"), F.get("r.url", F.lit(0))["value"], F.col("r.doi"))


def parse_core(payloads: DataFrame) -> DataFrame:
    rows = _items(payloads, "results array<struct<id: string, title: string, abstract: string, doi: string, downloadUrl: string>>", "results")
    return _record(rows, "core", F.col("r.title"), F.col("r.abstract"), F.coalesce("r.downloadUrl", F.concat(F.lit("https://core.ac.uk/works/"), F.col("r.id"))), F.col("r.doi"))


def parse_searxng(payloads: DataFrame, limit: int = 5) -> DataFrame:
    """Results with an abstract, ``limit`` at most a response."""
    parsed = F.from_json("payload", "results array<struct<url: string, title: string, content: string, doi: string>>")
    kept = F.slice(F.filter("p.results", lambda x: F.trim(F.coalesce(x["content"], F.lit(""))) != ""), 1, limit)
    return _record(_each(payloads, parsed, kept), "searxng", F.col("r.title"), F.col("r.content"), F.col("r.url"), F.col("r.doi"))


PARSERS = {"arxiv": parse_arxiv, "crossref": parse_crossref, "openalex": parse_openalex, "semanticscholar": parse_semanticscholar, "europepmc": parse_europepmc, "biorxiv": parse_biorxiv, "pubmed": parse_pubmed, "clinicaltrials": parse_clinicaltrials, "elsevier": parse_elsevier, "springer": parse_springer, "core": parse_core, "searxng": parse_searxng}


def allowed(url: Column, hosts: list[str]) -> Column:
    """https URLs of exactly these hosts."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))


def query_ok(query: Column) -> Column:
    """Non-empty, 200 characters at most, no control characters, no scheme."""
    return F.coalesce((F.trim(query) != "") & (F.length(query) <= 200) & ~query.rlike(r"[\x00-\x1f\x7f]") & ~F.contains(query, F.lit("://")), F.lit(False))
