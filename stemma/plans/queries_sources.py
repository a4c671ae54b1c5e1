"""Queries that take the documents through the parsers of literature payloads, article text and name registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import papers, reader, registry
from . import testbed as tb
from .catalogue import query
from .checkpoints import cut

#: Payloads of one document as each service writes them: Spark SQL over doc_id, title, doi, text; then the record's address.
_PAYLOADS = {
    "crossref": ("named_struct('message', named_struct('items', array(named_struct('DOI', doi, 'URL', concat('https://c.org/', doc_id), 'title', array(title), 'abstract', text))))", "'https://c.org/' || doc_id"),
    "semanticscholar": ("named_struct('data', array(named_struct('title', title, 'abstract', text, 'url', concat('https://s.org/', doc_id), 'externalIds', named_struct('DOI', doi))))", "'https://s.org/' || doc_id"),
    "europepmc": ("named_struct('resultList', named_struct('result', array(named_struct('id', cast(doc_id as string), 'source', 'MED', 'title', title, 'abstractText', text, 'doi', doi))))", "'https://doi.org/' || doi"),
    "biorxiv": ("named_struct('collection', array(named_struct('doi', doi, 'title', title, 'abstract', text)))", "'https://doi.org/' || doi"),
    "clinicaltrials": ("named_struct('studies', array(named_struct('protocolSection', named_struct('identificationModule', named_struct('nctId', concat('NCT', doc_id), 'briefTitle', title), 'descriptionModule', named_struct('briefSummary', text)))))", "'https://clinicaltrials.gov/study/NCT' || doc_id"),
    "elsevier": ("named_struct('search-results', named_struct('entry', array(named_struct('dc:title', title, 'dc:description', text, 'prism:doi', doi, 'prism:url', concat('https://e.org/', doc_id)))))", "'https://e.org/' || doc_id"),
    "springer": ("named_struct('records', array(named_struct('title', title, 'abstract', text, 'doi', doi, 'url', array(named_struct('value', concat('https://p.org/', doc_id))))))", "'https://p.org/' || doc_id"),
    "core": ("named_struct('results', array(named_struct('id', cast(doc_id as string), 'title', title, 'abstract', text, 'doi', doi)))", "'https://core.ac.uk/works/' || doc_id"),
    "searxng": ("named_struct('results', array(named_struct('url', concat('https://x.org/', doc_id), 'title', title, 'content', text, 'doi', doi)))", "'https://x.org/' || doc_id"),
}
_PLAIN = "trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _papers(s, d):
    rows = tb.table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return rows.withColumns({"title": F.concat(F.lit("Title <i>"), F.col("doc_id").cast("string"), F.lit("</i>")), "doi": F.concat(F.lit("10.1234/AB"), F.col("doc_id").cast("string"))})


def _register(source: str, payload: str, uri: str) -> None:
    keeps = "TRUE" if source not in ("searxng", "clinicaltrials") else "trim(text) <> ''"
    doi = "lower(doi)" if source != "clinicaltrials" else "CAST(NULL AS VARCHAR)"
    sql = (
        "WITH r AS (SELECT doc_id, text, 'Title ' || doc_id AS title, '10.1234/AB' || doc_id AS doi FROM documents WHERE text IS NOT NULL)"
        f" SELECT '{source}' AS source, title, md5(CASE WHEN {_PLAIN} = '' THEN title ELSE title || chr(10) || chr(10) || {_PLAIN} END) AS text_md5, {uri} AS source_uri, {doi} AS doi FROM r WHERE {keeps}"
    )

    @query(f"parse_{source}", sql)
    def _(s, d):
        found = papers.PARSERS[source](_papers(s, d).select(F.to_json(F.expr(payload)).alias("payload")))
        return found.select("source", "title", F.md5("text").alias("text_md5"), "source_uri", "doi")


for _source, (_payload, _uri) in _PAYLOADS.items():
    _register(_source, _payload, _uri)


#: Every document is one source's page: some sources aren't known, some pages weren't fetched, some are cut off.
_ORDER = [*_PAYLOADS, "unheard-of"]
_PAGES = f"p AS (SELECT doc_id AS page, ({_ORDER!r})[CAST(doc_id % {len(_ORDER)} AS INTEGER) + 1] AS source, doc_id % 17 = 0 AS unfetched, doc_id % 13 = 0 AS broken, text FROM documents WHERE text IS NOT NULL)".replace("(['", "['").replace("'])[", "'][")
_FAULT = "CASE WHEN source = 'unheard-of' THEN 'unsupported' WHEN unfetched THEN 'fetch_failed' WHEN broken THEN 'unreadable' END"


def _read(s, d):
    rows = _papers(s, d)
    source = F.element_at(F.array(*[F.lit(x) for x in _ORDER]), (F.col("doc_id") % len(_ORDER)).cast("int") + 1)
    payload = F.coalesce(*[F.when(source == name, F.to_json(F.expr(p))) for name, (p, _uri) in _PAYLOADS.items()], F.lit("{}"))
    whole = F.when(F.col("doc_id") % 13 == 0, F.substring(payload, 1, 40)).otherwise(payload)
    error = F.when(F.col("doc_id") % 17 == 0, "fetch_failed")
    stored = cut(rows.select(source.alias("source"), F.col("doc_id").alias("page"), whole.alias("payload"), error.alias("error")))  # pages are a table
    return reader.read_payloads(stored)


@query("source_failures", f"WITH {_PAGES} SELECT source, page, {_FAULT} AS failure FROM p WHERE {_FAULT} IS NOT NULL")
def _(s, d):
    return _read(s, d)[1]


@query("source_records", f"WITH {_PAGES} SELECT source, count(*) AS records, CAST(sum(page) AS BIGINT) AS pages FROM p WHERE {_FAULT} IS NULL AND (source NOT IN ('searxng', 'clinicaltrials') OR trim(text) <> '') GROUP BY source")
def _(s, d):
    return _read(s, d)[0].groupBy("source").agg(F.count("*").alias("records"), F.sum("page").alias("pages"))


_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0D\\x0E-\\x1F]"


@query(
    "jats_to_text",
    "WITH r AS (SELECT doc_id, regexp_replace(text, '" + _CONTROL + "', '', 'g') AS t FROM documents WHERE text IS NOT NULL),"
    " l AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace('Abstract of ' || doc_id || chr(10) || chr(10) || 'Heading' || chr(10) || t || chr(10) || 'A caption.', '[\\x{0085}\\x{2028}\\x{2029}]', chr(10), 'g'), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\\s\\x{00A0}\\x{3000}]+', ''), '[\\s\\x{00A0}\\x{3000}]+$', '')) AS lines FROM r)"
    " SELECT doc_id, md5(trim(regexp_replace(array_to_string(lines, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM l",
)
def _(s, d):
    docs = tb.table(s, d, "documents").where("text IS NOT NULL")
    plain = F.regexp_replace("text", _CONTROL, "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        plain = F.replace(plain, F.lit(mark), F.lit(name))
    xml = F.concat(
        F.lit("<article><body><sec><title>Heading<xref>9</xref></title><p>"),
        plain,
        F.lit("</p></sec><fig><label>1</label><caption><p>A caption.</p></caption></fig><fn-group><fn><p>no</p></fn></fn-group></body><front><journal>J</journal><abstract>Abstract of "),
        F.col("doc_id").cast("string"),
        F.lit("</abstract></front><back><ref-list><ref>no</ref></ref-list></back></article>"),
    )
    return docs.select("doc_id", F.md5(T.jats_to_text(xml)).alias("text_md5"))


@query(
    "pubchem_registry",
    "WITH c AS (SELECT p_partkey AS cid, p_name, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS head, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS mid FROM part),"
    " k AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: i * CAST(reverse(head || mid)[i] AS INTEGER))) % 10 AS d FROM c),"
    " n AS (SELECT *, head || '-' || mid || '-' || CAST(d AS INTEGER) AS cas FROM k WHERE cid % 5 <> 0)"
    " SELECT lower(p_name) || ' ' || cid AS surface, cas AS code FROM n UNION ALL SELECT cas, cas FROM n",
)
def _(s, d):
    """Parts as compounds: a name in two cases and a CAS number with its check digit; every fifth has a wrong one."""
    cid = F.col("p_partkey").cast("string")
    head, mid = F.lpad(cid, 7, "0"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    digits = F.reverse(F.concat(head, mid))
    check = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + i * F.substring(digits, i, F.lit(1)).cast("int")) % 10
    wrong = F.when(F.col("p_partkey") % 5 == 0, (check + 1) % 10).otherwise(check)
    names = F.array(F.concat("p_name", F.lit("  "), cid), F.upper(F.concat("p_name", F.lit(" "), cid)), F.concat(head, F.lit("-"), mid, F.lit("-"), wrong.cast("string")))
    return registry.import_pubchem(tb.table(s, d, "part").select(F.col("p_partkey").alias("cid"), F.explode(names).alias("surface")))
