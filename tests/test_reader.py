"""Pages of several services in one read: a broken one costs itself, caps and the window hold."""

from __future__ import annotations

import json

from stemma.sources import papers, reader

SCHEMA = "source string, page int, payload string, error string"


def test_one_broken_source_costs_itself(spark):
    crossref = json.dumps({"message": {"items": [{"DOI": f"10.1/{i}", "title": [f"T{i}"], "abstract": "a"} for i in range(40)]}})
    feed = '<?xml version="1.0"?><feed xmlns="x"><entry><id>http://a/1</id><title>T</title><summary>S</summary></entry></feed>'
    rows = [("crossref", 1, crossref, None), ("crossref", 2, crossref[:50], None), ("arxiv", 1, feed, None), ("arxiv", 2, feed[:-4], None), ("core", 1, None, "rate_limited"), ("core", 2, None, None), ("nowhere", 1, "{}", None), (None, 1, "{}", None), ("core", 3, '"' + "x" * (5 << 20) + '"', None)]
    records, failures = reader.read_payloads(spark.createDataFrame(rows, SCHEMA))
    got = records.collect()
    assert [r["title"] for r in got if r["source"] == "crossref"] == [f"T{i}" for i in range(25)] and [(r["page"], r["title"]) for r in got if r["source"] == "arxiv"] == [(1, "T")]
    assert {(r["source"], r["page"]): r["failure"] for r in failures.collect()} == {("crossref", 2): "unreadable", ("arxiv", 2): "unreadable", ("core", 1): "rate_limited", ("core", 2): "unreadable", ("nowhere", 1): "unsupported", (None, 1): "unsupported", ("core", 3): "too_large"}


def test_window_and_terms(spark):
    item = lambda i, day, text: {"doi": f"10.1101/{i}", "title": f"P{i}", "abstract": text, "date": day}
    page = json.dumps({"collection": [item(1, "2026-03-31", "gene"), item(2, "2026-03-03", "Gene editing"), item(3, "2026-03-02", "gene"), item(4, None, "gene"), item(5, "2026-03-20", "other"), item(6, "2026-04-01", "gene")]})
    df = spark.createDataFrame([("biorxiv", 1, page, None)], SCHEMA)
    read = lambda **o: [r["title"] for r in reader.read_payloads(df, today="2026-03-31", **o)[0].collect()]
    assert read(query="gene of") == ["P1", "P2", "P4"] and read(query="gene", limit=2) == ["P1", "P2"] and read(query="a b") == []
    assert read() == ["P1", "P2", "P4", "P5"]


def test_europepmc_links(spark):
    urls = [{"documentStyle": "html", "availability": "Open access", "url": "h"}, {"documentStyle": "PDF", "availability": "Subscription", "url": "s"}, {"documentStyle": "pdf", "availability": "Open access", "url": "p"}]
    rows = [{"id": "1", "source": "MED", "title": "A", "doi": "10.1/X", "pmcid": "PMC12", "inEPMC": "Y", "fullTextUrlList": {"fullTextUrl": urls}}, {"id": "2", "source": "MED", "title": "B", "pmcid": "PMC13", "inEPMC": "N"}]
    df = spark.createDataFrame([(json.dumps({"resultList": {"result": rows}}),)], "payload string")
    a, b = papers.europepmc_links(df).orderBy("id").collect()
    assert a["pdf_url"] == "p" and a["fulltext_url"].endswith("PMC12/fullTextXML") and (b["pdf_url"], b["fulltext_url"]) == (None, None)
    assert [r["source_uri"] for r in papers.parse_europepmc(df).orderBy("title").collect()] == ["https://doi.org/10.1/X", "https://europepmc.org/abstract/MED/2"]
