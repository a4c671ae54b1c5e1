"""One read over the stored pages of several paper services: what could be read, and what failed, as rows.

A page is (source, page, payload, error): what a service answered, or the class of what went wrong
when it was asked. Every source is parsed from its own rows, so a filter on ``source`` reaches the
pages' files, and a page that can't be read costs its own rows alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .papers import PARSERS, parse_biorxiv

#: Records kept of one page, at most, and bytes of a payload that is read.
MOST_RECORDS, MOST_BYTES = 25, 5 << 20
XML = ("arxiv", "pubmed")


def page_faults(pages: DataFrame) -> DataFrame:
    """``pages`` with ``failure``: unsupported, the fetch's own class, too_large, unreadable; null where a page can be parsed."""
    payload = F.col("payload")
    json = F.expr("try_variant_get(try_parse_json(payload), '$') IS NOT NULL")
    root = F.regexp_extract(payload, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<![^>]*>|\s)*<([\w:.-]+)", 1)
    closed = (root != "") & F.rtrim(payload).endswith(F.concat(F.lit("</"), root, F.lit(">")))
    return pages.withColumn(
        "failure",
        F.when(~F.col("source").isin(list(PARSERS)) | F.col("source").isNull(), "unsupported")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.octet_length(payload) > MOST_BYTES, "too_large")
        .when(~F.coalesce(F.when(F.col("source").isin(list(XML)), closed).otherwise(json), F.lit(False)), "unreadable"),
    )


def read_payloads(pages: DataFrame, query: str | None = None, limit: int = MOST_RECORDS, today: str | None = None, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with their source and page, ``limit`` of a page at most and in its order; failures: source, page, failure).

    ``query`` and ``today`` are for services that can't search (see ``parse_biorxiv``); a service
    that has searched needs neither.
    """
    limit = max(1, min(limit, MOST_RECORDS))
    checked = page_faults(pages)
    good = checked.where("failure IS NULL")
    found = []
    for name in sources or list(PARSERS):
        rows = good.where(F.col("source") == name).select("page", "payload")
        if name == "searxng":
            found.append(PARSERS[name](rows, limit))
        else:
            found.append(parse_biorxiv(rows, query, today) if name == "biorxiv" else PARSERS[name](rows))
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    place = F.row_number().over(Window.partitionBy("source", "page").orderBy("pos"))  # a page's records
    kept = records.withColumn("n", place).where(F.col("n") <= limit).drop("n", "pos")
    return kept, checked.where("failure IS NOT NULL").select("source", "page", "failure")
