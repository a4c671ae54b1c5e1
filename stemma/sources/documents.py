"""Documents: reading, deduplicating, chunking, and rule-made extraction."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, mentions

CHUNK_CHARS, OVERLAP_CHARS = 12_000, 600
_BLANK = re.compile(" ")
FULLTEXT_LEAST, FULLTEXT_MOST = 500, 250_000


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files: title is the file's stem, uri its path."""
    raw = spark.read.text(path, wholetext=True)
    uri = F.col("_metadata.file_path")
    return raw.select(F.lit("upload").alias("source_kind"), uri.alias("source_uri"), F.regexp_extract(uri, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), F.col("value").alias("text"))


WEB_BYTES = 5 << 20


def _outcomes(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """url, page (title, text) and failure of (url, html); only pages that may be read are parsed."""
    from ..functions.text import html_to_text
    from .papers import allowed

    fault = F.when(~allowed(F.col("url"), hosts), "refused").when(F.col("html").isNull(), "not_fetched").when(F.octet_length("html") > WEB_BYTES, "too_large")
    read = pages.select("url", fault.alias("fault"), html_to_text(F.when(fault.isNull(), F.col("html"))).alias("page"))
    return read.select("url", "page", F.coalesce("fault", F.when(F.col("page.text") == "", "no_text")).alias("failure"))


def read_pages(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """Web documents of (url, html): https pages of the allowed hosts, 5 MiB at most, with text in them."""
    good = _outcomes(pages, hosts).where("failure IS NULL")
    return good.select(F.lit("web").alias("source_kind"), F.col("url").alias("source_uri"), F.coalesce("page.title", "url").alias("title"), "page.text")


def page_failures(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """url and failure of the pages that ``read_pages`` leaves out: refused, not_fetched, too_large, no_text."""
    return _outcomes(pages, hosts).where("failure IS NOT NULL").select("url", "failure")


def first_by_hash(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """content_hash and the first ``order`` that carries it, with how many share it. No text moves."""
    return docs.select(content_hash(F.col(text)).alias("content_hash"), order).groupBy("content_hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def insert_documents(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New documents whose content isn't stored yet; of equal ones the first."""
    hashed = new.withColumn("content_hash", content_hash(F.col("text")))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["content_hash", order], "left_semi").join(existing.select("content_hash"), "content_hash", "left_anti")


def collapse_duplicates(docs: DataFrame, source_order: list[str]) -> DataFrame:
    """One record an identity (DOI, else URI): longest text, then source order, then arrival."""
    rank = F.array_position(F.array(*[F.lit(s) for s in source_order]), F.col("source"))
    rank = F.when(rank == 0, len(source_order) + 1).otherwise(rank)
    key = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("uri:"), "source_uri"))
    best = F.min_by(F.struct(*docs.columns), F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("l"), rank.alias("r"), F.col("arrival"))).alias("b")
    return docs.withColumn("identity", key).groupBy("identity").agg(best, F.count("*").alias("records")).select("identity", "records", "b.*")


def enrich_fulltext(docs: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Abstracts replaced by bodies of 500 characters or more (250,000 at most); counts of what happened."""
    n = F.length("body")
    joined = docs.join(bodies, "doc_id", "left")
    fits = F.col("body").isNotNull() & (n >= FULLTEXT_LEAST)
    stats = joined.agg(F.count_if(F.col("body").isNotNull()).alias("eligible"), F.count_if(fits).alias("fetched"), F.count_if(n < FULLTEXT_LEAST).alias("too_short"), F.count_if(F.col("body").isNull()).alias("failed"))
    return joined.withColumn("text", F.when(fits, F.substring("body", 1, FULLTEXT_MOST)).otherwise(F.col("text"))).drop("body"), stats


def fan_out(batches: dict[str, DataFrame | Exception]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Rows of the sources that answered, and the others' failures by class."""
    rows, failed = None, []
    for name, got in batches.items():
        if isinstance(got, Exception):
            kind = {PermissionError: "rejected", NotImplementedError: "unsupported", OverflowError: "too_large", KeyError: "unconfigured", ValueError: "no_json"}.get(type(got), "fetch_failed")
            failed.append((name, kind))
        else:
            tagged = got.withColumn("source", F.lit(name))
            rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    return rows, failed


def chunk_bounds(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """Chunks of about ``size`` characters that share about ``overlap``, cut at blanks where there are any.

    An end is the last blank of the chunk's second half; the next start follows the first blank of
    the shared stretch.
    """
    blanks = [m.start() for m in _BLANK.finditer(text)]
    bounds = [(0, _chunk_end(blanks, 0, size, len(text)))]
    while bounds[-1][1] < len(text):
        last, end = bounds[-1]
        k = bisect_left(blanks, max(end - overlap, 0))
        start = blanks[k] + 1 if k < len(blanks) and blanks[k] < end else max(end - overlap, 0)
        start = max(start, last + 1)
        bounds.append((start, _chunk_end(blanks, start, size, len(text))))
    return bounds


def _chunk_end(blanks: list[int], start: int, size: int, n: int) -> int:
    reach = start + size
    if reach >= n:
        return n
    k = bisect_left(blanks, reach)
    return blanks[k - 1] if k and blanks[k - 1] >= max(start + size // 2, start + 1) else reach


def chunk_documents(docs: DataFrame, key: str = "doc_id", size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """key, chunk, char_offset, text. Documents of one chunk never leave the JVM."""
    long = F.length("text") > size
    short = docs.where(~long).select(key, F.lit(0).alias("chunk"), F.lit(0).alias("char_offset"), "text")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bounds = chunk_bounds(text, size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(bounds), batch.schema.field(0).type), pa.array(range(len(bounds)), pa.int32()), pa.array([a for a, _ in bounds], pa.int32()), pa.array([text[a:b] for a, b in bounds], pa.string())], names=[key, "chunk", "char_offset", "text"])

    return short.unionByName(docs.where(long).select(key, "text").mapInArrow(run, f"{key} {kind}, chunk int, char_offset int, text string"))


def mock_entities(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos (1 for the first), name: each distinct CamelCase token once, in order of appearance."""
    return docs.select(key, F.posexplode(F.array_distinct(mentions(F.col("text")))).alias("pos", "name")).withColumn("pos", F.col("pos") + 1)


def mock_relations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, src, dst: consecutive distinct tokens."""
    m = F.array_distinct(mentions(F.col("text")))
    return docs.select(key, m.alias("m")).where("size(m) > 1").select(key, F.posexplode(F.arrays_zip(F.expr("slice(m, 1, size(m) - 1)").alias("src"), F.expr("slice(m, 2, size(m) - 1)").alias("dst"))).alias("pos", "p")).select(key, (F.col("pos") + 1).alias("pos"), "p.src", "p.dst")


def unprocessed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    return docs.join(nodes.select(F.col("source_doc").alias("doc_id")), "doc_id", "left_anti")
