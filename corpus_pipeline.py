"""A training-text pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir); ``run`` writes every stage's rows as Parquet in the shared
folder and reads them again as the next stage's documents.

All stages but the last return the columns of ``documents`` (``COLUMNS``, which their input must
have); further columns are dropped, whatever their names. An empty table stays empty through all of
them. Rows that repeat a doc_id, and rows without one, are documents of their own in every stage but
near_dedup; a null lang, source or n_chars passes through. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import fold, persist_table, read_table
from stemma.llm.compression import fit_languages, predict_language
from stemma.llm.decontaminate import remove_contamination
from stemma.llm.near_copies import keep_one_similar
from stemma.llm.packing import pack_documents
from stemma.llm.secret_scan import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; lang becomes the prediction.

    Null and empty texts and texts without a letter are such documents, and so are all where no row
    to learn from has a lang. Of equal sizes the language that sorts first is taken, but a margin
    that narrow is rejected. Repeated texts are learned from once and judged alike.
    """
    models = fit_languages(docs.select("doc_id", "text", "lang"), fold(F.col("doc_id"), 3) != 1)
    found = predict_language(docs.select(*COLUMNS), models).where(~F.col("lang_rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles at a similarity of 0.8 or more) stays.

    Candidates are what SimHash's covering tables connect and what shares a min-hash band; each is
    verified. Equal texts are near copies, and so are rows that repeat a doc_id; rows without a doc_id all
    stay. Null texts are like empty ones, and of texts without words one stays. The row kept is the
    one with the smallest doc_id.
    """
    return keep_one_similar(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark text go.

    Null and empty texts have no words and stay as they are, as do all texts where the benchmark is
    empty; overlapping passages are cut once.
    """
    return remove_contamination(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts are cut out of the texts; no row goes, and null texts stay null."""
    return redact_secrets(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; workers that ran other stages keep a smaller cache.

    A null or empty text is one piece of its end token; longer documents than a sequence are cut;
    rows that repeat a doc_id are packed each for itself.
    """
    return pack_documents(docs, cache_pieces=150_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]

#: Learned dictionaries, fingerprints and tokenizers aren't SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
