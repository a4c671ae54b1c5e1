"""Resumable ingest: a file stream that keeps, for each content hash, whether it has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen(_key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row with the smallest doc_id of a content that hasn't come before."""
    best = None
    for pdf in pdfs:
        for i in pdf.index if not state.exists else ():
            if best is None or pdf["doc_id"].fillna(-1)[i] < best["doc_id"].fillna(-1).iloc[0]:
                best = pdf.loc[[i]]
    if best is not None:
        state.update((True,))
        yield best


def new_contents(rows: DataFrame) -> DataFrame:
    """Rows of a stream with their content_hash, each content once for the life of the checkpoint.

    What a batch costs depends on its own rows: state is keyed by hash, so nothing stored is read.
    """
    hashed = rows.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.groupBy("content_hash").applyInPandasWithState(first_seen, hashed.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string, source string"):
    """Start a stream from Parquet files in ``source``; every content is stored once, across restarts.

    A batch is written under its own number, so a replayed batch replaces itself. One checkpoint
    belongs to one target: it knows what the target has. State lives in RocksDB unless the session
    names another provider. Runs until all present files are taken.
    """
    from ..plans.shipping import ship

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    ship(spark)
    rows = spark.readStream.schema(schema).parquet(source)
    own = spark._jsparkSession.sessionState().conf().contains(_PROVIDER)
    if not own:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    try:  # the provider is fixed when a stream starts
        return new_contents(rows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if not own:
            spark.conf.unset(_PROVIDER)


def windowed_costs(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Calls and total value of each event type in tumbling windows; works on streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))
