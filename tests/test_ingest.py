"""The ingest stream knows what it has stored without reading it, also after a restart."""

from __future__ import annotations

import shutil

from stemma.streaming.ingest import ingest_stream

SCHEMA = "doc_id long, text string, source string"


def test_state_replaces_reading_the_store(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    put([(3, "a", "s"), (1, "a", "s"), (2, "b", "s"), (4, None, "s"), (5, None, "s")])
    ingest_stream(spark, src, out, ck).awaitTermination()
    stored = lambda: sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(out).select("doc_id", "text").collect())
    assert stored() == [(1, "a"), (2, "b"), (4, None)]
    shutil.move(out, out + "-away")  # a restarted stream needs nothing of it
    put([(0, "a", "s"), (9, "c", "s"), (8, "c", "s"), (7, None, "s")])
    ingest_stream(spark, src, out, ck).awaitTermination()
    assert stored() == [(8, "c")]
    ingest_stream(spark, src, out, ck).awaitTermination()
    assert stored() == [(8, "c")]
