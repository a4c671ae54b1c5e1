"""License notices that are wrapped over lines, as in source file headers."""

from __future__ import annotations

import pytest

from stemma.llm import license_scan

from ..conftest import comparable

NOTICES = {label: text for label, text in license_scan.TEMPLATES if len(text.split()) > 12}


def wrapped(text: str, width: int, lead: str) -> str:
    words = text.split()
    return "\n".join(lead + " ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize("lead", ["", "# "])
def test_wrapped_notices(spark, lead):
    labels = sorted(NOTICES)
    rows = [(k, "head\n" + wrapped(NOTICES[label], 7, lead) + "\n" + "some other words " * 90) for k, label in enumerate(labels)]
    rows.append((100, "released by us\nlicensed under terms of the apache license version 2 0\nand more"))
    rows.append((101, "released\n" + "x " * 20 + "\nunder\n" + "x " * 20 + "\nthe license"))
    got = {r["doc_id"]: r for r in license_scan.op10_license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in enumerate(labels):
        assert label in got[k]["labels"].split(",") and got[k]["score"] >= 0.8
    assert "mit" not in got[100]["labels"] and got[101]["labels"] == ""


def test_rows_that_share_a_doc_id_or_have_none(spark):
    notice = NOTICES["mit"]
    rows = [(2, "plain words only here"), (2, notice), (None, notice), (None, None), (3, "Licensed under CC BY 4.0."), (4, "Licensed under CC BY-NC 4.0.")]
    got = license_scan.op10_license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    said = sorted((str(r["doc_id"]), r["n_words"], r["labels"], r["score"]) for r in got)
    n = len(notice.split())
    assert said == [("2", 4, "", 0.0), ("2", n, "mit", 1.0), ("3", 6, "cc-by", 1.0), ("4", 7, "cc-by,cc-by-nc", 1.0), ("None", 0, "", 0.0), ("None", n, "mit", 1.0)]


def test_sql_sees_wrapped_notices(spark):
    duck = pytest.importorskip("duckdb").connect()
    rows = [(k, "head\n" + wrapped(NOTICES[label], 5 + k, "# ") + "\n" + "some other words " * 70) for k, label in enumerate(sorted(NOTICES))]
    rows.append((90, "released\nunder the license\n" + "word " * 300))
    frame = spark.createDataFrame(rows, "doc_id long, text string").toPandas()  # noqa: F841
    duck.sql("CREATE TABLE documents AS SELECT * FROM frame")
    got = license_scan.op10_license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    want = duck.sql(license_scan.op10_sql())
    assert comparable(got.collect(), got.columns) == comparable(want.fetchall(), want.columns)


def test_every_block_at_the_threshold_is_reported(spark):
    """The LGPL notice without "lesser" is 20 of 21 words of the template: reached, though its label is gpl."""
    notice = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    rows = [(1, notice), (2, notice.replace("GNU", "GNU Lesser")), (3, "nothing here"), (4, notice.replace(" you ", "\nyou "))]
    got = {r["doc_id"]: (r["labels"], r["reached"]) for r in license_scan.op10_license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "lgpl" not in got[1][0] and "lgpl" in got[1][1].split(",")
    assert "lgpl" in got[2][0].split(",") and "lgpl" in got[2][1].split(",")
    assert got[3] == ("", "") and "lgpl" in got[4][1].split(",")
