"""What scratch tables leave on local disks."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stemma.llm.common import FREE_SHUFFLES, persist_table


def shuffle_files(spark) -> set[Path]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


@pytest.mark.parametrize("free", [False, True])
def test_freed_tables_leave_no_shuffle_files(spark, free):
    before, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES, None)
    kept = persist_table(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "scratch", free=free)
    assert free == (not shuffle_files(spark) - before)
    assert kept.count() == 10 and spark.conf.get(FREE_SHUFFLES, None) == setting
