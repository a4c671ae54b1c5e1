"""Scratch tables go when the process ends, stopped session or not."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
from pyspark.sql import SparkSession
from stemma.plans.checkpoints import cut
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
assert cut(spark.range(5)).count() == 5
{end}
"""


@pytest.mark.parametrize("end", ["spark.stop()", ""])
def test_nothing_is_left(tmp_path, end):
    folder = tmp_path / "shared"
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(folder=str(folder), end=end)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert [p for p in folder.rglob("cut-*")] == [] and [p for p in folder.rglob("*.parquet")] == []
