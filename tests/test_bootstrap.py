"""Jumping in the generator's stream, and the bootstrap in stretches against the serial one."""

from __future__ import annotations

import random
import time

import pytest

from stemma.operators import bootstrap, quality

from .conftest import DATA


@pytest.mark.parametrize("first", [0, 1, 623, 624, 19_937, 100_003])
def test_jumps_reach_the_serial_stream(first):
    rng = random.Random(7)
    for _ in range(first):
        rng.getrandbits(32)
    assert bootstrap.draws_from(7, first).random_raw(2000).tolist() == [rng.getrandbits(32) for _ in range(2000)]


def test_far_jumps_add_up():
    near = bootstrap.draws_from(7, 3_000_000_000)
    near.random_raw(1_000_000)
    assert near.random_raw(700).tolist() == bootstrap.draws_from(7, 3_001_000_000).random_raw(700).tolist()


@pytest.mark.parametrize("counts", [(20, 2, 2), (300, 40, 70), (0, 3, 1), (5, 0, 0), (500, 8, 4)])
def test_stretches_equal_the_serial_interval(spark, counts):
    assert bootstrap.spread_bootstrap(spark, *counts, stretch=150_001) == quality.bootstrap_f1(*counts)


def test_large_bootstraps_are_spread(spark, monkeypatch):
    df = spark.createDataFrame([(300, 40, 70), (20, 2, 2)], "tp long, fp long, fn long")
    want = sorted(map(tuple, quality.bootstrap_interval(df).collect()))
    monkeypatch.setattr(quality, "SERIAL_DRAWS", 100_000)
    assert sorted(map(tuple, quality.bootstrap_interval(df).collect())) == want


def test_a_run_of_stretches_takes_one_jump(spark):
    began = time.monotonic()
    assert bootstrap.spread_bootstrap(spark, 300, 40, 70, stretch=1_009) == quality.bootstrap_f1(300, 40, 70)  # a thousand stretches
    assert time.monotonic() - began < 120


def test_spurious_triples_resample_nothing(spark, monkeypatch):
    from stemma.plans import catalogue

    def refuse(counts):
        raise AssertionError("a list of triples needs no interval")

    monkeypatch.setattr(quality, "bootstrap_interval", refuse)
    assert catalogue.queries()["spurious_triples_top20"](spark, DATA).count() == 20
