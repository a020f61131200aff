"""R's draws: published ones, and the samples of a model that uses them."""

import math
import random
import signal

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions.rsample import RSample
from glyphloom.operators import sct
from glyphloom.operators.ranks import average_ranks, numbered, quantiles


def test_published_draws():
    assert [p + 1 for p in RSample(42).places(10, 10)] == [1, 5, 10, 8, 2, 4, 6, 9, 7, 3]
    assert [p + 1 for p in RSample(123).places(10, 10)] == [3, 10, 2, 8, 6, 9, 1, 7, 5, 4]
    r = RSample(42)
    assert [round(r.uniform(), 7) for _ in range(3)] == [0.914806, 0.9370754, 0.2861395]


def test_draws_are_a_sample():
    got = RSample(7).places(10**12, 500)
    assert len(set(got)) == 500 and min(got) < 10**11 and max(got) > 9 * 10**11
    w = np.array([0.0, 5.0, 1.0, 1.0])
    first = [RSample(s).weighted(w, 2) for s in range(400)]
    assert all(len(set(x)) == 2 and 0 not in x for x in first) and 0.6 < np.mean([x[0] == 1 for x in first]) < 0.82
    for bad in (lambda: RSample(1).places(3, 4), lambda: RSample(1).weighted(w, 4)):
        with pytest.raises(ValueError):
            bad()


def test_numbers_ranks_and_quantiles(spark, monkeypatch):
    from glyphloom.operators import ranks

    r = np.random.default_rng(1)
    v = r.integers(0, 40, 3000) * 1.5
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double").repartition(5)
    assert all(x.ord == x.id for x in numbered(df, "id").collect())
    order = np.sort(v)
    got = {x.v: x.rank for x in average_ranks(df, "v").select("v", "rank").distinct().collect()}
    assert all(rank == (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2 for x, rank in got.items())
    monkeypatch.setattr(ranks, "SMALL", 50)
    smooth = spark.createDataFrame([(float(x),) for x in r.normal(size=4000)], "v double")
    values = np.array([x.v for x in smooth.collect()])
    assert np.allclose(quantiles(smooth, "v", [0.0, 0.01, 0.5, 0.9, 1.0]), np.quantile(values, [0, 0.01, 0.5, 0.9, 1]))
    assert np.allclose(quantiles(df, "v", [0.2, 0.5]), np.quantile(v, [0.2, 0.5])) and quantiles(df.where("v < 0"), "v", [0.5]) == [None]


def test_quantiles_between_two_ties(spark, monkeypatch):
    """The median lies between two values that half of the rows have each; nothing narrows them down."""
    from glyphloom.operators import ranks

    def late(*_):
        raise TimeoutError

    monkeypatch.setattr(ranks, "SMALL", 50)
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(2.0).alias("v"))
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(180)
    try:
        assert quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]) == [1.0, 1.0, 1.5, 2.0]
        r = np.random.default_rng(3)
        for v in (np.append(np.full(300, -1e300), np.full(300, 1e-300)), np.repeat([0.0, 1.0, np.inf], 100), np.round(r.normal(size=500), 1), r.pareto(0.1, 501)):
            rows = spark.createDataFrame([(float(x),) for x in v], "v double")
            shares = [0.0, 1 / 3, 0.5, 0.99]
            order, at = np.sort(v), [(len(v) - 1) * q for q in shares]
            want = [order[math.floor(a)] if order[math.floor(a)] == order[math.ceil(a)] else order[math.floor(a)] + (order[math.ceil(a)] - order[math.floor(a)]) * (a - math.floor(a)) for a in at]
            assert quantiles(rows, "v", shares) == want
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_ranks_of_values_that_differ_each_time(spark):
    """As sums do, whose parts arrive in another order."""
    noisy = F.udf(lambda x: x * (1 + 1e-15 * random.SystemRandom().randrange(9)), "double").asNondeterministic()
    df = spark.range(1, 41).repartition(3).select("id", noisy(F.col("id") / 7.0).alias("v"))
    assert {x.id: x.rank for x in average_ranks(df, "v").collect()} == {i: i for i in range(1, 41)}


def test_a_model_with_these_draws(spark):
    cells = spark.range(60).select(F.format_string("c%02d", "id").alias("cell"))
    assert sct.sampled_cells(cells.repartition(4), 5, 42, RSample(42)) == [f"c{p:02d}" for p in RSample(42).places(60, 5)]
    with pytest.raises(ValueError):
        sct.generator(sct.Settings(draws="dice"))
