import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlab.llm import hard_negatives as h, queries
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.01"


def brute(rows, anchor, k=5, low=80, high=100, wide=5):
    """rows: (id, label, integer vector)."""
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for i, label, x in rows:
        if not anchor(i):
            continue
        s = sorted((-dot(x, y), j, m) for j, m, y in rows if j != i)
        for p, j, _ in [r for r in s if r[2] == label][:wide]:
            near = [r for r in s if r[2] != label and -low * p <= -100 * r[0] <= -high * p][:k]
            out += [(i, j, rank, n, -p, -q) for rank, (q, n, _) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, anchor, **kw):
    df = spark.createDataFrame(rows, "id long, label string, code array<long>")
    return sorted(tuple(r) for r in h.hard_negatives(df, anchor, **kw).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 30), st.integers(0, 999))
def test_scores_equal_products(dims, bits, seed):
    r = np.random.default_rng(seed)
    a, c = (r.integers(-2 ** (bits - 1), 2 ** (bits - 1), (n, dims)) for n in (7, 11))
    got = h.scores(h.subset_sums(a, np.int64), h.pack(c, bits))
    assert (got == c @ a.T).all()


def data(n, seed, labels=4, dims=9, top=40):
    r = np.random.default_rng(seed)
    centre = r.integers(-top, top, (labels, dims))
    lab = r.integers(0, labels, n)
    v = centre[lab % 2] + r.integers(-9, 9, (n, dims))
    v[r.integers(0, n, n // 5)] = v[0]  # one very common vector: ties
    return [(int(i), str(int(x)), [int(y) for y in z]) for i, x, z in zip(r.permutation(n), lab, v)]


@pytest.mark.parametrize("tile,table", [(1024, 1 << 24), (16, 256 * 2 * 4 * 7)])
def test_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch, tile, table):
    monkeypatch.setattr(h, "TILE", tile)
    monkeypatch.setattr(h, "STRIP", tile // 4)
    monkeypatch.setattr(h, "TABLE_BYTES", table)
    rows = data(300, 3)
    want = brute(rows, lambda i: i % 9 == 0)
    assert len(want) > 300
    assert mined(spark, rows, F.col("id") % 9 == 0) == want


def test_wide_band_and_large_components(spark):
    rows = [(i, lab, [x * 100_003 for x in v]) for i, lab, v in data(120, 5)]
    assert mined(spark, rows, F.col("id") % 9 == 0, low=0, high=1000, negatives=50) == brute(rows, lambda i: i % 9 == 0, 50, 0, 1000)
    with pytest.raises(ValueError):
        mined(spark, [(0, "a", [2 ** 40] * 9)], F.lit(True))


def test_negative_and_zero_positives(spark):
    rows = [(0, "a", [1, 0]), (1, "a", [0, 5]), (2, "a", [-3, 1]), (3, "b", [0, 7]), (4, "b", [-1, 0]), (5, "b", [-3, 0])]
    assert mined(spark, rows, F.col("id") == 0) == brute(rows, lambda i: i == 0) == [(0, 1, 1, 3, 0, 0)]


def test_rows_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    df = spark.createDataFrame(
        [(0, [0.5, -0.001], 1, "x"), (0, [0.5, -0.001], 1, "x"), (1, [0.5, nan], 1, "x"), (2, [inf, 0.0], 1, "x"), (3, None, 1, "x"),
         (4, [0.5, None], 1, "x"), (5, [0.5], None, "x"), (None, [0.5], 1, "x"), (6, [0.25], 1, "x"), (7, [], 2, "x"), (8, [9.0], 3, "x"), (8, [8.0], 2, "x")],
        "vec_id long, v array<float>, lab int, label string")
    got = h.integer_vectors(df, F.col("vec_id"), F.col("v"), F.col("lab"))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [(0, "1", [128, -1]), (6, "1", [64]), (7, "2", []), (8, "2", [2048])]
    assert sorted(tuple(r) for r in h.hard_negatives(got, F.col("id") >= 0).collect()) == brute(rows, lambda i: True) != []
    assert h.hard_negatives(got.limit(0), F.lit(True)).count() == 0
    assert h.hard_negatives(got, F.lit(False)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_query_equals_sql(spark):
    ok, msg = compare(queries.QUERIES["op12_hard_negatives"](spark, SF), duck(SF), queries.ORACLES["op12_hard_negatives"])
    assert ok, msg
    assert int(msg.split()[0]) > 20
