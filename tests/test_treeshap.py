"""TreeSHAP against brute-force Shapley values of the path-dependent tree expectation."""

import itertools
import math

import numpy as np
import pandas as pd

from cohortlab.operators import treeshap


def _random_tree(rng, depth, n_feat):
    rows, counter = [], [0]

    def build(d, cover):
        i = counter[0]
        counter[0] += 1
        if d == depth or cover < 4:
            rows.append(dict(id=i, prediction=float(rng.normal()), rawCount=cover, leftChild=-1, rightChild=-1,
                             featureIndex=-1, threshold=0.0))
            return i
        rec = dict(id=i, prediction=0.0, rawCount=cover, featureIndex=int(rng.integers(0, n_feat)),
                   threshold=float(rng.normal()))
        rows.append(rec)
        lc = int(rng.integers(1, cover))
        rec["leftChild"] = build(d + 1, lc)
        rec["rightChild"] = build(d + 1, cover - lc)
        return i

    build(0, 200)
    return pd.DataFrame(rows)


def _cond_exp(t, x, S, node=0):
    if t.left[node] < 0:
        return t.value[node]
    f = t.feat[node]
    if f in S:
        nxt = t.left[node] if x[f] <= t.thr[node] else t.right[node]
        return _cond_exp(t, x, S, nxt)
    lc, rc = t.left[node], t.right[node]
    return (t.cover[lc] * _cond_exp(t, x, S, lc) + t.cover[rc] * _cond_exp(t, x, S, rc)) / t.cover[node]


def _brute(t, x, n_feat):
    phi = np.zeros(n_feat)
    feats = list(range(n_feat))
    for j in feats:
        others = [f for f in feats if f != j]
        for k in range(len(others) + 1):
            for S in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n_feat - k - 1) / math.factorial(n_feat)
                phi[j] += w * (_cond_exp(t, x, set(S) | {j}) - _cond_exp(t, x, set(S)))
    return phi


def test_treeshap_equals_brute_force():
    rng = np.random.default_rng(9)
    n_feat = 4
    X = rng.normal(size=(25, n_feat))
    for _ in range(3):
        t = treeshap._Tree(_random_tree(rng, 4, n_feat))
        phi = np.zeros_like(X)
        treeshap.tree_shap(t, X, phi, 1.0)
        for r in range(X.shape[0]):
            want = _brute(t, X[r], n_feat)
            assert np.allclose(phi[r], want, atol=1e-10)
            assert abs(phi[r].sum() + treeshap.expected_value(t) - _cond_exp(t, X[r], set(range(n_feat)))) < 1e-10


def test_tables_equal_the_recursion():
    """Deep trees with repeated columns: looked-up values are those of the recursion over the tree."""
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 6))
    for _ in range(4):
        t = treeshap._Tree(_random_tree(rng, 7, 6))
        a, b = np.zeros_like(X), np.zeros_like(X)
        treeshap.tree_shap(t, X, a, 0.5)
        treeshap._tree_shap_deep(t, X, b, 0.5)
        assert t.tables and np.allclose(a, b, atol=1e-12)
