import hashlib
import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import ntt, periodic_runs as p, queries

SF = "/root/testdata/sf0.001"
SPACES = b" \t\n\x0b\x0c\r"


def brute(w, min_words=6, copies=4):
    """All runs by the definition: every maximal stretch of every period, without those of a smaller one."""
    n, out = len(w), []
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_words, copies * q):
                x = w[i:j + q]
                if not any(all(x[k] == x[k + r] for k in range(len(x) - r)) for r in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def runs_of(texts, *args):
    _, codes, at = p.numbered(texts)
    rows = p.find_runs(codes, at, *args)
    return [[tuple(r[1:]) for r in rows.tolist() if r[0] == i] for i in range(len(texts))]


def test_convolution_is_exact():
    r = np.random.default_rng(1)
    for prime, generator, power in ntt.PRIMES:
        assert pow(generator, (prime - 1) // 2, prime) == prime - 1 and (prime - 1) % (1 << power) == 0
        for n in (2, 8, 32):
            x, y = (r.integers(0, prime, (n, 3), dtype=np.uint64) for _ in range(2))
            got = ntt.convolve(x, y, prime, generator)
            for c in range(3):
                want = [sum(int(x[i, c]) * int(y[(k - i) % n, c]) for i in range(n)) % prime for k in range(n)]
                assert got[:, c].tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40) | st.text(alphabet="abc", min_size=1, max_size=9).flatmap(
    lambda t: st.integers(3, 9).map(lambda k: "cab" + t * k + "b")), max_size=5))
def test_runs_equal_brute_force(texts):
    texts = [" ".join(t).encode() for t in texts]
    assert runs_of(texts) == [brute(t.split()) for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 60).flatmap(lambda q: st.tuples(st.just(q), st.integers(3 * q, 6 * q))), max_size=6), st.integers(0, 99))
def test_long_periods_equal_brute_force(parts, seed):
    """Stretches of many periods side by side, over few and over many words, one word changed."""
    r = np.random.default_rng(seed)
    w = []
    for q, n in parts:
        turn = r.integers(0, 3 if seed % 2 else 900, q)
        w += [turn[i % q] for i in range(n)]
    if w:
        w[int(r.integers(len(w)))] = 5
    text = " ".join(map(str, w)).encode()
    for copies in (3, 4):
        assert runs_of([text, b"", text], 6, copies) == [brute(text.split(), 6, copies), [], brute(text.split(), 6, copies)]


def test_two_primes_where_one_does_not_prove_it():
    """Squared differences that add up to a multiple of the first prime are no match."""
    prime = ntt.PRIMES[0][0]
    a = next(x for x in range(1, 1 << 16) if math.isqrt(prime - x * x) ** 2 == prime - x * x)
    b = math.isqrt(prime - a * a)
    codes = np.array([1, 1, 1, 1, 1 + a, 1 + b, 1, 1], np.int64)
    k, lag = p._again(codes, 4, np.array([0]), np.array([8]), int(codes.max()))
    assert len(k) == 0


def test_one_word_only_and_nested_runs():
    text = b"x " * 3000
    assert runs_of([text]) == [[(0, 3000, 1)]]
    nested = b" ".join([b"a a a a a a b"] * 5)
    assert runs_of([nested]) == [brute(nested.split())] and (0, 35, 7) in runs_of([nested])[0]


def test_edges(spark, edge, none):
    out = p.periodic_runs(edge).collect()
    assert len(out) == edge.count()
    assert all(r["collapsed"] == " ".join((r["text"] or "").encode().split() and [x.decode() for x in (r["text"] or "").encode().split()])
               for r in out if r["doc_id"] != 6)
    assert p.periodic_runs(none).count() == 0
    named = edge.selectExpr("doc_id", "text AS collapsed", "t AS runs")
    again = p.periodic_runs(named, "collapsed")
    assert again.columns == ["doc_id", "runs", "collapsed"] and again.count() == edge.count()


def test_cycle_words(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(" a b\tc d e f ", 1, 2), ("a b", 0, 1), ("a b c", 2, 1)], "t string, a int, p int")
    got = [r[0] for r in df.select(p.cycle_words(F.col("t"), F.col("a"), F.col("p"))).collect()]
    assert got == ["a b c b c b", "a a", "a b c"]


def test_registered_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for r in docs:
        w = (r["text"] or "").encode().split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % q] for i, x in enumerate(w)]
        if n > 1500:
            continue  # the brute force below is quadratic; longer texts are covered above
        runs = brute(w)
        planted += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *(best if best else (None,) * 3), best and 1000 * best[1] // best[2],
                hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
                hashlib.sha256(collapsed(w, runs)).hexdigest())
        assert tuple(got[r["doc_id"]])[1:] == want
    assert planted >= 5
