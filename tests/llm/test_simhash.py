import numpy as np
import pytest
import xxhash

from cohortlab.llm import simhash as s
from cohortlab.llm.common import components


def brute_classes(fps, bits):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_by_definition():
    text = "One two  THREE\tfour É two three four"
    w = "one two three four É two three four".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert s.fingerprint(text) % 2**64 == want
    assert s.fingerprint("Ab c") % 2**64 == xxhash.xxh64_intdigest(b"ab c", 42)
    assert s.fingerprint(None) == s.fingerprint(" \n") == 0


@pytest.mark.parametrize("group", [20_000, 4])
def test_links_connect_what_brute_force_connects(spark, group):
    r = np.random.default_rng(5)
    fps = [int(x) for x in r.integers(0, 1 << 64, 60, dtype=np.uint64)]
    for base in fps[:12]:  # chains and a dense ball
        for _ in range(6):
            base ^= sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            fps.append(base)
    fps += [fps[20] ^ (1 << b) for b in range(40)] + [0, 7, 15]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(s.links(df, group=group)).collect()}
    want = brute_classes(fps, 3)
    mine = [got.get(f, f) for f in signed]
    for i in range(len(fps)):
        for j in range(i):
            assert (mine[i] == mine[j]) == (want[i] == want[j])


def test_components_of_a_long_path(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(e.limit(0)).count() == 0


def test_edges(edge, none):
    out = s.near_duplicates(edge).collect()
    assert len(out) == edge.count()
    by = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[7] == 7
    assert {r["component_id"] for r in out if r["fp"] == 0} == {3}
    kept = s.keep_first(edge, s.near_duplicates(edge))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge.columns
    assert sorted(i for i in ids if i) == [1, 3, 6, 7, 8] and ids.count(None) == 2
    assert s.near_duplicates(none).count() == 0


def test_more_bits_than_the_blocks_allow(spark):
    with pytest.raises(ValueError):
        s.links(spark.createDataFrame([(1,)], "fp long"), bits=4)
