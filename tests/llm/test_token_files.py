import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import mixing_coder as m
from cohortlab.llm import token_files as f
from cohortlab.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(0, 80), st.integers(1, 65536), st.integers(0, 10**6))
def test_coder_round_trip(lanes, n, top, seed):
    x = np.random.default_rng(seed).integers(0, top, (lanes, n))
    assert (m.decode(m.encode(x), n) == x).all()


def test_coder_learns():
    r = np.random.default_rng(2)
    words = [r.integers(0, 50_000, 4) for _ in range(30)]
    x = np.concatenate([words[i] for i in r.integers(0, 30, 1024)]).reshape(1, -1)
    assert 8 * len(m.encode(x)[0]) / x.size < 6  # 16 bits unmodelled
    same = np.full((2, 4096), 65535)
    assert all(len(z) < 300 for z in m.encode(same))
    # blocks don't depend on their neighbours
    y = r.integers(0, 300, (3, 500))
    assert m.encode(y) == [m.encode(row[None])[0] for row in y]


def expect(rows):
    lib, at, out = Encoder(PATH, True).lib, 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(f.read_tokens(f.write_tokens(df, PATH), with_ids=True).collect(), key=lambda r: r["start"])
    want = expect(rows)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)


def test_edges(edge, none, monkeypatch):
    check(edge)
    monkeypatch.setattr(f, "LANES", 3)
    monkeypatch.setattr(f, "BLOCK", 64)
    check(edge.filter("doc_id is null or doc_id <> 6"))
    assert f.read_tokens(f.write_tokens(none, PATH)).count() == 0


def test_damage_is_an_error(spark, edge):
    man = f.write_tokens(edge.filter("doc_id = 1"), PATH)
    path = man.first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    for at in (20, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 1
        with open(path, "wb") as out:
            out.write(bad)
        with pytest.raises(Exception, match="damaged"):
            f.read_tokens(man).collect()


def test_ids_that_the_coder_cannot_hold_raise_at_writing():
    import numpy as np
    import pytest

    from cohortlab.llm import mixing_coder
    with pytest.raises(ValueError):
        mixing_coder.encode(np.array([[70000, 5]], np.uint32))
    assert mixing_coder.decode(mixing_coder.encode(np.array([[65535, 5, 65535]], np.uint32)), 3).tolist() == [[65535, 5, 65535]]
