"""Every stage on its own input against a plain version (sf0.001 and edge rows)."""

import os
import re

import pytest

import corpus_pipeline as cp
from cohortlab.llm import decontamination, packing, personal_data, simhash
from cohortlab.llm.common import stage, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, fn in cp.STAGES:
        out.append(stage(fn(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "personal_data",
                                         "best_fit_packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_keeps_clean_documents(spark, steps):
    kept, labels = rows(steps[1]), {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0 and i in rows(steps[0])]
    bad = [i for i, r in labels.items() if r["quality"] == 0]
    assert sum(i in kept for i in good) > 0.93 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_one_document_of_each_group_stays(steps):
    before = rows(steps[1])
    fps = {i: simhash.fingerprint(r["text"]) % 2**64 for i, r in before.items()}
    left, want = sorted(before), []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            i = todo.pop()
            near = [j for j in left if j not in group and (fps[i] ^ fps[j]).bit_count() <= 3]
            group |= set(near)
            todo += near
        want.append(min(group))
        left = [j for j in left if j not in group]
    assert sorted(rows(steps[2])) == want


def test_contaminated_documents_go(spark, steps):
    grams = set()
    for r in table(spark, SF, "benchmark").collect():
        w = decontamination.words(r["text"])
        grams |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    sizes = {len(g) for g in grams}
    clean = []
    for i, r in rows(steps[2]).items():
        w = decontamination.words(r["text"])
        if not any(tuple(w[p:p + n]) in grams for n in sizes for p in range(len(w) - n + 1)):
            clean.append(i)
    assert sorted(rows(steps[3])) == sorted(clean)


def test_personal_data_is_masked(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not personal_data.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not personal_data.windows(before[i]["text"]):
            assert r["text"] == before[i]["text"]
        assert re.sub(r"\[[A-Z]+\]", "", r["text"]) in before[i]["text"] or "[" in r["text"]


def test_all_that_is_left_is_packed(steps):
    out = steps[5].collect()
    assert {r["doc_id"] for r in out} == set(rows(steps[4]))
    total = sum(r["length"] for r in out)
    assert len({r["sequence_id"] for r in out}) <= -(-total // packing.CAPACITY) + 1


def test_edge_rows_pass_through_all_stages(spark, edge, none):
    for docs in (edge, none):
        for _, fn in cp.STAGES[:-1]:
            docs = stage(fn(spark, docs, SF), "test-edge")
            assert docs.columns == edge.columns
        cp.STAGES[-1][1](spark, docs, SF).count()


def test_planted_secrets_are_masked(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables with planted secrets
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    out = [table(spark, sf, "documents")]
    for name, fn in cp.STAGES[:4]:
        out.append(stage(fn(spark, out[-1], sf), f"test-secrets-{name}"))
    before, after = rows(out[3]), rows(out[4])
    planted = re.compile(r'token = "([0-9a-f]{40})"', re.I)
    secrets = [(i, m[1]) for i, r in before.items() for m in planted.finditer(r["text"])]
    assert secrets
    for i, s in secrets:
        assert s not in after[i]["text"] and "[SECRET]" in after[i]["text"]


GOOD = "The quick brown fox jumps over the lazy dog near the river bank, and then it sleeps."
OTHER = "Several entirely different words make up this second text, which nobody else has written before today."
BAD = "too short"


def test_rows_that_share_an_id_or_have_none_are_judged_each(spark):
    rows = [(7, GOOD), (7, BAD), (None, OTHER), (None, BAD), (None, BAD), (9, GOOD + " again"), (9, GOOD + " again")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.quality_stage(spark, docs, SF)
    assert sorted(((r.doc_id or -1), r.text) for r in kept.collect()) == sorted(
        [(7, GOOD), (-1, OTHER), (9, GOOD + " again"), (9, GOOD + " again")])


def test_no_text_is_lost_with_its_id(spark):
    a, b = GOOD, OTHER
    rows = [(3, a), (5, a), (5, b), (6, b), (8, b), (8, b), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicate_stage(spark, docs.repartition(3), SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or -1), r.text) for r in kept.collect()) == sorted([(3, a), (5, b), (-1, a), (-1, a)])


def test_equal_rows_of_one_id_are_one(spark):
    docs = spark.createDataFrame([(4, GOOD, "en", "a", 1)] * 3 + [(4, None, "en", "a", 1)] * 2 + [(4, OTHER, "en", "a", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicate_stage(spark, docs.repartition(2), SF)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(["", GOOD, OTHER])
