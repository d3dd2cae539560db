"""Stage outputs: stale, broken and half-written ones, clustering, and stages that re-read what matches."""

import json
import os

import pytest

from cohortlab.plans import handoff

SF = "/root/testdata/sf0.001"


def _table(spark, n, k=0):
    return spark.range(n).selectExpr("CAST(id % 5 AS STRING) AS p", f"id + {k} AS v")


def test_same_inputs_are_read_and_others_made_anew(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def build(n):
        return lambda: made.append(n) or _table(spark, n)

    assert handoff.reuse(spark, path, "a", build(10)).count() == 10
    assert handoff.reuse(spark, path, "a", build(20)).count() == 10 and made == [10]
    first = handoff.version_of(spark, path)
    assert handoff.reuse(spark, path, "b", build(30)).count() == 30 and made == [10, 30]
    assert handoff.version_of(spark, path) != first
    assert [x for x in os.listdir(path) if x.startswith("v-")] == [handoff.version_of(spark, path)]   # the old version is gone


def test_fingerprint_follows_files_and_parameters(spark, tmp_path):
    src = str(tmp_path / "src")
    _table(spark, 10).write.parquet(src)
    df = spark.read.parquet(src)
    a = handoff.fingerprint(spark, df, limit=5)
    assert a == handoff.fingerprint(spark, spark.read.parquet(src), limit=5)
    assert a != handoff.fingerprint(spark, df, limit=6)
    _table(spark, 11).write.mode("overwrite").parquet(src)
    assert a != handoff.fingerprint(spark, spark.read.parquet(src), limit=5)


def test_half_written_output_is_never_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(handoff.MissingStage):
        handoff.read(spark, path)
    handoff.write(_table(spark, 10), path, "a")

    def die(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:      # the run ends after its files are written, before the manifest
        m.setattr(handoff, "_replace", die)
        with pytest.raises(KeyboardInterrupt):
            handoff.write(_table(spark, 99), path, "b")
    assert handoff.read(spark, path).count() == 10
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == 2
    handoff.write(_table(spark, 20), path, "c")     # the next write clears what the dead run left
    assert handoff.read(spark, path).count() == 20
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == 1


@pytest.mark.parametrize("harm", ["missing", "cut", "extra", "manifest"])
def test_broken_output_is_refused_and_made_anew(spark, tmp_path, harm):
    path = str(tmp_path / "t")
    handoff.write(_table(spark, 10).repartition(2), path, "a")
    folder = f"{path}/{handoff.version_of(spark, path)}"
    part = next(f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.startswith("part-"))
    if harm == "missing":
        os.remove(part)
    elif harm == "cut":
        os.truncate(part, 20)
    elif harm == "extra":
        open(f"{folder}/part-x.parquet", "w").close()
    else:
        json.dump({"name": 1}, open(f"{path}/{handoff.MANIFEST}", "w"))
    with pytest.raises(handoff.BrokenStage):
        handoff.read(spark, path)
    assert handoff.reuse(spark, path, "a", lambda: _table(spark, 7)).count() == 7
    assert handoff.read(spark, path).count() == 7


def test_clustered_files_prune(spark, tmp_path):
    """A filter on the leading column reads its files only: statistics leave out the others."""
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = handoff.write(spark.range(40_000).selectExpr("CAST(id % 8 AS STRING) AS p", "hash(id) AS v"), path, "a", ["p", "v"])
        assert len(df.inputFiles()) == 4
        one = df.filter("p = '3'")
        assert one.count() == 5000
        plan = one._jdf.queryExecution().executedPlan()
        rows = one.collect()
        scan = plan.collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
        assert len(rows) == 5000 and 5000 <= read <= 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_reread_what_matches(spark, tmp_path, monkeypatch):
    from cohortlab.plans import pipeline
    from cohortlab.plans.study import Study
    out = str(tmp_path / "out")
    pipeline.run_preprocessing(Study(spark, SF), out)
    versions = {x: handoff.version_of(spark, f"{out}/{x}") for x in ("processed/cohort_final", "interim/bic_labels")}
    first = pipeline.run_features(spark, out)
    with monkeypatch.context() as m:
        m.setattr(Study, "cohort", property(lambda self: pytest.fail("made again")))
        assert pipeline.run_preprocessing(Study(spark, SF), out).count() == 70
    assert pipeline.run_features(spark, out).inputFiles() == first.inputFiles()
    assert {x: handoff.version_of(spark, f"{out}/{x}") for x in versions} == versions
    # another parameter: a new cohort, and a new modeling table from it
    few = pipeline.run_preprocessing(Study(spark, SF, min_commits=1), out)
    assert few.count() > 70
    assert pipeline.run_features(spark, out).count() == few.count()


def test_impute_first_takes_logs_of_imputed_sizes(spark):
    from cohortlab.operators import features
    df = spark.createDataFrame([("a", None, 0.0, 1.0, 0.0), ("a", 4.0, 0.0, 1.0, 0.0)],
                               "PROJECT_ID string, NCLOC double, CHURN double, SQALE_INDEX double, REF_COUNT double")
    logs = lambda first: sorted(round(r.log_ncloc, 6) for r in features.imputed_cohort(df, first).collect())
    assert logs(True) == [1.609438, 1.609438] and logs(False) == [0.0, 1.609438]
