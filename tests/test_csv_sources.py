"""All seven study inputs through export-style CSV and back."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlab.sources import csv as csv_src
from cohortlab.sources import fixtures

SF = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(None if v is None else (round(v, 9) if isinstance(v, float) else v) for v in r)
                   for r in df.select(*cols).collect()), key=repr)


def test_all_inputs_roundtrip(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    raw = fixtures.raw_tables(spark, SF)
    paths = {}
    for name, df in raw.items():
        p = str(tmp_path / name)
        fixtures.csv_roundtrip(df, p)
        paths[name] = p
    back = csv_src.read_study_csvs(spark, paths)
    for name in csv_src.SCHEMAS:
        want = raw[name].select(*[F.col(c).cast(t).alias(c) for c, t in csv_src.SCHEMAS[name].items()])
        assert _rows(back[name]) == _rows(want), name
    proj = back["projects"]
    assert set(raw["projects"].columns) <= set(proj.columns) and proj.count() == raw["projects"].count()


def _csv(tmp_path, text):
    p = tmp_path / "x.csv"
    p.write_text(text)
    return str(p)


def test_quoted_newline_is_one_row(spark, tmp_path):
    p = _csv(tmp_path, 'PROJECT_ID,MESSAGE,COMMIT_HASH,AUTHOR_DATE,IN_MAIN_BRANCH,MERGE\n'
                       'a,"line one\nline two",1,2020-01-01,true,false\nb,x,2,2020-01-02,true,false\n')
    got = csv_src.read_csv(spark, p, csv_src.COMMITS).collect()
    assert [(r.PROJECT_ID, r.COMMIT_HASH, r.IN_MAIN_BRANCH) for r in got] == [("a", "1", True), ("b", "2", True)]


@pytest.mark.parametrize("schema,row,column", [
    ("COMMITS", "a,1,not-a-date,true,false", "AUTHOR_DATE"), ("COMMITS", "a,1,2020-01-01,maybe,false", "IN_MAIN_BRANCH"),
    ("CHANGES", "a,1,12.7,0", "LINES_ADDED"), ("CHANGES", "a,1,0,abc", "LINES_REMOVED")])
def test_bad_values_are_counted(spark, tmp_path, schema, row, column):
    s = getattr(csv_src, schema)
    good = "a,2,2020-01-01,true,false" if schema == "COMMITS" else "a,2,12.0,"
    p = _csv(tmp_path, ",".join(s) + f"\n{row}\n{good}\n")
    with pytest.raises(ValueError, match=f"{column}.: 1"):
        csv_src.read_csv(spark, p, s)
    assert [r.COMMIT_HASH for r in csv_src.read_csv(spark, p, s, on_bad="drop").collect()] == ["2"]
    assert csv_src.read_csv(spark, p, s, on_bad="null").filter(f"{column} IS NULL AND COMMIT_HASH = '1'").count() == 1


def test_quarantine_holds_the_bad_rows_as_text(spark, tmp_path):
    p = _csv(tmp_path, "PROJECT_ID,COMMIT_HASH,LINES_ADDED,LINES_REMOVED\na,1,x,y\na,2,3,4\nb,3,5,z\nb,4,NA,\n")
    good, bad, counts = csv_src.read_csv_checked(spark, p, csv_src.CHANGES)
    assert counts == {"LINES_ADDED": 1, "LINES_REMOVED": 2}
    assert sorted(tuple(r) for r in bad.collect()) == [("a", "1", "x", "y"), ("b", "3", "5", "z")]
    assert sorted(tuple(r) for r in good.collect()) == [("a", "2", 3, 4), ("b", "4", None, None)]
    assert good.columns == bad.columns == list(csv_src.CHANGES)


def test_strict_reading_scans_a_file_once(spark, tmp_path, monkeypatch):
    p = _csv(tmp_path, "PROJECT_ID,COMMIT_HASH,LINES_ADDED,LINES_REMOVED\na,1,2,3\n")
    plans = []
    keep = csv_src.materialize
    monkeypatch.setattr(csv_src, "materialize", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    out = csv_src.read_csv(spark, p, csv_src.CHANGES)
    assert len(plans) == 1 and plans[0].count("FileScan csv") == 1
    assert "FileScan csv" not in out._jdf.queryExecution().executedPlan().toString()


def _odd_file(tmp_path, n, seed, crlf=False):
    """Records whose quoted fields hold line breaks, doubled quotes, commas and empty lines."""
    import random
    rnd = random.Random(seed)
    bits = ["x", "line\nbreak", 'say ""hi""', "a,b", "\n\n", "é", '""', "\n", "long " * 30 + "\n" + "tail " * 30, 'q"",""\n""']
    rows = ["id,note,k"]
    for i in range(n):
        note = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 4)))
        rows.append(f'{i},"{note}",{i % 7}' if rnd.random() < 0.7 else f"{i},plain,{i % 7}")
    text = ("\r\n" if crlf else "\n").join(rows) + "\n"
    p = tmp_path / f"odd{seed}.csv"
    p.write_bytes(text.encode())
    return str(p)


@pytest.mark.parametrize("n,seed,split,crlf", [(400, 1, 2048, False), (400, 2, 97, False), (400, 3, 1000, True), (3, 4, 40, False)])
def test_one_file_with_quoted_breaks_is_read_by_several_tasks(spark, tmp_path, n, seed, split, crlf):
    from cohortlab.sources import csv_records
    p = _odd_file(tmp_path, n, seed, crlf)
    want = sorted(tuple(r) for r in csv_src.read_csv(spark, p).collect())
    schema = {"id": "bigint", "note": "string", "k": "int"}
    got = csv_src.read_csv(spark, p, schema, split_bytes=split)
    assert sorted((str(r.id), r.note, str(r.k)) for r in got.collect()) == want and len(want) == n
    with csv_records._Settings(spark, split):
        lines = spark.read.option("lineSep", "\n").text(p)
        tasks = lines.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 1


def test_a_record_longer_than_ranges_and_several_files(spark, tmp_path, monkeypatch):
    from cohortlab.sources import csv_records
    folder = tmp_path / "many"
    folder.mkdir()
    long = "\n".join(f"line {i}" for i in range(300))
    (folder / "a.csv").write_text(f'id,note\n1,"{long}"\n2,x\n3,"a\nb"\n')
    (folder / "b.csv").write_text('id,note\n4,"c\n\nd"\n\n5,""\n')
    want = {("1", long), ("2", "x"), ("3", "a\nb"), ("4", "c\n\nd"), ("5", None)}
    assert {tuple(r) for r in csv_src.read_csv(spark, str(folder)).collect()} == want
    for limit in (csv_records.BROADCAST_RANGES, 0):   # ranges told by broadcast, and by a shuffle
        monkeypatch.setattr(csv_records, "BROADCAST_RANGES", limit)
        assert {tuple(r) for r in csv_src.read_csv(spark, str(folder), split_bytes=200).collect()} == want


def test_strict_reading_leaves_models_able_to_score(spark, tmp_path):
    """Model summaries hold the session; reading must leave nothing in it that can't be serialised."""
    from cohortlab.operators import models
    csv_src.read_csv(spark, _csv(tmp_path, "PROJECT_ID,COMMIT_HASH,LINES_ADDED,LINES_REMOVED\na,1,2,3\n"), csv_src.CHANGES).collect()
    df = spark.createDataFrame([(f"h{i}", "p", float(i % 7), i % 2) for i in range(60)], "COMMIT_HASH string, PROJECT_ID string, f1 double, BIC int")
    for fit in (models.fit_forest(df, ["f1"], num_trees=2, max_depth=2, min_leaf=2), models.fit_logistic(df, ["f1"], "lr")):
        assert fit.score(df).count() == 60


def test_many_short_ranges_make_few_tasks(spark, tmp_path):
    """The ranges stay as short as asked for; the tasks' number follows the cores and bytes."""
    from cohortlab.sources import csv_records
    p = _odd_file(tmp_path, 400, 5, False)
    total = csv_records.file_sizes(spark, p).agg({"length": "sum"}).first()[0]
    with csv_records._Settings(spark, 97, total):
        lines = spark.read.option("lineSep", "\n").text(p)
        assert lines.rdd.getNumPartitions() <= 6 * spark.sparkContext.defaultParallelism
        assert lines.select("_metadata.file_block_start").distinct().count() > 10 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
