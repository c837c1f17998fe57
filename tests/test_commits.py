"""Versioned folders: readers see a whole state, whatever fails."""

import pytest
from pyspark.sql import functions as F

from cuelake.sources import commits, sinks


def values(df):
    return sorted(r[0] for r in df.collect())


def test_versions_and_failed_writes(spark, tmp_path):
    folder = f"{tmp_path}/t"
    with pytest.raises(ValueError, match="no version"):
        commits.read(spark, folder)
    assert commits.commit(spark.range(3), folder) == 0
    # a state may be made from what the folder holds
    assert commits.commit(commits.read(spark, folder).union(spark.range(3, 5)), folder, expect=0) == 1
    assert values(commits.read(spark, folder)) == [0, 1, 2, 3, 4] and values(commits.read(spark, folder, 0)) == [0, 1, 2]

    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        commits.commit(broken, folder)
    assert values(commits.read(spark, folder)) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="newer"):
        commits.commit(spark.range(1), folder, expect=0)
    # rows that a dead writer left do not show, and go with a cleaning
    spark.range(99).write.parquet(f"{folder}/{commits.DATA}dead")
    assert commits.commit(spark.range(0), folder, note="empty") == 2
    assert values(commits.read(spark, folder)) == [] and commits.manifest(spark, folder, 2)["note"] == "empty"
    assert any("dead" in n for n in commits.clean(spark, folder, kept=1))
    assert commits.versions(spark, folder) == [1, 2] and values(commits.read(spark, folder, 1)) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="version 0"):
        commits.read(spark, folder, 0)


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/t"
    commits.commit(spark.range(1), folder)
    # the second writer looked before the first one was done
    monkeypatch.setattr(commits, "versions", lambda *_: [0])
    assert commits.commit(spark.range(2), folder) == 1
    with pytest.raises(ValueError, match="by another"):
        commits.commit(spark.range(3), folder)
    monkeypatch.undo()
    assert values(commits.read(spark, folder)) == [0, 1] and commits.clean(spark, folder) == []


def test_running_offsets_carry_over_ranges(spark):
    rows = spark.range(5_000).selectExpr("if(id % 10 = 0, null, id % 2) as t", "id as ord", "if(id % 7 = 0, null, id % 5) as size", "1 as offset")
    got = sinks.running_offsets(rows.repartition(4), "t", ["ord"], "size", "at").collect()
    assert len(got) == 5_000
    sums = {}
    for r in sorted(got, key=lambda r: r["ord"]):
        assert r["at"] == sums.get(r["t"], 0)
        sums[r["t"]] = sums.get(r["t"], 0) + (r["size"] or 0)


def test_merged_rows_read_in_order(spark, tmp_path):
    clips = spark.createDataFrame([("x", 1, 5, 10), ("x", 2, 3, 7), ("y", 3, 1, None), ("y", 4, 2, 4)], "target string, clip long, ord long, duration_us long")
    rows = spark.createDataFrame([(1, 0), (1, 4), (2, 6), (3, 1), (4, 2), (4, 2), (9, 0), (None, 0)], "clip long, at_us long")
    version = sinks.write_merged(clips, rows.repartition(3), "target", f"{tmp_path}/m")
    got = sorted((r["target"], r["place"], r["clip"], r["at_us"]) for r in sinks.read_merged(spark, f"{tmp_path}/m", "target").collect())
    assert version == 0 and got == [("x", 0, 2, 6), ("x", 1, 1, 7), ("x", 2, 1, 11), ("y", 0, 3, 1), ("y", 1, 4, 2), ("y", 2, 4, 2)]
    assert sinks.write_merged(clips.limit(0), rows, "target", f"{tmp_path}/m") == 1 and sinks.read_merged(spark, f"{tmp_path}/m", "target").count() == 0
