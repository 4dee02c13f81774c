import os

import pytest
from pyspark.sql import functions as F

from tabgauge.operators.clean import apply_edits
from tabgauge.sources import edits as stored
from tabgauge.sources.edits import Folder, edit_table, finish_edits, keys_with_files, touched_files

EDIT = "k bigint, s string, deleted boolean"


def write(spark, path, rows=2000, files=10):
    df = spark.range(rows).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("s"))
    df.repartitionByRange(files, "k").write.parquet(path)


def parts(path):
    return {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_key_rewrites_one_file(spark, tmp_path):
    path = str(tmp_path / "a table")
    write(spark, path)
    before, old = parts(path), spark.read.parquet(path).collect()
    edits = spark.createDataFrame([(777, "new", False)], EDIT)
    replaced = edit_table(spark, path, edits, ["k"])
    after = parts(path)
    assert len(replaced) == 1 and set(before) - set(after) == set(replaced)
    assert len(set(after) - set(before)) == 1
    assert all(after[f] == before[f] for f in set(before) & set(after))
    want = sorted((r["k"], "new" if r["k"] == 777 else r["s"]) for r in old)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == want
    assert not os.path.exists(f"{path}/_edits")


def test_the_scan_reads_keys_in_their_range_only(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path)
    df = spark.read.parquet(path)
    edits = spark.createDataFrame([(5, "x", False), (9, "y", False)], EDIT)
    plan = keys_with_files(df, edits, ["k"])._jdf.queryExecution().toString()
    scans = plan[plan.index("== Physical Plan ==") :]
    assert "GreaterThanOrEqual(k,5), LessThanOrEqual(k,9)" in scans
    assert "ReadSchema: struct<k:bigint>" in scans
    assert len(touched_files(df, edits, ["k"])) == 1


def test_update_delete_add_and_null_keys_as_on_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path, 500, 7)
    more = spark.createDataFrame([(None, "none"), (3, "again")], "k bigint, s string")
    more.write.mode("append").parquet(path)
    edits = spark.createDataFrame(
        [(3, "changed", False), (4, None, True), (None, "gap", False), (9999, "added", False), (8888, None, True)],
        EDIT,
    )
    want = rows(apply_edits(spark.read.parquet(path), edits, ["k"]))
    edit_table(spark, path, edits, ["k"])
    assert rows(spark.read.parquet(path)) == want
    assert (None, "gap") in want and want.count((3, "changed")) == 2


def test_keys_of_two_columns_and_of_another_type(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(300).select(
        (F.col("id") % 20).alias("a"), F.col("id").cast("string").alias("b"), F.lit(0.5).alias("v")
    )
    df.repartitionByRange(5, "a", "b").write.parquet(path)
    edits = spark.createDataFrame([(7, "27", 1.0), (7, "none", 2.0)], "a int, b string, v double")
    want = rows(apply_edits(spark.read.parquet(path), edits, ["a", "b"]))
    assert len(edit_table(spark, path, edits, ["a", "b"])) == 1
    assert rows(spark.read.parquet(path)) == want and len(want) == 301


def test_nothing_to_do_only_new_rows_and_everything_deleted(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path, 100, 4)
    before = parts(path)
    assert edit_table(spark, path, spark.createDataFrame([], EDIT), ["k"]) == []
    assert edit_table(spark, path, spark.createDataFrame([(700, None, True)], EDIT), ["k"]) == []
    assert parts(path) == before
    assert edit_table(spark, path, spark.createDataFrame([(700, "n", False)], EDIT), ["k"]) == []
    assert set(before) < set(parts(path)) and spark.read.parquet(path).count() == 101
    gone = spark.read.parquet(path).select("k", F.lit(None).cast("string").alias("s"), F.lit(True).alias("deleted"))
    edit_table(spark, path, gone, ["k"])
    empty = spark.read.parquet(path)
    assert empty.count() == 0 and empty.columns == ["k", "s"]


def test_interrupted_edits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write(spark, path, 100, 4)
    before, edits = parts(path), spark.createDataFrame([(5, "new", False)], EDIT)
    # Before the note: the table is as it was, and the next edit starts anew.
    with monkeypatch.context() as broken:
        broken.setattr(Folder, "note", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            edit_table(spark, path, edits, ["k"])
    assert parts(path) == before and spark.read.parquet(path).count() == 100
    # After the note: finishing it gives the edited table.
    finish, calls = stored.finish_edits, []
    with monkeypatch.context() as broken:
        broken.setattr(stored, "finish_edits", lambda *a: finish(*a) if not calls and not calls.append(1) else None)
        edit_table(spark, path, edits, ["k"])
    assert os.path.exists(f"{path}/_edits/replaced")
    finish_edits(spark, path)
    finish_edits(spark, path)
    got = spark.read.parquet(path)
    assert got.count() == 100 and got.where("k = 5").first()["s"] == "new"


def test_repeated_edits_and_partition_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path, 100, 4)
    twice = spark.createDataFrame([(5, "a", 1), (5, "b", 2)], "k bigint, s string, no int")
    with pytest.raises(Exception, match="more than once"):
        edit_table(spark, path, twice.drop("no"), ["k"])
    assert spark.read.parquet(path).count() == 100
    edit_table(spark, path, twice, ["k"], order="no")
    assert spark.read.parquet(path).where("k = 5").first()["s"] == "b"
    folders = str(tmp_path / "p")
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(folders)
    with pytest.raises(ValueError):
        edit_table(spark, folders, twice.select(F.col("k").alias("id")), ["id"])
