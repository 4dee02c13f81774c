"""Date questions as ranges that reach the scan; the message log's order and folders."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tabgauge.plans import agent
from tabgauge.plans.agent import date_text_filter
from tabgauge.sources.messages import (
    append_messages,
    clear_log,
    load_messages,
    read_messages,
)

ROWS = "user_email string, role string, message string"


def dates(seed, first=1995, last=2105):
    rnd = random.Random(seed)
    start = datetime.date(first, 1, 1).toordinal()
    end = datetime.date(last, 12, 31).toordinal()
    days = [datetime.date.fromordinal(rnd.randint(start, end)) for _ in range(3000)]
    days += [datetime.date(y, m, d) for y in (2001, 2002, 2003, 2024) for m in (1, 2, 3) for d in (1, 2, 15, 28)]
    return [datetime.datetime(d.year, d.month, d.day, rnd.choice([0, 23]), rnd.choice([0, 59])) for d in days] + [None]


@pytest.mark.parametrize("day", ["01-01", "01-02", "02-01", "03-01", "02-29", "12-31"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string"])
def test_the_same_rows_as_a_search_in_the_text(spark, monkeypatch, day, kind):
    monkeypatch.setattr(agent, "asked_day", lambda question: day)
    rows = [(t,) for t in dates(1)]
    df = spark.createDataFrame(rows, "t timestamp_ntz").select(F.col("t").cast(kind).alias("t"))
    found = date_text_filter(df, "t", "?")
    assert "contains" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    wanted = df.where(F.col("t").cast("string").contains(day))
    assert sorted(found.collect()) == sorted(wanted.collect())


def test_other_texts_are_searched(spark):
    df = spark.createDataFrame([("01-01-2024",), ("2024-01-01 x 01-02",), (None,)], "t string")
    assert date_text_filter(df, "t", "on january 1?").count() == 2
    assert date_text_filter(df.where("t IS NULL"), "t", "on january 1?").count() == 0
    assert date_text_filter(df, "t", "what?").count() == 3


def test_the_scan_gets_the_ranges(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = date_text_filter(orders, "o_orderdate", "sold on feb 1")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed


def test_rows_of_one_append_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for turn in range(0, 40, 20):
        rows = [(f"u{i % 3}", "user", f"{turn + i:03}") for i in range(20)]
        append_messages(path, spark.createDataFrame(rows, ROWS).repartition(1).sort("message"))
    log = read_messages(spark, path)
    assert log.select("timestamp").distinct().count() == 2
    got = [r["content"] for r in load_messages(log, "u1").collect()]
    assert got == sorted(got) and len(got) == 14
    numbered = load_messages(log, "u1", place="n").orderBy("n").collect()
    assert [(r["n"], r["content"]) for r in numbered] == list(enumerate(got, 1))
    plan = load_messages(log, "u1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def files(path):
    return {
        os.path.join(folder, f): os.stat(os.path.join(folder, f)).st_mtime_ns
        for folder, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def test_clearing_one_user_leaves_other_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"user {i % 200}", "user", f"message {i}") for i in range(600)] + [(None, "user", "?")]
    append_messages(path, spark.createDataFrame(rows, ROWS))
    before, all_rows = files(path), read_messages(spark, path).count()
    folder = read_messages(spark, path).where("user_email = 'user 7'").first()["bucket"]
    clear_log(spark, path, "user 7")
    after, log = files(path), read_messages(spark, path)
    assert log.count() == all_rows - 3 and log.where("user_email = 'user 7'").count() == 0
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all(f"bucket={folder}{os.sep}" in f for f in changed)
    clear_log(spark, path, None)
    assert read_messages(spark, path).where("user_email IS NULL").count() == 0
    alone = str(tmp_path / "alone")
    append_messages(alone, spark.createDataFrame([("a", "user", "x"), ("b", "user", "y")], ROWS))
    clear_log(spark, alone, "a")
    assert [r["user_email"] for r in read_messages(spark, alone).collect()] == ["b"]
