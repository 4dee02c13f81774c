import pytest
from pyspark.sql import functions as F

from tabgauge.operators.roles import (
    classify_catalog,
    classify_columns,
    context_date_column,
    date_columns_by_name,
    date_names,
    detect_scenario,
    forecastable_columns,
    matching_names,
    metric_roles,
    normalize,
    scenario_name,
    text_looks_numeric,
)
from tabgauge.plans.agent import asked_day, context_text, insights, question_context
from tabgauge.plans.narrative import (
    action_list,
    narrative_facts,
    narrative_labels,
    overall_verdict,
    risk_cards,
)
from tabgauge.plans.report import export_quality_report, export_report, report_sections
from tabgauge.sources.generators import synth_basic, synth_machine
from tabgauge.sources.messages import (
    append_messages,
    chat_export,
    clear_messages,
    load_messages,
    message_count,
    read_messages,
)
from tabgauge.sources.sampling import missing_matrix, preview, sample_n
from tabgauge.sources.tables import narrow_types, read_csv, read_parquet, to_csv


def test_nan_is_missing_on_entry(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, n int")
    assert normalize(df).where("x is null").count() == 1


def test_date_text_must_parse_and_be_marked(spark):
    rows = [("2024-01-05", "20240105", "2024-01-05", None), (None, "20240106", "soon", None)]
    df = spark.createDataFrame(rows, "good string, bare string, mixed string, none string")
    flags = {r["column"]: r["is_date"] for r in classify_columns(df).collect()}
    assert flags == {"good": True, "bare": False, "mixed": False, "none": False}


def test_names_that_speak_of_time(spark):
    assert date_names(["Order_Date", "sentiment", "year_built", "price"]) == [
        "Order_Date", "sentiment", "year_built"]
    df = spark.createDataFrame([("2024-01-01", "good", 3)], "when_date string, sentiment string, n int")
    got = {r["column"]: (r["filled"], r["parsed"]) for r in date_columns_by_name(df).collect()}
    assert got == {"when_date": (1, 1), "sentiment": (1, 0)}
    assert context_date_column(df).first()["position"] == 0
    assert context_date_column(df.select("n")).count() == 0


def test_scenarios_and_roles(spark):
    assert scenario_name(["stock", "machine"]) == "MANUFACTURING"
    assert scenario_name(["compass"]) == "QUALITY_CONTROL"
    assert scenario_name(["stock_level"]) == "SUPPLY_CHAIN"
    assert scenario_name(["a"]) == "GENERIC"
    machine = synth_machine(spark, 20)
    found = detect_scenario(machine)
    assert (found.critical, found.health, found.efficiency, found.unit) == (
        "vibration", "temp_C", None, "machine_id")
    assert detect_scenario(machine, critical="pressure").critical == "pressure"
    plain = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    generic = detect_scenario(plain)
    assert (generic.critical, generic.health) == ("b", "a")
    quality = spark.createDataFrame([("ok", 2.0)], "status_quality string, score double")
    assert detect_scenario(quality).critical == "status_quality"
    assert metric_roles(quality).where("role = 'critical'").first()["mean"] is None


def test_catalog_of_many_tables_in_one_job(spark):
    rows = [("t", 0, "Ship_Date", "date"), ("t", 1, "shipment", "int"), ("t", 2, "time_to_ship", "int"),
            ("u", 0, "defect_rate", "double"), ("u", 1, "month", "int"), ("v", 0, "x", "int")]
    catalog = spark.createDataFrame(rows, "table string, position int, column string, dtype string")
    got = {(r["table"], r["column"]): r for r in classify_catalog(catalog).collect()}
    assert got["t", "Ship_Date"]["scenario"] == "SUPPLY_CHAIN"
    assert got["u", "month"]["scenario"] == "QUALITY_CONTROL"
    assert got["v", "x"]["scenario"] == "GENERIC"
    assert got["t", "Ship_Date"]["context_date"] and not got["t", "time_to_ship"]["context_date"]
    assert got["u", "month"]["date_name"] and not got["u", "month"]["context_date"]


def test_text_that_looks_numeric(spark):
    df = spark.createDataFrame([("12", "-1"), ("3", "2"), ("4", "1.5"), ("5", "x"), ("6", None)],
                               "digits string, other string")
    got = {r["column"]: r["looks_numeric"] for r in text_looks_numeric(df).collect()}
    assert got == {"digits": True, "other": False}


def test_forecastable_columns(spark):
    rows = [(i, f"c{i % 5}", f"d{i % 6}") for i in range(30)]
    df = spark.createDataFrame(rows, "n int, few string, many string")
    assert {r["column"] for r in forecastable_columns(df).collect()} == {"n", "few"}


def test_questions_find_columns_and_days(orders):
    columns = orders.columns
    assert matching_names("TOTALPRICE by orderstatus?", columns, ["x"]) == ["o_orderstatus", "o_totalprice"]
    assert matching_names("anything", columns, ["x"]) == ["x"]
    assert asked_day("on jan 15") == "01-01"
    assert asked_day("january 1") == "01-01"
    assert asked_day("in may") is None
    rows = question_context(orders, "totalprice?", ["o_orderkey"])
    assert rows.columns == ["o_totalprice", "o_orderdate"] and rows.count() == 1500
    text = context_text(orders, "totalprice?", ["o_orderkey"]).collect()
    lines = {r["line"] for r in text}
    assert lines >= {"question: totalprice?", "rows: 1500", "shown: o_totalprice,o_orderdate"}
    assert sum(r["part"] == 4 for r in text) == 1500
    first = orders.orderBy("o_orderkey").first()
    at = next(r for r in text if r["part"] == 4 and r["place"] == str(first["o_orderkey"]))
    assert at["line"].startswith(str(first["o_totalprice"]))


def test_insights_sections(orders):
    sections = {r["section"] for r in insights(orders).select("section").distinct().collect()}
    assert sections >= {"columns", "summary", "categories", "total"}


def test_story_of_a_clean_and_of_a_broken_table(spark, orders):
    facts = narrative_facts(orders, "o_orderdate", ["o_orderkey"])
    row = facts.first()
    pdf = orders.toPandas()
    assert row["metric"] == "o_orderkey"
    assert row["cv"] == pytest.approx(pdf["o_orderkey"].std() / pdf["o_orderkey"].mean() * 100)
    assert narrative_labels(facts).count() == 1
    assert overall_verdict(facts).first()["verdict"] == "excellent"
    assert action_list(facts).where("days = 30").count() == 4
    broken = spark.createDataFrame([(None, "a"), (1.0, None), (500.0, "a")] + [(2.0, "a")] * 7, "x double, s string")
    told = narrative_facts(broken)
    assert overall_verdict(told).first()["verdict"] == "needs work"
    assert {r["action"] for r in action_list(told).where("days = 7").collect()} == {
        "fix data gaps", "investigate extreme values", "plan for concentration"}
    assert [r["level"] for r in risk_cards(told).orderBy("card").collect()] == ["high", "high", "high"]


def test_story_without_numbers_or_rows(spark, empty):
    text = spark.createDataFrame([("a",), ("b",)], "s string")
    row = narrative_facts(text).first()
    assert (row["metric"], row["mean"], row["top_value"]) == (None, 0.0, "a")
    assert narrative_labels(narrative_facts(empty)).count() == 1


def test_samples_are_exact_and_repeatable(orders):
    one, two = sample_n(orders, ["o_orderkey"], 100), sample_n(orders, ["o_orderkey"], 100)
    assert one.count() == 100
    assert {r[0] for r in one.collect()} == {r[0] for r in two.collect()}
    assert sample_n(orders, ["o_orderkey"], 100, seed=1).join(one, "o_orderkey").count() < 100
    assert sample_n(orders, ["o_orderkey"], 5000).count() == orders.count()
    assert preview(orders, ["o_orderkey"]).count() == 15


def test_missing_matrix_covers_every_cell(nulls, orders):
    flags = missing_matrix(nulls, ["a"])
    assert flags.count() == 18
    assert flags.agg(F.sum("missing")).first()[0] == 7
    whole = missing_matrix(orders, ["o_orderkey"])
    assert whole.count() == 6 * 1500 and whole.agg(F.sum("missing")).first()[0] == 0


def test_csv_in_and_out(spark, tmp_path, orders):
    to_csv(orders, str(tmp_path / "orders"))
    read = read_csv(spark, str(tmp_path / "orders"))
    assert read.count() == orders.count()
    assert dict(read.dtypes)["o_totalprice"] == "double"
    typed = read_csv(spark, str(tmp_path / "orders"), "o_orderkey bigint, o_custkey bigint")
    assert typed.columns == ["o_orderkey", "o_custkey"]
    assert read_csv(spark, str(tmp_path / "nothing")) is None
    gaps = tmp_path / "gaps.csv"
    gaps.write_text("n,x,s,d,e\n1,NaN,null,2024-01-05,\nNA,2.5,b,N/A,\n3,,x,2024-02-01,NA\n")
    read = read_csv(spark, str(gaps))
    assert dict(read.dtypes) == {"n": "int", "x": "double", "s": "string", "d": "timestamp",
                                 "e": "string"}
    assert [tuple(r)[:3] for r in read.collect()] == [(1, None, None), (None, 2.5, "b"), (3, None, "x")]


def test_narrowing_keeps_values(spark):
    df = spark.createDataFrame([(1, 40000, 2**40, 0.5, 1 / 3e9), (200, -1, 0, None, 1e12 + 0.7)],
                               "a bigint, b bigint, c bigint, d double, e double")
    assert [t for _, t in narrow_types(df, floats=True).dtypes] == ["smallint", "int", "bigint", "float", "double"]
    assert [t for _, t in narrow_types(df).dtypes][3:] == ["double", "double"]
    assert narrow_types(df).collect() == df.collect()


def test_made_up_tables(spark):
    basic = synth_basic(spark)
    assert basic.count() == 1000
    assert basic.select("Category").distinct().count() == 3
    machine = synth_machine(spark)
    assert machine.count() == 500
    assert machine.where("defective <> cast(vibration > 1.6 and temp_C > 74 as int)").count() == 0
    assert machine.collect() == synth_machine(spark).collect()


def test_message_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("u", "user", "hi <b>\nyou"), ("v", "user", "x")],
                                 "user_email string, role string, message string")
    append_messages(path, rows)
    append_messages(path, spark.createDataFrame([("u", "assistant", "yes")], rows.schema))
    log = read_messages(spark, path)
    assert [tuple(r) for r in load_messages(log, "u").collect()] == [("user", "hi <b>\nyou"), ("assistant", "yes")]
    assert message_count(clear_messages(log, "u")).first()["messages"] == 1
    shown = chat_export(log).where("user_email = 'u' and role = 'asked'").first()
    assert shown["content"] == "hi &lt;b&gt;<br>you"


def test_report_sections_are_written_side_by_side(spark, tmp_path, orders):
    talk = spark.createDataFrame([("u", "user", "hi")], "user_email string, role string, message string")
    frames = report_sections(orders, ["o_orderkey"], talk)
    assert {n.split("_")[0] for n in frames} == {
        "summary", "preview", "dashboard", "inspector", "forecast", "narration", "chat"}
    export_report(frames, str(tmp_path / "report"))
    assert read_parquet(spark, str(tmp_path / "report" / "preview_rows")).count() == 15
    few = report_sections(orders, ["o_orderkey"], sections=["preview"])
    assert set(few) == {"summary", "preview_rows", "preview_columns"}
    with pytest.raises(ValueError):
        report_sections(orders, ["o_orderkey"], sections=["music"])
    export_quality_report(orders, str(tmp_path / "quality"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "quality")).collect()]
    assert lines[0] == "DATA QUALITY REPORT"
