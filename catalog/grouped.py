"""Grouped means, shares, alerts and key figures."""

from __future__ import annotations

from catalog.frames import (
    LABELLED,
    MACHINES,
    UNITS,
    each,
    fences,
    labelled,
    machines,
    table,
    units,
)
from catalog.profiles import LINE_NUMBERS
from catalog.registry import query
from tabgauge.operators.groups import (
    critical_threshold,
    first_groups,
    hierarchy_counts,
    machine_alerts,
    metric_scatter,
    multi_trend,
    risk_score,
    system_alert,
    top_groups,
    trend,
    unit_counts,
    unit_share,
)
from tabgauge.plans.dashboard import kpi

UNIT_COUNTS = f"""(SELECT unit, count(*) AS "rows", count(*) FILTER (value > high) AS critical_count,
    avg(value) AS avg_value FROM {UNITS} AS t, {fences('events', 'value')} AS f GROUP BY unit)"""


@query("unit_counts", f"SELECT * FROM {UNIT_COUNTS} AS u", avg_value=4)
def unit_counts_query(spark, sf_dir):
    return unit_counts(units(spark, sf_dir), "unit", "value")


@query(
    "trend",
    "SELECT o_orderdate AS stamp, avg(o_totalprice) AS mean FROM orders GROUP BY 1 ORDER BY 1",
    mean=2,
)
def _trend(spark, sf_dir):
    return trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query(
    "multi_trend",
    f"""SELECT l_shipdate AS stamp, {', '.join(f'avg({c}) AS {c}' for c in LINE_NUMBERS)}
    FROM lineitem GROUP BY 1""",
    **{c: 2 for c in LINE_NUMBERS},
)
def _multi_trend(spark, sf_dir):
    return multi_trend(table(spark, sf_dir, "lineitem"), "l_shipdate")


PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]


@query(
    "multi_trend_dateless",
    each(
        PART_NUMBERS,
        """SELECT '{c}' AS "column", CAST(g.i AS INTEGER) AS bin, a + g.i * ((b - a) / 30.0) AS low,
        a + (g.i + 1) * ((b - a) / 30.0) AS high, coalesce(n, 0) AS n
        FROM (SELECT CAST(min({c}) AS DOUBLE) AS a, CAST(max({c}) AS DOUBLE) AS b FROM part) AS e,
        range(30) AS g(i) LEFT JOIN (
            SELECT CAST(least(floor(({c} - a) / ((b - a) / 30.0)), 29) AS INTEGER) AS bin, count(*) AS n
            FROM part, (SELECT CAST(min({c}) AS DOUBLE) AS a, CAST(max({c}) AS DOUBLE) AS b FROM part) AS f
            GROUP BY 1) AS c ON c.bin = g.i""",
    ),
    low=4,
    high=4,
)
def _multi_trend_dateless(spark, sf_dir):
    return multi_trend(table(spark, sf_dir, "part"), None)


MEANS = """(SELECT p_brand AS "value", avg(p_retailprice) AS mean FROM part
    WHERE p_brand IS NOT NULL GROUP BY 1)"""


@query("top_groups", f"""SELECT * FROM {MEANS} AS m ORDER BY mean DESC, "value" LIMIT 10""", mean=4)
def _top_groups(spark, sf_dir):
    return top_groups(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 10)


@query("first_groups", f"SELECT * FROM {MEANS} AS m", mean=4)
def _first_groups(spark, sf_dir):
    return first_groups(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query(
    "unit_share",
    """SELECT "value", n, n / sum(n) OVER () AS share FROM (
    SELECT source AS "value", count(*) AS n FROM documents GROUP BY 1) AS t""",
    share=6,
)
def _unit_share(spark, sf_dir):
    return unit_share(table(spark, sf_dir, "documents"), "source")


@query(
    "hierarchy_counts",
    f"""SELECT lang AS parent, source AS child, false AS is_total, count(*) AS n
    FROM {LABELLED} AS t GROUP BY 1, 2
    UNION ALL SELECT lang, NULL, true, count(*) FROM {LABELLED} AS t GROUP BY 1""",
)
def _hierarchy_counts(spark, sf_dir):
    return hierarchy_counts(labelled(spark, sf_dir), "lang", "source")


@query(
    "hierarchy_counts_whole",
    """SELECT l_returnflag AS parent, l_linestatus AS child, false AS is_total, count(*) AS n
    FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT l_returnflag, NULL, true, count(*) FROM lineitem GROUP BY 1""",
)
def _hierarchy_counts_whole(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return hierarchy_counts(lines, "l_returnflag", "l_linestatus")


@query(
    "machine_alerts",
    f"""SELECT unit, 'value' AS metric, avg_value, critical_count, 'HIGH' AS severity
    FROM {UNIT_COUNTS} AS u WHERE critical_count > "rows" * 0.2""",
    avg_value=4,
)
def _machine_alerts(spark, sf_dir):
    return machine_alerts(units(spark, sf_dir), "unit", "value")


@query(
    "system_alert",
    f"""SELECT 'System-Wide' AS unit, 'n_chars' AS metric, avg(n_chars) AS avg_value,
    count(*) FILTER (n_chars > high) AS critical_count, 'MEDIUM' AS severity
    FROM documents, {fences('documents', 'n_chars')} AS f HAVING count(*) FILTER (n_chars > high) > 0""",
    avg_value=4,
)
def _system_alert(spark, sf_dir):
    return system_alert(table(spark, sf_dir, "documents"), "n_chars")


@query(
    "risk_score",
    f"""SELECT unit, critical_count, least(100.0, critical_count * 1000.0 / n) AS score,
    CASE WHEN least(100.0, critical_count * 1000.0 / n) < 33 THEN 'low'
         WHEN least(100.0, critical_count * 1000.0 / n) < 66 THEN 'medium' ELSE 'high' END AS band,
    least(100.0, critical_count * 1000.0 / n) >= 80 AS over_threshold
    FROM (SELECT CAST(unit AS VARCHAR) AS unit, critical_count FROM {UNIT_COUNTS} AS u
        WHERE critical_count > "rows" * 0.2
        UNION ALL SELECT 'System-Wide', count(*) FILTER (value > high)
        FROM events, {fences('events', 'value')} AS f) AS a, (SELECT count(*) AS n FROM events) AS c""",
    score=6,
)
def _risk_score(spark, sf_dir):
    rows = units(spark, sf_dir)
    raised = machine_alerts(rows, "unit", "value").unionByName(system_alert(rows, "value"))
    return risk_score(rows, raised)


@query(
    "critical_threshold",
    f"SELECT 'l_extendedprice' AS metric, high AS threshold FROM {fences('lineitem', 'l_extendedprice')} AS f",
    threshold=4,
)
def _critical_threshold(spark, sf_dir):
    return critical_threshold(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(
    "metric_scatter",
    "SELECT o_orderkey, o_custkey AS x, o_totalprice AS y, o_orderpriority AS hue FROM orders",
)
def _metric_scatter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return metric_scatter(orders, "o_custkey", "o_totalprice", "o_orderpriority", ["o_orderkey"])


@query(
    "kpi",
    f"""WITH a AS (SELECT machine_id FROM {MACHINES} AS t, {fences(MACHINES, 'vibration')} AS f
        GROUP BY machine_id HAVING count(*) FILTER (vibration > high) > count(*) * 0.2)
    SELECT 'MANUFACTURING' AS scenario, count(DISTINCT machine_id) AS active_units,
    avg(rpm) / max(rpm) * 100 AS efficiency, (SELECT count(*) FROM a) AS alerts,
    CAST(100.0 AS DOUBLE) AS integrity, 'Excellent' AS integrity_status FROM {MACHINES} AS t""",
    efficiency=4,
    integrity=4,
)
def _kpi(spark, sf_dir):
    return kpi(machines(spark, sf_dir))


@query(
    "kpi_quality",
    f"""SELECT 'QUALITY_CONTROL' AS scenario, count(*) AS active_units, CAST(87.5 AS DOUBLE) AS efficiency,
    CAST(max(CASE WHEN toxic > high THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
    greatest(0.0, 100 - 2 * 100.0 * (2 * count(*) - count(quality) - count(toxic)) / (6 * count(*)))
    AS integrity,
    CASE WHEN 100 - 2 * 100.0 * (2 * count(*) - count(quality) - count(toxic)) / (6 * count(*)) > 95
    THEN 'Excellent'
    WHEN 100 - 2 * 100.0 * (2 * count(*) - count(quality) - count(toxic)) / (6 * count(*)) > 80
    THEN 'Fair' ELSE 'Poor' END AS integrity_status
    FROM {LABELLED} AS t, {fences(LABELLED, 'toxic')} AS f""",
    efficiency=4,
    integrity=4,
)
def _kpi_quality(spark, sf_dir):
    """A table named like quality control, without units: one alert for all rows."""
    return kpi(labelled(spark, sf_dir))
