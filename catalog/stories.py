"""The written summary, its labels and the context for questions."""

from __future__ import annotations

from catalog.frames import OPEN_ORDERS, SALES, fences, missing_sum, open_orders, sales, table
from catalog.linked import pairs_sql
from catalog.profiles import LINE_NUMBERS, describe_sql, top_values_sql
from catalog.registry import query
from tabgauge.plans.agent import context_text, insights
from tabgauge.plans.narrative import (
    action_list,
    narrative_facts,
    narrative_labels,
    overall_verdict,
    risk_cards,
)
from tabgauge.plans.report import report_forecast, report_story

SALES_COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net",
                 "l_returnflag", "l_shipdate"]


def told(spark, sf_dir):
    """Line items with the net price first, as the metric."""
    rows = sales(spark, sf_dir)
    return rows.select(
        "net", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey",
        "l_returnflag", "l_shipdate",
    )


def _pairs(columns: list[str]) -> str:

    return f"""(SELECT * FROM {pairs_sql(SALES, columns)} AS p WHERE r IS NOT NULL
        ORDER BY abs(r) DESC, i, j LIMIT 1)"""


TOLD_NUMBERS = ["net", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"]
TOLD = f"""(WITH b AS (SELECT * FROM {_pairs(TOLD_NUMBERS)} AS x),
    t AS (SELECT l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
    o AS (SELECT count(*) AS outliers FROM {SALES} AS s, {fences(SALES, 'net')} AS f
        WHERE net < low OR net > high),
    m AS (SELECT count(*) AS "rows", {missing_sum(SALES_COLUMNS)} AS missing, avg(net) AS mean,
        stddev_samp(net) AS std, min(net) AS min, max(net) AS max, quantile_cont(net, 0.5) AS median,
        skewness(net) AS skew FROM {SALES} AS s),
    a AS (SELECT net AS a FROM {SALES} AS s ORDER BY l_shipdate, l_orderkey, l_extendedprice LIMIT 1),
    z AS (SELECT net AS z FROM {SALES} AS s
        ORDER BY l_shipdate DESC, l_orderkey DESC, l_extendedprice DESC LIMIT 1)
    SELECT "rows", 8 AS columns, missing, missing * 100.0 / (8 * "rows") AS missing_pct,
    'net' AS metric, mean, std, min, max, median, max - min AS spread, std / mean * 100 AS cv, skew,
    outliers, 'l_returnflag' AS segment, v AS top_value, n * 100.0 / "rows" AS top_pct,
    true AS has_time, (z - a) / a * 100 AS growth, abs(r) AS strength, col1, col2, r
    FROM m, b, t, o, a, z)"""
TOLD_PLACES = dict(
    missing_pct=4, mean=2, std=2, min=2, max=2, median=2, spread=2, cv=4, skew=4, top_pct=4,
    growth=4, strength=6, r=6,
)


def told_facts(spark, sf_dir):
    return narrative_facts(told(spark, sf_dir), "l_shipdate", ["l_orderkey", "l_extendedprice"])


@query("narrative_facts", f"SELECT * FROM {TOLD} AS f", **TOLD_PLACES)
def _narrative_facts(spark, sf_dir):
    return told_facts(spark, sf_dir)


@query(
    "narrative_labels",
    f"""SELECT CASE WHEN cv < 20 THEN 'stable' WHEN cv < 50 THEN 'moderate' ELSE 'volatile' END
    AS volatility,
    CASE WHEN growth > 20 THEN 'rising fast' WHEN growth > 5 THEN 'rising'
    WHEN growth < -20 THEN 'falling fast' WHEN growth < -5 THEN 'falling'
    ELSE 'level' END AS growth,
    CASE WHEN top_pct > 60 THEN 'in one place' WHEN top_pct > 40
    THEN 'uneven' ELSE 'spread out' END AS concentration,
    CASE WHEN std < mean * 0.3 THEN 'steady' WHEN std < mean * 0.6
    THEN 'varied' ELSE 'scattered' END AS variability,
    CASE WHEN spread > mean THEN 'wide' ELSE 'manageable' END AS spread FROM {TOLD} AS f""",
)
def _narrative_labels(spark, sf_dir):
    return narrative_labels(told_facts(spark, sf_dir))


ORDER_TOLD = f"""(SELECT count(*) AS "rows", {missing_sum([
        'o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority', 'o_orderdate', 'o_custkey'])}
    * 100.0 / (6 * count(*)) AS missing_pct, skewness(o_totalprice) AS skew,
    count(*) FILTER (o_totalprice < low OR o_totalprice > high) AS outliers
    FROM {OPEN_ORDERS} AS t, {fences(OPEN_ORDERS, 'o_totalprice')} AS f)"""


def order_facts(spark, sf_dir):
    rows = open_orders(spark, sf_dir)
    return narrative_facts(
        rows.select("o_totalprice", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority",
                    "o_orderdate"),
        "o_orderdate",
        ["o_orderkey"],
    )


def _card(number: int, name: str, value: str, a: float, b: float, words: tuple) -> str:
    return f"""SELECT {number} AS card, '{name}' AS name, {value} AS "value",
    CASE WHEN {value} < {a} THEN 'low' WHEN {value} < {b} THEN 'medium' ELSE 'high' END AS "level",
    CASE WHEN {value} < {a} THEN '{words[0]}' WHEN {value} < {b} THEN '{words[1]}'
    ELSE '{words[2]}' END AS advice FROM {ORDER_TOLD} AS f"""


@query(
    "risk_cards",
    " UNION ALL ".join(
        [
            _card(1, "Data Completeness", "missing_pct", 1, 5,
                  ("reliable", "fill minor gaps", "clean first")),
            _card(2, "Outlier Risk", '(outliers * 100.0 / "rows")', 1, 5,
                  ("stable", "investigate unusual values", "use the median")),
            _card(3, "Distribution Balance", "abs(skew)", 0.5, 1,
                  ("mean is accurate", "consider the median", "report the median")),
        ]
    ),
    value=4,
)
def _risk_cards(spark, sf_dir):
    return risk_cards(order_facts(spark, sf_dir))


@query(
    "overall_verdict",
    f"""SELECT CASE WHEN missing_pct < 2 AND outliers < "rows" * 0.02 THEN 'excellent'
    WHEN missing_pct < 10 THEN 'acceptable' ELSE 'needs work' END AS verdict FROM {ORDER_TOLD} AS f""",
)
def _overall_verdict(spark, sf_dir):
    return overall_verdict(order_facts(spark, sf_dir))


@query(
    "action_list",
    f"""WITH f AS (SELECT * FROM {TOLD} AS x)
    SELECT 7 AS days, 1 AS step, 'fix data gaps' AS action, NULL AS subject, missing_pct AS amount
    FROM f WHERE missing_pct > 1
    UNION ALL SELECT 7, 2, 'investigate extreme values', metric, outliers FROM f WHERE outliers > 0
    UNION ALL SELECT 7, 3, 'plan for concentration', top_value, top_pct FROM f WHERE top_pct > 60
    UNION ALL SELECT 7, 4, 'data is clean', NULL, NULL FROM f
        WHERE missing_pct <= 1 AND outliers = 0 AND top_pct <= 60
    UNION ALL SELECT 30, 1, CASE WHEN strength > 0.5 THEN 'monitor the strongest pair'
        ELSE 'run weekly summaries' END, CASE WHEN strength > 0.5 THEN col1 || ' + ' || col2 END,
        CASE WHEN strength > 0.5 THEN strength END FROM f
    UNION ALL SELECT 30, 2, 'forecast the target', metric, NULL FROM f
    UNION ALL SELECT 30, 3, 'ask which unit needs attention', NULL, NULL
    UNION ALL SELECT 30, 4, 'share the report', NULL, NULL""",
    amount=4,
)
def _action_list(spark, sf_dir):
    return action_list(told_facts(spark, sf_dir))


@query(
    "report_story",
    f"""SELECT 'l_orderkey' AS metric, mean, min, max, std,
    CASE WHEN std < mean * 0.3 THEN 'steady' WHEN std < mean * 0.6
    THEN 'varied' ELSE 'scattered' END AS variability
    FROM ({describe_sql('lineitem', 'l_orderkey')}) AS d""",
    mean=2,
    std=2,
)
def _report_story(spark, sf_dir):
    return report_story(table(spark, sf_dir, "lineitem"))


@query(
    "report_forecast",
    """WITH m AS (SELECT l_shipdate AS stamp, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1)
    SELECT (SELECT avg(l_extendedprice) FROM lineitem) AS current_average,
    CASE WHEN b > a THEN 'Increasing' WHEN b < a THEN 'Decreasing' ELSE 'Stable' END AS direction
    FROM (SELECT mean AS a FROM m ORDER BY stamp LIMIT 1) AS f,
    (SELECT mean AS b FROM m ORDER BY stamp DESC LIMIT 1) AS l""",
    current_average=2,
)
def _report_forecast(spark, sf_dir):
    return report_forecast(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice")


def _insights_sql() -> str:
    numbers, texts = LINE_NUMBERS, ["l_returnflag", "l_linestatus"]
    named = [(c, "numeric", i) for i, c in enumerate(numbers)]
    named += [(c, "categorical", 8 + i) for i, c in enumerate(texts)]
    named.append(("l_shipdate", "date", 10))
    parts = [
        f"""SELECT 'columns' AS section, {i} AS place, '{c}' AS key, '{kind}' AS stat,
        CAST(NULL AS DOUBLE) AS "value" """
        for c, kind, i in named
    ]
    for i, c in enumerate(numbers):
        for stat, f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_samp")):
            parts.append(
                f"SELECT 'summary', {i}, '{c}', '{stat}', CAST({f}({c}) AS DOUBLE) FROM lineitem"
            )

    parts.append(
        f"""SELECT 'correlation', i * 11 + j, col1, col2, r FROM (
        SELECT * FROM {pairs_sql('lineitem', numbers)} AS p WHERE abs(r) > 0.5) AS c"""
    )
    parts.append(
        f"""SELECT 'categories', "position" * 10 + "rank", "column", "value", CAST(n AS DOUBLE)
        FROM ({top_values_sql('lineitem', texts)}) AS v"""
    )
    parts.append("SELECT 'total', 0, 'rows', 'count', CAST(count(*) AS DOUBLE) FROM lineitem")
    return " UNION ALL ".join(parts)


@query("insights", _insights_sql(), value=2)
def _insights(spark, sf_dir):
    return insights(table(spark, sf_dir, "lineitem"))


QUESTION = "Which orderpriority has the highest totalprice?"


def _context_sql() -> str:
    """Every line of the context: question, columns, facts and rows."""
    c = [f"({i}, '{place}', '{line}')" for i, place, line in (
        (1, "0", "question: " + QUESTION),
        (2, "0", "numeric: o_orderkey, o_custkey, o_totalprice"),
        (2, "1", "categorical: o_orderstatus, o_orderpriority"),
        (2, "2", "shown: o_totalprice,o_orderpriority,o_orderdate"),
    )]
    names = {"o_orderkey": 0, "o_custkey": 1, "o_totalprice": 3}
    figure = "CAST(CAST(round(CAST({} AS DOUBLE), 2) AS DECIMAL(38, 2)) AS VARCHAR)"
    parts = [
        f"SELECT * FROM (VALUES {', '.join(c)}) AS h(part, place, line)",
        "SELECT 3, '1/0/count', 'rows: ' || CAST(count(*) AS VARCHAR) FROM orders",
    ]
    for name in names:
        place = list(names).index(name)
        for stat, f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_samp")):
            value = figure.format(f"{f}({name})")
            parts.append(f"SELECT 3, '2/{place}/{stat}', '{name} {stat} ' || {value} FROM orders")
    parts.append(
        f"""SELECT 3, '3/' || CAST(i * 6 + j AS VARCHAR) || '/' || col2,
        col1 || ' ~ ' || col2 || ' ' || {figure.format('r')}
        FROM {pairs_sql('orders', list(names))} AS p WHERE abs(r) > 0.5"""
    )
    parts.append(
        """SELECT 4, CAST(o_orderkey AS VARCHAR), concat_ws(',', CAST(o_totalprice AS VARCHAR),
        o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) FROM orders"""
    )
    return " UNION ALL ".join(parts)


@query("context_text", _context_sql())
def _context_text(spark, sf_dir):
    return context_text(table(spark, sf_dir, "orders"), QUESTION, ["o_orderkey"])
