"""Correlation and what goes with what."""

from __future__ import annotations

from catalog.frames import (
    LABELLED,
    MACHINES,
    SALES,
    SALES_NUMBERS,
    fences,
    labelled,
    machines,
    sales,
)
from catalog.registry import query
from tabgauge.operators.correlation import (
    corr_matrix,
    corr_pairs,
    high_corr_pairs,
    report_relationship,
    strong_corr,
    strongest_pair,
)
from tabgauge.plans.dashboard import diagnosed_alerts


def pairs_sql(source: str, columns: list[str]) -> str:
    """(i, j, col1, col2, r) with NaN read as missing."""
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            parts.append(
                f"""SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2,
                CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS r
                FROM {source} AS t"""
            )
    return "(" + " UNION ALL ".join(parts) + ")"


SALES_PAIRS = pairs_sql(SALES, SALES_NUMBERS)
BEST = f"(SELECT * FROM {SALES_PAIRS} AS p WHERE r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 1)"


@query("corr_pairs", f"SELECT * FROM {SALES_PAIRS} AS p", r=6)
def _corr_pairs(spark, sf_dir):
    return corr_pairs(sales(spark, sf_dir))


LABELLED_NUMBERS = ["doc_id", "n_chars", "quality", "toxic"]


@query(
    "corr_matrix",
    f"""WITH p AS (SELECT * FROM {pairs_sql(LABELLED, LABELLED_NUMBERS)} AS q)
    SELECT col1, col2, r FROM p UNION ALL SELECT col2, col1, r FROM p UNION ALL """
    + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in LABELLED_NUMBERS),
    r=6,
)
def _corr_matrix(spark, sf_dir):
    return corr_matrix(labelled(spark, sf_dir))


@query(
    "high_corr_pairs",
    f"""SELECT col1, col2, r, CASE WHEN abs(r) > 0.95 THEN 'Very High' ELSE 'High' END AS issue
    FROM {SALES_PAIRS} AS p WHERE abs(r) > 0.9""",
    r=6,
)
def _high_corr_pairs(spark, sf_dir):
    return high_corr_pairs(sales(spark, sf_dir))


@query(
    "strong_corr",
    f"""SELECT i, j, col1, col2, r FROM {pairs_sql(MACHINES, ['temperature', 'rpm', 'vibration'])} AS p
    WHERE abs(r) > 0.5""",
    r=6,
)
def _strong_corr(spark, sf_dir):
    return strong_corr(machines(spark, sf_dir))


@query(
    "strongest_pair",
    f"""SELECT col1, col2, r, abs(r) AS strength,
    CASE WHEN r > 0 THEN 'rising together' ELSE 'one falling as the other rises' END AS direction,
    CASE WHEN abs(r) > 0.8 THEN 'tight' WHEN abs(r) > 0.5 THEN 'clear'
    ELSE 'loose' END AS link FROM {BEST} AS b""",
    r=6,
    strength=6,
)
def _strongest_pair(spark, sf_dir):
    return strongest_pair(sales(spark, sf_dir))


@query(
    "report_relationship",
    f"""SELECT col1, col2, r,
    CASE WHEN r > 0 THEN 'positive, above the limit' ELSE 'negative, above the limit' END AS relation,
    CASE WHEN r > 0 THEN 'both rise and fall together' ELSE 'one rises while the other falls' END
    AS movement FROM {BEST} AS b WHERE abs(r) > 0.5""",
    r=6,
)
def _report_relationship(spark, sf_dir):
    return report_relationship(sales(spark, sf_dir))


@query(
    "root_cause",
    f"""WITH a AS (SELECT machine_id FROM {MACHINES} AS t, {fences(MACHINES, 'vibration')} AS f
        GROUP BY machine_id HAVING count(*) FILTER (vibration > high) > count(*) * 0.2),
    c AS (SELECT * FROM (
        SELECT 0 AS k, 'temperature' AS name, abs(corr(vibration, temperature)) AS r FROM {MACHINES} AS t
        UNION ALL SELECT 1, 'rpm', abs(corr(vibration, rpm)) FROM {MACHINES} AS t) AS u
        ORDER BY r DESC, k LIMIT 1)
    SELECT machine_id AS alert, 'vibration' AS symptom, name AS likely_cause, r AS correlation,
    'Look into ' || name || ' first: it moves with the high readings of vibration.'
    AS recommendation FROM a, c WHERE r > 0.5""",
    correlation=6,
)
def _root_cause(spark, sf_dir):
    return diagnosed_alerts(machines(spark, sf_dir))
