"""Table-level scores, labels and advice."""

from __future__ import annotations

from catalog.frames import (
    LABELLED,
    LABELLED_COLUMNS,
    OPEN_ORDERS,
    PART_NAMES,
    labelled,
    missing_sum,
    open_orders,
    part_names,
    table,
)
from catalog.profiles import ORDER_COLUMNS, outliers_sql
from catalog.registry import query
from tabgauge.plans.health import (
    health_facts,
    health_score,
    integrity_score,
    quality_report,
    recommendations,
    report_health_score,
    report_recommendations,
    scan_stages,
    severity_labels,
)

DOCUMENT_COLUMNS = ["text", "lang", "source", "n_chars"]
DOCUMENTS = """(SELECT "text", lang, source, n_chars FROM documents)"""


def documents(spark, sf_dir):
    """Documents without their key, so that copies show."""
    return table(spark, sf_dir, "documents").drop("doc_id")


def facts_sql(source: str, columns: list[str], numbers: list[str]) -> str:
    outliers = f"(SELECT sum(outliers) FROM ({outliers_sql(source, numbers)}) AS o)" if numbers else "0"
    listed = ", ".join(f'"{c}"' for c in columns)
    quoted = [f'"{c}"' for c in columns]
    return f"""(SELECT "rows", cells, missing, duplicates, outliers,
    missing * 100.0 / cells AS missing_pct, duplicates * 100.0 / "rows" AS duplicate_pct,
    outliers * 100.0 / "rows" AS outlier_pct FROM (
    SELECT count(*) AS "rows", count(*) * {len(columns)} AS cells,
    {missing_sum(quoted)} AS missing,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {source} AS d) AS u) AS duplicates,
    CAST({outliers} AS BIGINT) AS outliers FROM {source} AS t) AS c)"""


DOCUMENT_FACTS = facts_sql(DOCUMENTS, DOCUMENT_COLUMNS, ["n_chars"])
ORDER_FACTS = facts_sql(OPEN_ORDERS, ORDER_COLUMNS, ["o_orderkey", "o_totalprice", "o_custkey"])
LABELLED_FACTS = facts_sql(LABELLED, LABELLED_COLUMNS, ["doc_id", "n_chars", "quality", "toxic"])
PART_FACTS = facts_sql(PART_NAMES, ["p_name", "p_brand", "p_type"], [])

SCORE = """greatest(0.0, 100 - least(missing_pct * 2, 30) - least(duplicate_pct * 1.5, 20)
    - least(outlier_pct * 0.5, 15))"""
SHORT_SCORE = "greatest(0.0, 100 - least(missing_pct * 2, 30) - least(duplicate_pct * 1.5, 20))"
PCT = dict(missing_pct=4, duplicate_pct=4, outlier_pct=4)


@query("health_facts", f"SELECT * FROM {DOCUMENT_FACTS} AS f", **PCT)
def _health_facts(spark, sf_dir):
    return health_facts(documents(spark, sf_dir))


def _health_sql(facts: str) -> str:
    return f"""SELECT missing_pct, duplicates, outliers, {SCORE} AS score,
    CASE WHEN {SCORE} >= 80 THEN 'Excellent' WHEN {SCORE} >= 60 THEN 'Good' ELSE 'Needs Fixing' END
    AS grade FROM {facts} AS f"""


@query("health_score", _health_sql(DOCUMENT_FACTS), missing_pct=4, score=4)
def _health_score(spark, sf_dir):
    return health_score(documents(spark, sf_dir))


@query("health_score_gaps", _health_sql(LABELLED_FACTS), missing_pct=4, score=4)
def _health_score_gaps(spark, sf_dir):
    return health_score(labelled(spark, sf_dir))


@query(
    "report_health_score",
    f"""SELECT "rows", missing_pct, duplicates, {SHORT_SCORE} AS score,
    CASE WHEN {SHORT_SCORE} >= 80 THEN 'Excellent' WHEN {SHORT_SCORE} >= 60 THEN 'Good'
    ELSE 'Needs Work' END AS grade,
    CASE WHEN {SHORT_SCORE} >= 80 THEN 'High' WHEN {SHORT_SCORE} >= 60 THEN 'Medium'
    ELSE 'Low' END AS integrity FROM {PART_FACTS} AS f""",
    missing_pct=4,
    score=4,
)
def _report_health_score(spark, sf_dir):
    return report_health_score(part_names(spark, sf_dir))


@query(
    "integrity_score",
    f"""SELECT s AS score, CASE WHEN s > 95 THEN 'Excellent' WHEN s > 80 THEN 'Fair'
    ELSE 'Poor' END AS status FROM (
    SELECT greatest(0.0, 100 - 2 * missing_pct) AS s FROM {ORDER_FACTS} AS f) AS t""",
    score=4,
)
def _integrity_score(spark, sf_dir):
    return integrity_score(open_orders(spark, sf_dir))


@query(
    "severity_labels",
    f"""SELECT CASE WHEN missing_pct < 1 THEN 'Great' WHEN missing_pct < 5 THEN 'Acceptable'
    ELSE 'High' END AS missing,
    CASE WHEN duplicate_pct < 0.1 THEN 'Clean' WHEN duplicate_pct < 1 THEN 'Minor' ELSE 'Review' END
    AS duplicates,
    CASE WHEN outliers < "rows" * 0.01 THEN 'Normal' WHEN outliers < "rows" * 0.05 THEN 'Moderate'
    ELSE 'Many' END AS outliers FROM {DOCUMENT_FACTS} AS f""",
)
def _severity_labels(spark, sf_dir):
    return severity_labels(documents(spark, sf_dir))


@query(
    "recommendations",
    f"""WITH f AS (SELECT * FROM {LABELLED_FACTS} AS x)
    SELECT 1 AS step, 'missing' AS rule, missing_pct AS amount, 'fill the missing values' AS detail
    FROM f WHERE missing_pct > 5
    UNION ALL SELECT 2, 'duplicates', duplicates, 'remove the duplicate rows' FROM f WHERE duplicates > 0
    UNION ALL SELECT 3, 'outliers', outliers, 'inspect the outliers column by column' FROM f
    WHERE outliers > "rows" * 0.05""",
    amount=4,
)
def _recommendations(spark, sf_dir):
    return recommendations(labelled(spark, sf_dir))


@query(
    "report_recommendations",
    f"""WITH f AS (SELECT * FROM {ORDER_FACTS} AS x)
    SELECT 1 AS step, 'quality' AS rule, missing_pct AS amount, 'address missing data' AS detail
    FROM f WHERE missing_pct > 5
    UNION ALL SELECT 2, 'cleaning', duplicates, 'remove duplicate records' FROM f WHERE duplicates > 0
    UNION ALL SELECT 3, 'monitoring', NULL, 'track o_orderkey' FROM f""",
    amount=4,
)
def _report_recommendations(spark, sf_dir):
    return report_recommendations(open_orders(spark, sf_dir))


@query(
    "scan_stages",
    f"""WITH f AS (SELECT *, "rows" > 0 AND missing < "rows" * 0.1 AND duplicates < "rows" * 0.5 AS ok
        FROM {DOCUMENT_FACTS} AS x),
    z AS (SELECT count(*) FILTER (abs((n_chars - m) / nullif(s, 0)) > 3) AS n FROM documents,
        (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) AS g)
    SELECT 1 AS stage, 'rows' AS name, "rows" AS amount, 'Read' AS status FROM f
    UNION ALL SELECT 2, 'structure', 4, 'Valid (1 Num, 3 Cat)'
    UNION ALL SELECT 3, 'missing', missing, CASE WHEN missing = 0 THEN 'PASSED' ELSE 'WARNING' END FROM f
    UNION ALL SELECT 4, 'duplicates', duplicates,
        CASE WHEN duplicates = 0 THEN 'PASSED' ELSE 'NOTICE' END FROM f
    UNION ALL SELECT 5, 'statistics', n, CASE WHEN n > 0 THEN 'Detected' ELSE 'Stable' END FROM z
    UNION ALL SELECT 6, 'correlation', 1, 'No pairs'
    UNION ALL SELECT 7, 'decision', CAST(ok AS BIGINT), CASE WHEN ok THEN 'GOOD' ELSE 'CRITICAL' END FROM f""",
)
def _scan_stages(spark, sf_dir):
    return scan_stages(documents(spark, sf_dir))


@query(
    "quality_report",
    f"""WITH f AS (SELECT * FROM {ORDER_FACTS} AS x)
    SELECT 0 AS line, 'DATA QUALITY REPORT' AS "text"
    UNION ALL SELECT 1, 'Health Score: ' || CAST(CAST(round({SCORE}, 0) AS BIGINT) AS VARCHAR) || '/100' FROM f
    UNION ALL SELECT 2, 'Records: ' || CAST("rows" AS VARCHAR) || ' | Columns: 6' FROM f
    UNION ALL SELECT 3, 'Missing: ' || printf('%.2f', missing_pct) || '% | Duplicates: '
        || CAST(duplicates AS VARCHAR) || ' | Outliers: ' || CAST(outliers AS VARCHAR) FROM f
    UNION ALL SELECT 4, 'Recommendations:'
    UNION ALL SELECT 10, '- No issues detected' FROM f
        WHERE missing_pct <= 5 AND duplicates = 0 AND outliers <= "rows" * 0.05
    UNION ALL SELECT 11, '- fill the missing values' FROM f WHERE missing_pct > 5
    UNION ALL SELECT 12, '- remove the duplicate rows' FROM f WHERE duplicates > 0
    UNION ALL SELECT 13, '- inspect the outliers column by column' FROM f WHERE outliers > "rows" * 0.05""",
)
def _quality_report(spark, sf_dir):
    return quality_report(open_orders(spark, sf_dir))
