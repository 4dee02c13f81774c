"""Duplicates, gaps, outliers and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import (
    LABELLED,
    OPEN_ORDERS,
    PART_NAMES,
    QUIET_EVENTS,
    fences,
    labelled,
    open_orders,
    part_names,
    quiet_events,
    table,
)
from catalog.registry import query
from tabgauge.operators.clean import (
    apply_edits,
    fill_mean,
    fill_missing,
    fill_mode,
    filled_cells,
    remove_all_outliers,
    remove_duplicates,
    remove_outliers,
)
from tabgauge.session import scratch_path
from tabgauge.sources.edits import edit_table


@query("remove_duplicates", f"SELECT DISTINCT * FROM {PART_NAMES} AS t")
def _remove_duplicates(spark, sf_dir):
    return remove_duplicates(part_names(spark, sf_dir))


@query(
    "remove_duplicate_documents",
    """SELECT DISTINCT "text", lang, source, n_chars FROM documents""",
)
def _remove_duplicate_documents(spark, sf_dir):
    return remove_duplicates(table(spark, sf_dir, "documents").drop("doc_id"))


MODE = """(SELECT {c} FROM {t} AS m WHERE {c} IS NOT NULL GROUP BY {c}
    ORDER BY count(*) DESC, {c} LIMIT 1)"""


@query(
    "fill_missing",
    f"""SELECT o_orderkey, o_orderstatus,
    coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {OPEN_ORDERS} AS a)) AS o_totalprice,
    coalesce(o_orderpriority, {MODE.format(c='o_orderpriority', t=OPEN_ORDERS)}) AS o_orderpriority,
    o_orderdate,
    coalesce(CAST(o_custkey AS DOUBLE), (SELECT avg(o_custkey) FROM {OPEN_ORDERS} AS b)) AS o_custkey
    FROM {OPEN_ORDERS} AS t""",
    o_totalprice=2,
    o_custkey=4,
)
def _fill_missing(spark, sf_dir):
    return fill_missing(open_orders(spark, sf_dir))


@query(
    "filled_cells",
    f"""SELECT 3 * count(*) - count(o_totalprice) - count(o_orderpriority) - count(o_custkey)
    AS filled FROM {OPEN_ORDERS} AS t""",
)
def _filled_cells(spark, sf_dir):
    return filled_cells(open_orders(spark, sf_dir))


@query(
    "fill_mean",
    f"""SELECT doc_id, lang, source, n_chars, coalesce(CAST(quality AS DOUBLE),
    (SELECT avg(quality) FROM labels)) AS quality, toxic FROM {LABELLED} AS t""",
    quality=4,
)
def _fill_mean(spark, sf_dir):
    return fill_mean(labelled(spark, sf_dir), "quality")


@query(
    "fill_mode",
    f"""SELECT o_orderkey, o_orderstatus, o_totalprice,
    coalesce(o_orderpriority, {MODE.format(c='o_orderpriority', t=OPEN_ORDERS)}) AS o_orderpriority,
    o_orderdate, o_custkey FROM {OPEN_ORDERS} AS t""",
)
def _fill_mode(spark, sf_dir):
    return fill_mode(open_orders(spark, sf_dir), "o_orderpriority")


@query(
    "remove_outliers",
    f"""SELECT t.* FROM {LABELLED} AS t, {fences(LABELLED, 'n_chars')} AS f
    WHERE n_chars IS NULL OR n_chars BETWEEN low AND high""",
)
def _remove_outliers(spark, sf_dir):
    return remove_outliers(labelled(spark, sf_dir), "n_chars")


@query(
    "remove_outliers_gaps",
    f"""SELECT t.* FROM {QUIET_EVENTS} AS t, {fences(QUIET_EVENTS, 'value')} AS f
    WHERE value IS NULL OR value BETWEEN low AND high""",
)
def _remove_outliers_gaps(spark, sf_dir):
    return remove_outliers(quiet_events(spark, sf_dir), "value")


@query(
    "remove_all_outliers",
    f"""WITH a AS (SELECT t.* FROM events AS t, {fences('events', 'event_id')} AS f
        WHERE event_id BETWEEN low AND high),
    b AS (SELECT t.* FROM a AS t, {fences('a', 'user_id')} AS f WHERE user_id BETWEEN low AND high)
    SELECT t.* FROM b AS t, {fences('b', 'value')} AS f WHERE value BETWEEN low AND high""",
)
def _remove_all_outliers(spark, sf_dir):
    return remove_all_outliers(table(spark, sf_dir, "events"))


@query(
    "remove_all_outliers_again",
    f"""WITH a AS (SELECT t.* FROM documents AS t, {fences('documents', 'n_chars')} AS f
        WHERE n_chars BETWEEN low AND high),
    b AS (SELECT t.* FROM a AS t, {fences('a', 'doc_id')} AS f WHERE doc_id BETWEEN low AND high)
    SELECT t.* FROM b AS t, {fences('b', 'n_chars')} AS f WHERE n_chars BETWEEN low AND high""",
)
def _remove_all_outliers_again(spark, sf_dir):
    """The same column twice: its fences move once its outliers are gone."""
    return remove_all_outliers(
        table(spark, sf_dir, "documents"), ["n_chars", "doc_id", "n_chars"]
    )


EDITS = """(SELECT o_orderkey, round(o_totalprice + 100, 2) AS new_price,
    o_orderpriority = '5-LOW' AS deleted FROM orders WHERE o_orderstatus = 'P')"""


@query(
    "apply_edits",
    f"""SELECT o.o_orderkey, o_custkey, o_orderstatus,
        coalesce(new_price, o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders o LEFT JOIN {EDITS} AS e ON o.o_orderkey = e.o_orderkey
    WHERE coalesce(NOT deleted, true)
    UNION ALL
    SELECT -1 - o_orderkey, NULL, NULL, round(o_totalprice + 100, 2), NULL, NULL
    FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""",
    o_totalprice=2,
)
def _apply_edits(spark, sf_dir):
    """Pending orders are repriced, the low ones deleted, the urgent ones added anew."""
    orders = table(spark, sf_dir, "orders")
    pending = orders.where(F.col("o_orderstatus") == "P")
    price = F.round(F.col("o_totalprice") + 100, 2).alias("o_totalprice")
    changed = pending.select(
        "o_orderkey", price, (F.col("o_orderpriority") == "5-LOW").alias("deleted")
    )
    new = pending.where(F.col("o_orderpriority") == "1-URGENT").select(
        (-1 - F.col("o_orderkey")).alias("o_orderkey"), price, F.lit(False).alias("deleted")
    )
    return apply_edits(orders, changed.unionByName(new), ["o_orderkey"])


EDITS_OF_A_YEAR = f"""(SELECT e.* FROM {EDITS} AS e JOIN orders o ON o.o_orderkey = e.o_orderkey
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')"""


@query(
    "edit_table",
    f"""SELECT o.o_orderkey, o_custkey, o_orderstatus,
        coalesce(new_price, o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders o LEFT JOIN {EDITS_OF_A_YEAR} AS e ON o.o_orderkey = e.o_orderkey
    WHERE coalesce(NOT deleted, true)""",
    o_totalprice=2,
)
def _edit_table(spark, sf_dir):
    """Orders stored by date; one year's pending orders are repriced or deleted in their files."""
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark)
    orders.repartitionByRange(16, "o_orderdate").write.parquet(path)
    pending = orders.where((F.col("o_orderstatus") == "P") & (F.year("o_orderdate") == 1997))
    edits = pending.select(
        "o_orderkey",
        F.round(F.col("o_totalprice") + 100, 2).alias("o_totalprice"),
        (F.col("o_orderpriority") == "5-LOW").alias("deleted"),
    )
    edit_table(spark, path, edits, ["o_orderkey"])
    return spark.read.parquet(path)
