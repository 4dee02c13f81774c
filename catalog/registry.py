"""Name -> Spark query and name -> DuckDB SQL, kept side by side.

Doubles are rounded alike on both sides. The nudge before rounding keeps values
that lie exactly between two steps from depending on the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NUDGE = {2: 1e-5, 4: 1e-7, 6: 1e-9, 8: 1e-11}


def query(name: str, sql: str | None = None, **places: int):
    """Register a query; keyword arguments give the places to round a column to."""

    def register(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = make(spark, sf_dir)
            return result.withColumns(
                {c: F.round(F.col(c) + NUDGE[n], n) for c, n in places.items()}
            )

        run.__name__ = name
        run.__doc__ = make.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = rounded_sql(sql, places)
        return make

    return register


def rounded_sql(sql: str, places: dict[str, int]) -> str:
    if not places:
        return sql
    kept = ", ".join(
        f'round("{c}" + {NUDGE[n]:.12f}, {n}) AS "{c}"' for c, n in places.items()
    )
    return f"SELECT * REPLACE ({kept}) FROM ({sql}) AS result"
