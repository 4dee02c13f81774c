"""Pearson correlation of column pairs, over the rows where both are present.

One aggregate finds means, extremes and gaps. One scan then adds up the Gram matrix of a
vector per row. The vector holds the centred values, 0 where missing, and a 1; if there are
gaps, also their squares, and for each column with gaps whether it is there. Every sum that a
pair needs over the rows where both are present is an entry of that matrix, so tables of any
width take the same two scans. The few entries of a narrow table are so many sums of one
aggregate; for a wide one Spark's row matrix adds blocks in the JVM and merges them in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import grade_above
from tabgauge.functions.rules import R_HIGH, R_STRONG, R_VERY_HIGH, R_VERY_STRONG
from tabgauge.operators.quantiles import number
from tabgauge.operators.roles import numeric_columns

NO_VARIANCE = 1e-13
# Entries of the matrix that share one aggregate, whose compiled code grows with them.
ENTRIES = 128


class Sums:
    """Sums over the rows where both columns of a pair are present."""

    def __init__(self, df: DataFrame, names: list[str], entries: int = ENTRIES):
        data = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(names)])
        facts = data.agg(
            F.count(F.lit(1)).alias("rows"),
            *[
                f(F.col(f"c{i}")).alias(f"{tag}{i}")
                for i in range(len(names))
                for tag, f in (("m", F.avg), ("a", F.min), ("b", F.max), ("n", F.count))
            ],
        ).first()
        width = range(len(names))
        self.constant = [facts[f"a{i}"] == facts[f"b{i}"] for i in width]
        gaps = [i for i in width if facts[f"n{i}"] < facts["rows"]]
        # Places in the vector: values, squares if there are gaps, who is there, and the 1.
        squares = len(names) if gaps else 0
        self.square = [i + squares for i in width]
        self.there = {i: len(names) + squares + at for at, i in enumerate(gaps)}
        self.one = one = len(names) + squares + len(gaps)
        self.gram = np.zeros((one + 1, one + 1))
        if not facts["rows"] or len(names) < 2:
            return
        zero = F.lit(0.0)
        moved = [F.col(f"c{i}") - F.lit(facts[f"m{i}"] or 0.0) for i in width]
        parts = [F.coalesce(m, zero).alias(f"x{i}") for i, m in enumerate(moved)]
        if gaps:
            parts += [F.coalesce(m * m, zero).alias(f"q{i}") for i, m in enumerate(moved)]
        parts += [F.col(f"c{i}").isNotNull().cast("double").alias(f"t{i}") for i in gaps]
        parts.append(F.lit(1.0).alias("one"))
        wide = data.select(*parts)
        size = one + 1
        if size * (size + 1) // 2 <= entries:
            a, b = np.triu_indices(size)
            named = [F.col(c) for c in wide.columns]
            sums = wide.agg(*[F.sum(named[i] * named[j]).alias(f"{i}_{j}") for i, j in zip(a, b)])
            self.gram[a, b] = self.gram[b, a] = list(sums.first())
        else:
            rows = VectorAssembler(inputCols=wide.columns, outputCol="row", handleInvalid="keep")
            vectors = MLUtils.convertVectorColumnsFromML(rows.transform(wide).select("row"), "row")
            self.gram = RowMatrix(vectors, 0, size).computeGramianMatrix().toArray()

    def correlation(self, i: int, j: int) -> float | None:
        """r of a pair; None where one of them is constant."""
        if self.constant[i] or self.constant[j]:
            return None
        g, one = self.gram, self.one
        ti, tj = self.there.get(i, one), self.there.get(j, one)
        n = g[ti, tj]
        if not n:
            return None
        x, y, xy = g[i, tj], g[j, ti], g[i, j]
        # Without gaps the square of a column is its own entry.
        xx, yy = (
            g[self.square[k], t if self.there else k] for k, t in ((i, tj), (j, ti))
        )
        vx, vy = xx - x * x / n, yy - y * y / n
        # What rounding leaves of a column that does not vary here is no variance.
        if not (vx > xx * NO_VARIANCE and vy > yy * NO_VARIANCE):
            return None
        r = (xy - x * y / n) / (math.sqrt(vx) * math.sqrt(vy))
        return None if math.isnan(r) else float(max(-1.0, min(1.0, r)))


PAIRS = "i int, j int, col1 string, col2 string, r double"


def corr_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    anchor: str | None = None,
    entries: int = ENTRIES,
) -> DataFrame:
    """(i, j, col1, col2, r) for i < j; r is null where a column is constant.

    ``anchor`` pairs that one column with each of the others and nothing else. The sums are
    taken when the frame is built; it has one row per pair.
    """
    names = list(columns if columns is not None else numeric_columns(df))
    if anchor is not None:
        names = [anchor] + [c for c in names if c != anchor]
    pairs = list(combinations(range(len(names)), 2))
    if anchor is not None:
        pairs = [(i, j) for i, j in pairs if i == 0]
    sums = Sums(df, names, entries) if pairs else None
    rows = [(i, j, names[i], names[j], sums.correlation(i, j)) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, PAIRS)


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full square in long form (col1, col2, r), diagonal included."""
    names = list(columns if columns is not None else numeric_columns(df))
    rows = []
    if names:
        sums = Sums(df, names)
        for i, a in enumerate(names):
            rows.append((a, a, None if sums.constant[i] else 1.0))
            for j in range(i + 1, len(names)):
                r = sums.correlation(i, j)
                rows += [(a, names[j], r), (names[j], a, r)]
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, r double")


def high_corr_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    strength = F.abs(F.col("r"))
    return (
        corr_pairs(df, columns)
        .where(strength > R_HIGH)
        .select(
            "col1",
            "col2",
            "r",
            F.when(strength > R_VERY_HIGH, "Very High").otherwise("High").alias("issue"),
        )
    )


def strong_corr(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The strong pairs in column order."""
    return (
        corr_pairs(df, columns)
        .where(F.abs(F.col("r")) > R_STRONG)
        .orderBy("i", "j")
        .select("i", "j", "col1", "col2", "r")
    )


def _strongest(pairs: DataFrame) -> DataFrame:
    """One row: the largest absolute r, the first pair on ties; r null if none."""
    filled = F.when(
        F.col("r").isNotNull(),
        F.struct((-F.abs(F.col("r"))).alias("weakness"), "i", "j", "col1", "col2", "r"),
    )
    best = F.min(filled)
    return pairs.agg(
        best["col1"].alias("col1"), best["col2"].alias("col2"), best["r"].alias("r")
    )


def strongest_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The most correlated pair, its direction and how strongly it is linked."""
    best = _strongest(corr_pairs(df, columns))
    strength = F.coalesce(F.abs(F.col("r")), F.lit(0.0))
    return best.select(
        "col1",
        "col2",
        "r",
        strength.alias("strength"),
        F.when(F.col("r") > 0, "rising together")
        .when(F.col("r").isNotNull(), "one falling as the other rises")
        .alias("direction"),
        grade_above(
            F.abs(F.col("r")),
            [(R_VERY_STRONG, "tight"), (R_STRONG, "clear")],
            "loose",
        ).alias("link"),
    )


def report_relationship(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The strongest pair, only where it is above 0.5."""
    best = _strongest(corr_pairs(df, columns)).where(F.abs(F.col("r")) > R_STRONG)
    up = F.col("r") > 0
    return best.select(
        "col1",
        "col2",
        "r",
        F.when(up, "positive, above the limit").otherwise("negative, above the limit").alias("relation"),
        F.when(up, "both rise and fall together")
        .otherwise("one rises while the other falls")
        .alias("movement"),
    )


def likely_cause(df: DataFrame, metric: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(symptom, likely_cause, correlation): what goes most closely with a metric."""
    best = _strongest(corr_pairs(df, columns, anchor=metric)).where(
        F.abs(F.col("r")) > R_STRONG
    )
    return best.select(
        F.col("col1").alias("symptom"),
        F.col("col2").alias("likely_cause"),
        F.abs(F.col("r")).alias("correlation"),
    )


def root_cause(df: DataFrame, alerts: DataFrame, metric: str) -> DataFrame:
    """Each alert with the column that goes most closely with its metric."""
    cause = likely_cause(df, metric)
    return alerts.join(cause, alerts["metric"] == cause["symptom"]).select(
        F.col("unit").alias("alert"),
        "symptom",
        "likely_cause",
        "correlation",
        F.format_string(
            "Look into %s first: it moves with the high readings of %s.",
            "likely_cause",
            "symptom",
        ).alias("recommendation"),
    )
