"""Exact quantiles of whole columns, without gathering a column anywhere.

Spark's exact ``percentile`` keeps every distinct value of the column in one
buffer, which a large table outgrows. Here a mergeable sketch brackets each wanted
order statistic in one aggregate over all columns. The next scan counts what lies
below the bracket and at its borders, and the third reads the few values inside it,
so the order statistic is read off exactly; a range that holds few values anyway is
read at once. Where even the bracket holds too many
values, they are sketched instead, and the bracket narrows again by the same factor;
values that repeat at a border are counted, never kept. All columns and ranks share
each scan, rows are not unfolded, and the driver sees borders, counts and sketches only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.expr import col, sql_double, sql_name
from tabgauge.functions.rules import FENCE_WIDTH
from tabgauge.operators.sketches import SKETCH, error_of, gathered, quantiles_of

# Values kept for one rank, and for all ranks of a scan.
KEEP = 100_000
KEEP_TOGETHER = 1_000_000


@dataclass(frozen=True)
class Fences:
    """Quartiles and Tukey fences of a column; all None for an empty column."""

    q1: float | None
    q3: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def low(self) -> float | None:
        return None if self.q1 is None else self.q1 - FENCE_WIDTH * self.iqr

    @property
    def high(self) -> float | None:
        return None if self.q1 is None else self.q3 + FENCE_WIDTH * self.iqr


@dataclass
class Cell:
    """An open value range of one column and the ranks sought inside it.

    ``below`` values come before the range; ``inside`` are in it. The ranks are likely
    between ``lo`` and ``hi``.
    """

    name: str
    low: float | None
    high: float | None
    below: int
    inside: int
    ranks: list[int]
    lo: float | None = None
    hi: float | None = None


FLOATING = (T.FloatType, T.DoubleType)


def number(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN missing."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.nanvl(bare(df, name), F.lit(None).cast("double"))
    return bare(df, name)


def bare(df: DataFrame, name: str) -> Column:
    """The column as double, left as it is where it is one so that filters push down."""
    if isinstance(df.schema[name].dataType, T.DoubleType):
        return col(name)
    return col(name).cast("double")


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def _known(df: DataFrame, name: str, test: Column) -> Column:
    """The test, null for NaN; scans still see the bare comparison."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return test & F.when(F.isnan(col(name)), F.lit(None).cast("boolean")).otherwise(True)
    return test


WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _bound(df: DataFrame, name: str, limit: float, round_to) -> tuple[Column, Column]:
    """A column and a limit to compare it with, both bare so that scans can use them.

    Whole numbers are compared with the nearest whole limit inside the fences.
    """
    if isinstance(df.schema[name].dataType, WHOLE_TYPES) and abs(limit) < 2**62:
        return col(name), F.lit(round_to(limit)).cast("bigint")
    return bare(df, name), F.lit(limit)


def above(df: DataFrame, name: str, fences: Fences) -> Column:
    """Above the upper fence; null for a missing value."""
    if fences.high is None:
        return F.lit(False)
    value, limit = _bound(df, name, fences.high, math.floor)
    return _known(df, name, value > limit)


def below(df: DataFrame, name: str, fences: Fences) -> Column:
    """Below the lower fence; never so for a missing value."""
    if fences.low is None:
        return F.lit(False)
    value, limit = _bound(df, name, fences.low, math.ceil)
    return value < limit


def outside(df: DataFrame, name: str, fences: Fences) -> Column:
    """Below or above the fences; null for a missing value."""
    if fences.high is None:
        return F.lit(False)
    value, limit = _bound(df, name, fences.high, math.floor)
    return _known(df, name, below(df, name, fences) | (value > limit))


def inside(df: DataFrame, name: str, fences: Fences) -> Column:
    """Within the fences; null for a missing value."""
    if fences.low is None:
        return F.lit(True)
    value, low = _bound(df, name, fences.low, math.ceil)
    _, high = _bound(df, name, fences.high, math.floor)
    return _known(df, name, (value >= low) & (value <= high))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    k: int = SKETCH,
    keep: int = KEEP,
    accuracy: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; None where a column is empty.

    ``k`` is the size of the sketches, 200 at least, and ``keep`` the number of values to
    keep for a rank. ``accuracy`` switches to one pass of ``percentile_approx``.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    data = df.select(*[bare(df, c).alias(c) for c in columns])
    if accuracy is not None:
        row = data.agg(
            *[
                F.percentile_approx(
                    F.nanvl(col(c), F.lit(None).cast("double")), list(probabilities), accuracy
                ).alias(str(i))
                for i, c in enumerate(columns)
            ]
        ).first()
        return {
            c: [None] * len(probabilities) if row[i] is None else list(row[i])
            for i, c in enumerate(columns)
        }

    # NaN is missing here: sketches leave it out, and so do the later scans.
    sizes = gathered(data, columns, k=k).first()
    filled = [c for c in columns if sizes[f"n:{c}"]]
    ends = quantiles_of(df.sparkSession, [(sizes[f"s:{c}"], (0.0, 1.0)) for c in filled])
    found: dict[tuple[str, int], float] = {}
    cells, sketches = [], []
    for name, (least, most) in zip(filled, ends):
        n = sizes[f"n:{name}"]
        found[name, 0], found[name, n - 1] = least, most
        for p in probabilities:
            ranks = [r for r in dict.fromkeys(neighbours(n, p)) if (name, r) not in found]
            if ranks:
                cells.append(Cell(name, None, None, 0, n, ranks))
                sketches.append(sizes[f"s:{name}"])
    large = [i for i, cell in enumerate(cells) if cell.inside > keep]
    bracket(df.sparkSession, [cells[i] for i in large], [sketches[i] for i in large], k)
    close_in(data, cells, found, k, keep)

    result: dict[str, list[float | None]] = {}
    for name in columns:
        n = sizes[f"n:{name}"]
        result[name] = []
        for p in probabilities:
            if not n:
                result[name].append(None)
                continue
            low, high = neighbours(n, p)
            a, b = found[name, low], found[name, high]
            result[name].append(a if a == b else a + ((n - 1) * p - low) * (b - a))
    return result


def neighbours(n: int, p: float) -> tuple[int, int]:
    place = (n - 1) * p
    return math.floor(place), math.ceil(place)


def bracket(spark, cells: list[Cell], sketches: list[bytes], k: int) -> None:
    """Likely borders of the ranks of each cell, from a sketch of the values in it."""
    error = error_of(k)
    shares = [
        (
            (c.ranks[0] - c.below) / c.inside - error,
            (c.ranks[-1] - c.below + 1) / c.inside + error,
        )
        for c in cells
    ]
    for cell, (lo, hi) in zip(cells, quantiles_of(spark, list(zip(sketches, shares)))):
        cell.lo, cell.hi = min(lo, hi), max(lo, hi)


def close_in(
    data: DataFrame,
    cells: list[Cell],
    found: dict[tuple[str, int], float],
    k: int,
    keep: int,
) -> None:
    """Count at the borders and look between them, until the ranks of all cells are found.

    A cell that holds few values is looked into at once."""
    while cells:
        inner = [c for c in cells if c.inside <= keep or c.lo is None]
        bordered = [c for c in cells if c.inside > keep and c.lo is not None]
        again = []
        for cell, counts in zip(bordered, _count_borders(data, bordered)):
            parts = _parts(cell, counts, found)
            inner += [c for c in parts if c.lo is None]
            again += [c for c in parts if c.lo is not None]
        cells = again + _look_inside(data, inner, found, k, keep)


def _tests(cell: Cell) -> tuple[str, str]:
    """What tells a rank between the borders: values up to the low one, and below the high
    one. Where both are one value, those below it and up to it."""
    name, lo, hi = sql_name(cell.name), sql_double(cell.lo), sql_double(cell.hi)
    first, second = ("<", "<=") if cell.lo == cell.hi else ("<=", "<")
    return f"{name} {first} {lo}", f"{name} {second} {hi}"


def _count_borders(data: DataFrame, cells: list[Cell]) -> list[tuple[int, int]]:
    """The two counts of each cell; one scan."""
    if not cells:
        return []
    different = list(dict.fromkeys(t for c in cells for t in _tests(c)))
    counts = [f"sum(CASE WHEN {t} THEN 1L ELSE 0L END)" for t in different]
    row = data.agg(*[F.expr(c).alias(str(i)) for i, c in enumerate(counts)]).first()
    counted = dict(zip(different, row))
    return [tuple(counted[t] for t in _tests(c)) for c in cells]


def _parts(cell: Cell, counts: tuple[int, int], found: dict[tuple[str, int], float]) -> list[Cell]:
    """The ranks at a border are found; the parts of the cell that hold the others."""
    first, second = counts
    name, end, one = cell.name, cell.below + cell.inside, cell.lo == cell.hi
    if one:
        low = Cell(name, cell.low, cell.lo, cell.below, first - cell.below, [])
        high = Cell(name, cell.hi, cell.high, second, end - second, [])
    else:
        # A rank that is not strictly between the borders is likely at one of them.
        low = Cell(name, cell.low, cell.high, cell.below, cell.inside, [], cell.lo, cell.lo)
        high = Cell(name, cell.low, cell.high, cell.below, cell.inside, [], cell.hi, cell.hi)
    middle = Cell(name, cell.lo, cell.hi, first, second - first, [])
    for rank in cell.ranks:
        if rank < first:
            low.ranks.append(rank)
        elif rank >= second:
            high.ranks.append(rank)
        elif one:
            found[name, rank] = cell.lo
        else:
            middle.ranks.append(rank)
    return [c for c in (low, middle, high) if c.ranks]


def _look_inside(
    data: DataFrame,
    cells: list[Cell],
    found: dict[tuple[str, int], float],
    k: int,
    keep: int,
) -> list[Cell]:
    """One scan each: values of the cells that hold few are sorted and picked from, the
    others are sketched; those come back with borders."""
    few, many, held = [], [], 0
    for cell in cells:
        shared = [c for c in few if (c.name, c.low, c.high) == (cell.name, cell.low, cell.high)]
        if shared:
            shared[0].ranks += cell.ranks
        elif cell.inside <= keep and held + cell.inside <= KEEP_TOGETHER:
            few.append(cell)
            held += cell.inside
        else:
            many.append(cell)
    if few:
        lists = [F.sort_array(F.collect_list(f"v{i}")).alias(f"v{i}") for i in range(len(few))]
        picked = [
            F.get(F.col(f"v{i}"), F.lit(rank - cell.below)).alias(f"{i}_{rank}")
            for i, cell in enumerate(few)
            for rank in dict.fromkeys(cell.ranks)
        ]
        row = _cell_values(data, few).agg(*lists).select(*picked).first()
        found.update({(c.name, r): row[f"{i}_{r}"] for i, c in enumerate(few) for r in c.ranks})
    if many:
        row = gathered(_cell_values(data, many), [f"v{i}" for i in range(len(many))], k=k).first()
        bracket(data.sparkSession, many, [row[f"s:v{i}"] for i in range(len(many))], k)
    return many


def _cell_values(data: DataFrame, cells: list[Cell]) -> DataFrame:
    """A column per cell with the values that lie in it."""
    values = [
        F.expr(f"CASE WHEN {_within(c)} THEN {sql_name(c.name)} END").alias(f"v{i}")
        for i, c in enumerate(cells)
    ]
    return data.where(" OR ".join(f"({_within(c)})" for c in cells)).select(*values)


def _within(cell: Cell) -> str:
    """Strictly inside the cell, and not NaN."""
    name = sql_name(cell.name)
    limits = []
    if cell.low is not None:
        limits.append(f"{name} > {sql_double(cell.low)}")
    limits.append(f"{name} <= {sql_double(math.inf)}")
    if cell.high is not None:
        limits[-1] = f"{name} < {sql_double(cell.high)}"
    return " AND ".join(limits)


def find_fences(
    df: DataFrame, columns: Sequence[str], **options
) -> dict[str, Fences]:
    """Quartiles and fences of several columns, found together."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.75), **options)
    return {name: Fences(q[0], q[1]) for name, q in quartiles.items()}


def within_fences(df: DataFrame, fences: Sequence[tuple[str, Fences]]) -> DataFrame:
    """The rows inside the fences of every column, or missing its value."""
    for name, limits in fences:
        if limits.low is not None:
            df = df.where(missing(df, name) | inside(df, name, limits))
    return df
