"""Fences of columns one after the other, in a number of scans that no column adds to.

The fences of a column come from the rows that all columns before it have left, so taken
literally each column waits for the one before. Here one scan sketches all columns as they
are, which gives a first guess at all fences. Each of the next few scans sketches every
column over the rows inside the guessed fences of the columns before it, and all guesses
improve together. The last one turns into brackets: ranges for the quartiles, and with them
for the fences. For the columns so far a row is then surely in, surely out, or undecided.

- One scan counts, for all columns, the sure rows below and at the borders of the brackets.
- One scan keeps the other rows: those undecided somewhere, and those whose value lies
  strictly inside a bracket they count for.

From the counts and the kept rows the quartiles follow exactly, column by column, and the
source is not read again. Values that repeat at a border are counted and not kept. Should a
quartile or a fence turn out to lie outside its bracket, the columns from there on start anew
on the rows left, so a guess that is off costs scans, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import sql_double
from tabgauge.operators.quantiles import (
    KEEP,
    Cell,
    Fences,
    close_in,
    find_fences,
    neighbours,
    number,
    within_fences,
)
from tabgauge.operators.sketches import SKETCH, error_of, gathered, quantiles_of
from tabgauge.session import remove_path, scratch_path

QUARTILES = (0.25, 0.75)
# Shares of the ranks at which a sketch is read.
GRID = 500
# Scans that improve the first guess, at most.
ROUNDS = 4
# Kept rows that are taken to the driver; more are worked on as a table.
KEPT_ROWS = 100_000
INF = math.inf


@dataclass
class _Bracket:
    """Ranges that hold the quartiles of a column, likely, and the fences they allow."""

    first: tuple[float, float]
    third: tuple[float, float]

    @property
    def ranges(self) -> tuple[tuple[float, float], tuple[float, float]]:
        return self.first, self.third

    @property
    def widest(self) -> Fences:
        """Everything outside is surely out."""
        return self._of(self.first[0], self.third[1], -INF, INF)

    @property
    def narrowest(self) -> Fences:
        """Everything inside is surely in."""
        return self._of(self.first[1], self.third[0], INF, -INF)

    def _of(self, q1: float, q3: float, low: float, high: float) -> tuple[float, float]:
        fences = Fences(q1, q3)
        if math.isfinite(q1) and math.isfinite(q3) and math.isfinite(fences.low + fences.high):
            return fences.low, fences.high
        return low, high


def _place(grid: np.ndarray, value: float) -> float:
    """The share of the values up to this one; the middle of it where the value repeats."""
    first, last = np.searchsorted(grid, value, side="left"), np.searchsorted(grid, value, side="right")
    return (first + last) / 2 / (GRID + 1)


def _moved(grid: np.ndarray | None, guess: Fences) -> float:
    """By how much of the ranks the last guess at the quartiles was off."""
    if grid is None or guess.q1 is None:
        return 0.0
    found = 0.0
    for p, value in zip(QUARTILES, (guess.q1, guess.q3)):
        if value != grid[round(p * GRID)]:
            found = max(found, abs(_place(grid, value) - p))
    return found


def _bracket(grid: np.ndarray | None, n: int, slack: float) -> _Bracket:
    """The quartiles' ranges, from the grid of a sketch of ``n`` values."""
    if grid is None:
        return _Bracket((-INF, INF), (-INF, INF))
    ranges = []
    for p in QUARTILES:
        low = max(math.floor((p * (n - 1) / n - slack) * GRID), 0)
        high = min(math.ceil(((p * (n - 1) + 2) / n + slack) * GRID), GRID)
        ranges.append((float(grid[low]), float(grid[high])))
    return _Bracket(*ranges)


def _guess(grid: np.ndarray | None) -> Fences:
    if grid is None:
        return Fences(None, None)
    return Fences(*[float(grid[round(p * GRID)]) for p in QUARTILES])


def _grids(spark, row, names: list[str]) -> list[np.ndarray | None]:
    shares = [i / GRID for i in range(GRID + 1)]
    filled = [c for c in names if row[f"n:{c}"]]
    read = quantiles_of(spark, [(row[f"s:{c}"], shares) for c in filled])
    found = dict(zip(filled, map(np.array, read)))
    return [found.get(c) for c in names]


def _first_of(tests: list[str], otherwise: int) -> Column:
    """The place of the first test that holds."""
    cases = " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(tests))
    return F.expr(f"CASE {cases} ELSE {otherwise} END")


def _staged(data: DataFrame, brackets: list[_Bracket]) -> DataFrame:
    """``alive``: the first column for which a row is not surely in; ``gone``: the first one
    for which it is surely out. Equal for rows that are sure."""
    unsure, out = [], []
    for i, b in enumerate(brackets):
        (low, high), (lowest, highest) = b.narrowest, b.widest
        unsure.append(f"(c{i} < {sql_double(low)} OR c{i} > {sql_double(high)})")
        out.append(f"(c{i} < {sql_double(lowest)} OR c{i} > {sql_double(highest)})")
    k = len(brackets)
    return data.select("*", _first_of(unsure, k).alias("alive"), _first_of(out, k).alias("gone"))


def _sketched(data: DataFrame, guesses: list[Fences] | None, k: int):
    """Per column the grid of its values, and their number, over the rows inside the guessed
    fences of the columns before it; one scan."""
    names = data.columns
    if guesses:
        out = [
            "false" if g.low is None else
            f"(c{i} < {sql_double(g.low)} OR c{i} > {sql_double(g.high)})"
            for i, g in enumerate(guesses)
        ]
        staged = data.select("*", _first_of(out, len(names)).alias("alive"))
        data = staged.select(
            *[F.expr(f"CASE WHEN alive >= {i} THEN {c} END").alias(c) for i, c in enumerate(names)]
        )
    row = gathered(data, names, k=k).first()
    return _grids(data.sparkSession, row, names), [row[f"n:{c}"] for c in names]


# What is counted per column: all values, then per quartile those below the low border, up to
# it, below the high one, and up to that.
COUNTS = 9


def _tests(column: str, bracket: _Bracket) -> list[str]:
    tests = [f"{column} IS NOT NULL"]
    for border in (*bracket.first, *bracket.third):
        tests += [f"{column} < {sql_double(border)}", f"{column} <= {sql_double(border)}"]
    return tests


def _sums(tests: Sequence[str]) -> list[Column]:
    return [
        F.expr(f"coalesce(sum(CASE WHEN {t} THEN 1L ELSE 0L END), 0L)").alias(str(i))
        for i, t in enumerate(tests)
    ]


class _Few:
    """Kept rows, few enough to be worked on here."""

    def __init__(self, rows: DataFrame):
        # A missing value is NaN here.
        taken = rows.toArrow()
        self.columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in taken.columns]
        self.left = np.ones(taken.num_rows, bool)

    def counts(self, i: int, bracket: _Bracket) -> list[int]:
        v = self.columns[i][self.left & ~np.isnan(self.columns[i])]
        found = [len(v)]
        for border in (*bracket.first, *bracket.third):
            found += [int((v < border).sum()), int((v <= border).sum())]
        return found

    def pick(self, i: int, limits: tuple[float, float], places: list[int], counts) -> list[float]:
        v = self.columns[i][self.left]
        v = np.sort(v[(v > limits[0]) & (v < limits[1])])
        return [float(v[place]) for place in places]

    def remove(self, i: int, fences: Fences) -> None:
        v = self.columns[i]
        self.left &= np.isnan(v) | ((v >= fences.low) & (v <= fences.high))


class _Many:
    """Kept rows as a table."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def counts(self, i: int, bracket: _Bracket) -> list[int]:
        return list(self.rows.agg(*_sums(_tests(f"c{i}", bracket))).first())

    def pick(self, i: int, limits: tuple[float, float], places: list[int], counts) -> list[float]:
        under, upto = counts
        found: dict = {}
        ranks = [under + place for place in places]
        cell = Cell(f"c{i}", *limits, under, upto - under, list(ranks))
        close_in(self.rows, [cell], found, SKETCH, KEEP)
        return [found[cell.name, r] for r in ranks]

    def remove(self, i: int, fences: Fences) -> None:
        v = F.col(f"c{i}")
        self.rows = self.rows.where(v.isNull() | ((v >= fences.low) & (v <= fences.high)))


def _quartiles(i: int, bracket: _Bracket, sure: list[int], kept: _Few | _Many) -> Fences | None:
    """The fences of a column from counts and kept rows; None if a bracket missed."""
    own = kept.counts(i, bracket)
    total = [a + b for a, b in zip(sure, own)]
    n, found = total[0], []
    if not n:
        return Fences(None, None)
    for place, (p, limits) in enumerate(zip(QUARTILES, (bracket.first, bracket.third))):
        at = 1 + 4 * place
        under_low, upto_low, under_high, upto_high = total[at : at + 4]
        ranks = neighbours(n, p)
        if ranks[0] < under_low or ranks[1] >= upto_high:
            return None
        values = {r: limits[0] if r < upto_low else limits[1] for r in ranks}
        # All values strictly inside are among the kept rows.
        inner = [r for r in dict.fromkeys(ranks) if upto_low <= r < under_high]
        if inner:
            places = [r - upto_low for r in inner]
            picked = kept.pick(i, limits, places, (own[at + 1], own[at + 2]))
            values.update(zip(inner, picked))
        a, b = values[ranks[0]], values[ranks[1]]
        found.append(a if a == b else a + ((n - 1) * p - ranks[0]) * (b - a))
    return Fences(*found)


def _allowed(fences: Fences, bracket: _Bracket) -> bool:
    """Whether the rows called sure were so."""
    if fences.low is None:
        return True
    (lowest, highest), (low, high) = bracket.widest, bracket.narrowest
    finite = math.isfinite(fences.low) and math.isfinite(fences.high)
    return finite and lowest <= fences.low <= low and high <= fences.high <= highest


def sequential_fences(
    df: DataFrame,
    columns: Sequence[str],
    k: int = SKETCH,
    rounds: int = ROUNDS,
    kept_rows: int = KEPT_ROWS,
) -> list[tuple[str, Fences]]:
    """The fences of each column among the rows inside the fences of all columns before it.

    Rows missing a value stay. The source is read ``rounds + 3`` times at most. Up to ``kept_rows``
    kept rows are finished on the driver, more of them as a table, by the same steps.
    """
    names = list(columns)
    if not names:
        return []
    data = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    cells = data.columns
    grids, sizes = _sketched(data, None, k)
    guesses, off = [_guess(g) for g in grids], np.zeros(len(names))
    # The first column has none before it, so it needs no second look.
    for _ in range(rounds if len(names) > 1 else 0):
        grids, sizes = _sketched(data, guesses, k)
        # A column is as uncertain as those before it.
        off = np.maximum.accumulate([_moved(g, last) for g, last in zip(grids, guesses)])
        guesses = [_guess(g) for g in grids]
        if off[-1] <= error_of(k):
            break
    slack = error_of(k) + 1 / GRID + off
    brackets = [_bracket(g, n, s) for g, n, s in zip(grids, sizes, slack.tolist())]

    strict = [
        f"(alive >= {i} AND c{i} > {sql_double(low)} AND c{i} < {sql_double(high)})"
        for i, b in enumerate(brackets)
        for low, high in (b.first, b.third)
        if low < high
    ]
    unsure = " OR ".join(["alive < gone", *strict])
    marked = _staged(data, brackets).select("*", F.expr(f"coalesce({unsure}, false)").alias("kept"))
    tests = [
        f"NOT kept AND alive >= {i} AND {t}"
        for i, (c, b) in enumerate(zip(cells, brackets))
        for t in _tests(c, b)
    ]
    *sure, number_kept = marked.agg(*_sums([*tests, "kept"])).first()
    path = scratch_path(df.sparkSession)
    marked.where("kept").select(*cells).write.parquet(path)
    rows = df.sparkSession.read.schema(data.schema).parquet(path)
    kept = _Few(rows) if number_kept <= kept_rows else _Many(rows)

    fences: list[tuple[str, Fences]] = []
    for i, name in enumerate(names):
        found = _quartiles(i, brackets[i], sure[i * COUNTS : (i + 1) * COUNTS], kept)
        if found is None or not _allowed(found, brackets[i]):
            # Anew from here, on the rows left; this column by itself.
            rest = within_fences(df, fences)
            fences.append((name, find_fences(rest, [name])[name]))
            rest = within_fences(rest, fences[-1:])
            fences += sequential_fences(rest, names[i + 1 :], k, rounds, kept_rows)
            break
        fences.append((name, found))
        if found.low is not None:
            kept.remove(i, found)
    remove_path(df.sparkSession, path)
    return fences
