"""Sequential fences found together, against taking one column after the other."""

import numpy as np
import pytest

from tabgauge.operators import quantiles, survival
from tabgauge.operators.clean import remove_all_outliers
from tabgauge.operators.quantiles import Fences
from tabgauge.operators.survival import sequential_fences


def columns(seed, n=6000):
    """Columns whose outliers move each other's fences; gaps, repeats, a constant."""
    rng = np.random.default_rng(seed)
    base = rng.standard_t(2, size=n)
    heavy = np.where(rng.random(n) < 0.1, base * 20, rng.normal(size=n))
    made = {
        "base": base,
        "follows": base * 3 + heavy,
        "heavy": heavy,
        "few": np.round(base * 2),
        "zero": np.where(rng.random(n) < 0.7, 0.0, rng.exponential(size=n) ** 3),
        "constant": np.full(n, 2.5),
        "gaps": np.where(rng.random(n) < 0.3, np.nan, np.exp(heavy / 10)),
    }
    return made


def frame(spark, made):
    rows = zip(*[[None if np.isnan(v) else float(v) for v in c] for c in made.values()])
    return spark.createDataFrame(list(rows), ", ".join(f"{c} double" for c in made)).repartition(4)


def one_by_one(made, names):
    left, found = np.ones(len(made["base"]), bool), []
    for name in names:
        v = made[name][left]
        v = v[~np.isnan(v)]
        fences = Fences(*map(float, np.quantile(v, [0.25, 0.75]))) if len(v) else Fences(None, None)
        found.append((name, fences))
        if fences.low is not None:
            with np.errstate(invalid="ignore"):
                left &= np.isnan(made[name]) | (
                    (made[name] >= fences.low) & (made[name] <= fences.high)
                )
    return found, left


def check(got, wanted):
    assert [name for name, _ in got] == [name for name, _ in wanted]
    for (name, a), (_, b) in zip(got, wanted):
        assert (a.q1, a.q3) == (pytest.approx(b.q1, rel=1e-12), pytest.approx(b.q3, rel=1e-12)), name


@pytest.mark.parametrize("seed,k,kept", [(1, 4096, 100_000), (2, 400, 100_000), (3, 400, 0)])
def test_as_one_column_after_the_other(spark, seed, k, kept):
    made = columns(seed)
    names = [*made, "base", "heavy"]
    wanted, left = one_by_one(made, names)
    df = frame(spark, made)
    check(sequential_fences(df, names, k=k, kept_rows=kept), wanted)
    assert remove_all_outliers(df, names, k=k, kept_rows=kept).count() == int(left.sum())


def test_source_scans_do_not_grow_with_the_columns(spark, monkeypatch):
    scans, kept = [], []

    def counted(*args, **options):
        scans.append(args)
        return quantiles.gathered(*args, **options)

    class Few(survival._Few):
        def __init__(self, rows):
            kept.append(rows.count())
            super().__init__(rows)

    monkeypatch.setattr(survival, "gathered", counted)
    monkeypatch.setattr(survival, "_Few", Few)
    made = columns(4)
    df = frame(spark, made)
    for names in (["base"], ["base", "heavy", "gaps"], [*made, *made]):
        scans.clear()
        found = sequential_fences(df, names)
        assert len(found) == len(names) and len(scans) <= 1 + survival.ROUNDS
    # Most rows are told apart without a second look.
    assert max(kept) < 0.35 * len(made["base"])


def test_a_bracket_that_misses_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(survival, "error_of", lambda k: -0.01)
    made = columns(5, 3000)
    names = ["base", "heavy", "follows"]
    check(sequential_fences(frame(spark, made), names, k=400), one_by_one(made, names)[0])


def test_odd_tables(spark, empty):
    assert sequential_fences(empty, ["a", "n"]) == [("a", Fences(None, None)), ("n", Fences(None, None))]
    assert sequential_fences(empty, []) == []
    rows = [(None, 1.0), (None, float("nan")), (None, 3.0), (None, 1e9)] * 5
    df = spark.createDataFrame(rows, "a double, b double")
    (_, first), (_, second) = sequential_fences(df, ["a", "b"])
    assert first == Fences(None, None) and second.q1 == 1.0
    infinite = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (3.0,)] * 4, "x double")
    assert remove_all_outliers(infinite).count() in (12, 16)
    large = spark.createDataFrame([(2**62 + i,) for i in range(50)] + [(0,)], "x bigint")
    assert remove_all_outliers(large).count() == 50
