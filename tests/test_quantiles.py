import numpy as np
import pytest

from tabgauge.operators import quantiles
from tabgauge.operators.quantiles import exact_quantiles, find_fences
from tabgauge.operators.sketches import gathered

P = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def frame(spark, columns):
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in columns.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))


def samples():
    rng = np.random.default_rng(3)
    n = 600
    return {
        "normal": rng.normal(size=n),
        "few": rng.integers(0, 4, n),
        "heavy": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n) ** 8),
        "constant": np.full(n, 0.1),
        "scales": 10.0 ** rng.integers(-9, 9, n),
        "edges": np.where(rng.random(n) < 0.1, np.inf, np.where(rng.random(n) < 0.1, -np.inf, rng.random(n))),
        "signed": np.where(rng.random(n) < 0.5, 1.7e308, -1.7e308),
    }


@pytest.mark.parametrize("k, keep", [(200, 0), (200, 30), (4096, 100_000)])
def test_every_way_of_narrowing_gives_the_sorted_values(spark, k, keep):
    data = samples()
    names = [n for n in data if n != "edges"]
    df = frame(spark, {n: data[n] for n in names})
    got = exact_quantiles(df, names, P, k=k, keep=keep)
    for name in names:
        ordered = np.sort(data[name].astype(float))
        for p, q in zip(P, got[name]):
            place = (len(ordered) - 1) * p
            a, b = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            assert q == a + (place - np.floor(place)) * (b - a), (name, p)


def test_infinities_are_narrowed_too(spark):
    data = samples()["edges"]
    df = frame(spark, {"edges": data})
    got = exact_quantiles(df, ["edges"], (0.5,), k=200, keep=2)["edges"][0]
    ordered = np.sort(data)
    assert got == pytest.approx((ordered[299] + ordered[300]) / 2)


def test_missing_values_and_nan_are_left_out(spark):
    df = frame(spark, {"x": [1, None, 2, 3, 4, float("nan")]})
    assert exact_quantiles(df, ["x"], (0.25, 0.5)) == {"x": [1.75, 2.5]}


def test_empty_column_has_no_quantiles(spark, empty):
    assert exact_quantiles(empty, ["a", "n"], (0.5,)) == {"a": [None], "n": [None]}
    assert find_fences(empty, ["a"])["a"].low is None


def test_matches_pandas_on_given_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    want = df.select(*names).toPandas().quantile([0.25, 0.5, 0.75])
    got = exact_quantiles(df, names, (0.25, 0.5, 0.75), k=200, keep=50)
    for name in names:
        assert got[name] == pytest.approx(list(want[name]))


def test_approximate_quantiles_on_request(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = exact_quantiles(df, ["l_extendedprice"], (0.5,))["l_extendedprice"][0]
    near = exact_quantiles(df, ["l_extendedprice"], (0.5,), accuracy=1000)["l_extendedprice"][0]
    assert near == pytest.approx(exact, rel=0.02)


def test_infinities_and_the_largest_double_are_counted(spark):
    largest = 1.7976931348623157e308
    rows = [(largest,)] * 30 + [(float("inf"),)] * 31
    df = spark.createDataFrame(rows, "x double")
    got = exact_quantiles(df, ["x"], (0.0, 29 / 60, 0.5, 1.0), k=200, keep=5)["x"]
    assert got[0] == largest and got[2] == got[3] == float("inf")


def test_borders_that_miss_the_rank_are_mended(spark, monkeypatch):
    """A sketch may be off by more than its error; the counts show it."""
    monkeypatch.setattr(quantiles, "error_of", lambda k: -0.02)
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=9000), 2)
    df = frame(spark, {"x": values})
    ordered = np.sort(values)
    for keep in (0, 100):
        got = exact_quantiles(df, ["x"], P, k=200, keep=keep)["x"]
        for p, q in zip(P, got):
            place = (len(ordered) - 1) * p
            a, b = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            assert q == pytest.approx(a + (place - np.floor(place)) * (b - a))


@pytest.mark.parametrize("columns", [1, 6, 30])
def test_scans_do_not_grow_with_the_columns(spark, monkeypatch, columns):
    scans = []

    def counted(step):
        def run(data, cells, *args, **options):
            # Without cells nothing is read.
            scans.append(step.__name__) if cells else None
            return step(data, cells, *args, **options)

        return run

    for step in (gathered, quantiles._count_borders, quantiles._cell_values):
        monkeypatch.setattr(quantiles, step.__name__, counted(step))
    rng = np.random.default_rng(columns)
    df = frame(spark, {f"c{i}": rng.normal(size=4000) ** 3 for i in range(columns)})
    for keep, wanted in ((5000, 2), (500, 3)):
        scans.clear()
        find_fences(df, df.columns, k=400, keep=keep)
        assert len(scans) == wanted


def test_a_value_in_most_rows_is_counted_not_kept(spark, monkeypatch):
    """Repeats at a border never reach a list."""
    kept = []

    def watched(data, cells):
        kept.append(step(data, cells).count())
        return step(data, cells)

    step = quantiles._cell_values
    monkeypatch.setattr(quantiles, "_cell_values", watched)
    values = np.concatenate([np.full(9000, 5.0), np.arange(1000) / 100])
    got = exact_quantiles(frame(spark, {"x": values}), ["x"], (0.02, 0.25, 0.5), keep=500)
    assert got == {"x": [pytest.approx(1.9998), 5.0, 5.0]}
    assert 0 < max(kept) <= 500
