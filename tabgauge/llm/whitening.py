"""Embedding whitening from a bit-sliced scatter matrix.

Entries become whole numbers ``x = floor(64 * c) + 1000000``. The covariance is that of
the fit list, each distinct x vector once. Its cross-products are counted, not multiplied:

- A task takes its fit vectors in blocks. Within a block each dimension is shifted by its
  smallest entry, and bit b of the shifted entries of all rows is packed into the words of
  one bit plane.
- The words of two planes are ANDed and their set bits counted; a count for the planes b
  and c of two dimensions weighs 2 ** (b + c). The weighted counts add up to the exact
  cross-product of the shifted entries, and the shifts are put back as whole numbers.
- Spark adds the blocks per pair of dimensions, in limbs of 40 bits so that no sum
  overflows. The driver gets one row per pair of dimensions, whatever the number of rows.
- ``n * sum(x_j x_k) - S_j S_k`` is formed in whole numbers, so the centred matrix is
  exact before it is divided by n * n and given to ``eigh``.

Components without variance (rank below the wanted number) have rows with null
``whitened``; they take no part in ``identity_error``, which is null without any variance.

Defined results: a vector that is null, empty, or holds a null or non-finite entry has no
rows, and neither have vectors of another length than the commonest in the fit list (of
equally common ones the longest). Entries beyond 2 ** 56 in size count as that. A deviation
beyond 64 bits is null. Null and repeated ids and repeated vectors each keep their own rows.
An empty table gives an empty result. Extra columns are not read. There are no texts here.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import saved

# Pickled with the functions, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 16
SCALE = 64.0
# Entries are moved by this much; sums are kept relative to it.
ORIGIN = 1_000_000
LARGEST = float(2**56)
BLOCK_ROWS = 8192
# Rows of a batch of results, each with a row per component.
OUTPUT_ROWS = 4096
LIMB = 40
LIMBS = 5
SAFE = 2**62


@dataclass(frozen=True)
class Whitening:
    """What whitening needs to know: the fit list's size, sums and components."""

    n: int
    # Sums of x - ORIGIN per dimension.
    sums: tuple[int, ...]
    # Eigenvalues falling, and unit eigenvectors as columns.
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the whole-number vectors, without damaged ones; x is relative to ORIGIN."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    vector = col(vector_col).cast("array<double>")
    fits = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    return df.select(
        col(id_col).alias("id"),
        F.when(
            (F.size(vector) > 0) & ~F.exists(vector, bad),
            F.transform(vector, lambda c: F.floor(fits(c) * SCALE)),
        ).alias("x"),
    ).where("x IS NOT NULL")


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct vectors of the commonest length, written down, and that length."""
    every = saved(rows.select("x").distinct())
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d = commonest["d"] if commonest else 0
    return every.where(F.size("x") == d), d


def matrix(part: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch, a row each."""
    return part.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def planes_of(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (one row of words each), their dimensions and their bits.

    Planes without a set bit are left out."""
    rows, d = shifted.shape
    words = -(-rows // 64)
    padded = np.zeros((d, words * 64), np.uint64)
    padded[:, :rows] = shifted.T.astype(np.uint64)
    planes, dims, bits = [], [], []
    for j in range(d):
        for b in range(int(padded[j].max()).bit_length()):
            bit = ((padded[j] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            planes.append(np.packbits(bit).view(np.uint64))
            dims.append(j)
            bits.append(b)
    stacked = np.array(planes, np.uint64).reshape(len(planes), words)
    return stacked, np.array(dims, np.int64), np.array(bits, np.int64)


def cross_products(x: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Exact sums of a block's entries per dimension and of products per pair j <= k."""
    m, d = x.shape
    shift = x.min(axis=0)
    planes, dims, bits = planes_of(x - shift)
    top = int(bits.max()) + 1 if len(bits) else 0
    # Weighted counts fit a long unless the entries of a block spread very widely.
    whole = np.int64 if m << (2 * top) < SAFE else object
    weight = np.array([1 << b for b in bits.tolist()], whole)
    products = np.zeros((d, d), whole)
    counts = np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(whole)
    own = np.zeros(d, whole)
    np.add.at(own, dims, counts * weight)
    for p in range(len(planes)):
        both = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
        row = np.zeros(d, whole)
        np.add.at(row, dims[p:], both.astype(whole) * weight[p:])
        # A plane with a later one of its own dimension counts in both orders.
        j = dims[p]
        if whole is object:
            twice = sum(
                int(n) << int(bits[p] + b)
                for n, k, b in zip(both[1:], dims[p + 1 :], bits[p + 1 :])
                if k == j
            )
        else:
            same = dims[p + 1 :] == j
            twice = int((both[1:][same] * weight[p + 1 :][same]).sum()) * int(weight[p])
        products[j] += row * weight[p]
        products[j, j] += twice
    a, y, s = shift.tolist(), own.tolist(), products.tolist()
    sums = [int(y[j]) + m * a[j] for j in range(d)]
    pairs = {
        (j, k): int(s[j][k]) + a[k] * int(y[j]) + a[j] * int(y[k]) + m * a[j] * a[k]
        for j in range(d)
        for k in range(j, d)
    }
    return sums, pairs


def limbs(value: int) -> list[int]:
    """The number in limbs of 40 bits, the last one with the sign."""
    low = [(value >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)]
    return [*low, value >> (LIMB * (LIMBS - 1))]


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """Size, sums and cross-products of the fit list, exact whole numbers."""

    def counted(x: np.ndarray) -> pa.RecordBatch:
        sums, pairs = cross_products(x)
        keys = [(-1, -1), *[(-1, j) for j in range(d)], *pairs]
        parts = [limbs(v) for v in (len(x), *sums, *pairs.values())]
        columns = [[k[0] for k in keys], [k[1] for k in keys], *zip(*parts)]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * LIMBS]
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in parts:
            for at in range(0, part.num_rows, BLOCK_ROWS):
                held.append(matrix(part.column(0).slice(at, BLOCK_ROWS), d))
                rows += len(held[-1])
                if rows >= BLOCK_ROWS:
                    yield counted(np.concatenate(held))
                    held, rows = [], 0
        if rows:
            yield counted(np.concatenate(held))

    names = ["j", "k", *[f"l{i}" for i in range(LIMBS)]]
    schema = "j int, k int, " + ", ".join(f"l{i} bigint" for i in range(LIMBS))
    total = fit.mapInArrow(run, schema).groupBy("j", "k")
    added = total.agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)])
    n, sums, pairs = 0, [0] * d, {}
    for row in added.collect():
        value = sum(row[f"l{i}"] << (LIMB * i) for i in range(LIMBS))
        if row["j"] >= 0:
            pairs[row["j"], row["k"]] = value
        elif row["k"] >= 0:
            sums[row["k"]] = value
        else:
            n = value
    return n, sums, pairs


def solve(n: int, sums: list[int], pairs: dict[tuple[int, int], int]) -> Whitening:
    """Eigenvalues and eigenvectors of the covariance, centred as whole numbers."""
    d = len(sums)
    covariance = np.zeros((d, d))
    for (j, k), product in pairs.items():
        centred = n * product - sums[j] * sums[k]
        covariance[j, k] = covariance[k, j] = centred / (n * n)
    values, found = np.linalg.eigh(covariance)
    return Whitening(
        n, tuple(sums), values[::-1].copy(), found[:, ::-1].copy(), float(np.trace(covariance))
    )


def with_variance(model: Whitening) -> np.ndarray:
    """Whether each component has variance beyond rounding."""
    largest = max(float(model.values[0]), 0.0)
    return model.values > largest * len(model.sums) * np.finfo(float).eps


def deviations(model: Whitening, x: np.ndarray) -> np.ndarray:
    """n * x - S, exact: longs where they fit, Python's whole numbers otherwise."""
    sums = np.array(model.sums, object)
    widest = max(abs(int(x.min())), abs(int(x.max())), 1) * model.n
    if widest + max(abs(s) for s in model.sums) < SAFE:
        return x * np.int64(model.n) - sums.astype(np.int64)
    return x.astype(object) * model.n - sums


def squared(moved: np.ndarray) -> list[int | None]:
    """Sums of squares per row, exact; None beyond 64 bits."""
    widest = max(abs(int(moved.min())), abs(int(moved.max())))
    if moved.dtype == object or widest * widest * moved.shape[1] >= SAFE:
        moved = moved.astype(object)
    return [s if s < 2**63 else None for s in (moved * moved).sum(axis=1).tolist()]


def project(model: Whitening, moved: np.ndarray, count: int) -> np.ndarray:
    """Whitened coordinates of n * x - S; NaN for components without variance."""
    values = np.where(with_variance(model), model.values, np.nan)[:count]
    centred = moved.astype(float) / model.n
    return (centred @ model.vectors[:, :count]) / np.sqrt(values)


def identity_error(fit: DataFrame, model: Whitening, count: int) -> float | None:
    """The largest entry of the whitened covariance of the fit list, minus the identity."""
    held = int(with_variance(model)[:count].sum())
    if not held:
        return None
    d = len(model.sums)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The whitened values are centred before they are multiplied here.
        total, products = np.zeros(held), np.zeros((held, held))
        for part in parts:
            if part.num_rows:
                w = project(model, deviations(model, matrix(part.column(0), d)), held)
                total += w.sum(axis=0)
                products += w.T @ w
        a, b = np.triu_indices(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(held, -1), a]), pa.int32()),
                pa.array(np.concatenate([np.arange(held), b]), pa.int32()),
                pa.array(np.concatenate([total, products[a, b]])),
            ],
            ["a", "b", "value"],
        )

    found = fit.mapInArrow(run, "a int, b int, value double")
    sums = {(r.a, r.b): r.value for r in found.groupBy("a", "b").agg(F.sum("value").alias("value")).collect()}
    mean = [sums[-1, b] / model.n for b in range(held)]
    return max(
        abs(value / model.n - mean[a] * mean[b] - (a == b))
        for (a, b), value in sums.items()
        if a >= 0
    )


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """One row per kept vector and component: id, component, n, deviation, whitened,
    explained, identity_error. The model is fitted when the frame is built."""
    rows = vectors(df, id_col, vector_col)
    fit, d = fit_list(rows)
    schema = "component int, n bigint, deviation bigint, whitened double, explained double"
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"id {id_type}, {schema}, identity_error double"
    if not d:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    model = solve(*scatter(fit, d))
    count = min(components, d)
    error = identity_error(fit, model, count)
    share = model.values[:count] / model.trace if model.trace > 0 else np.zeros(count)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, OUTPUT_ROWS):
                part = whole.slice(at, OUTPUT_ROWS)
                m = part.num_rows
                moved = deviations(model, matrix(part.column(1), d))
                whitened = project(model, moved, count).ravel()
                each = np.repeat(np.arange(m), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, count + 1), m), pa.int32()),
                        pa.array(np.full(m * count, model.n), pa.int64()),
                        pa.array(squared(moved), pa.int64()).take(pa.array(each)),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(np.tile(share, m)),
                        pa.array([error] * (m * count), pa.float64()),
                    ],
                    names,
                )

    same = rows.where(F.size("x") == d)
    return same.mapInArrow(run, schema).withColumnRenamed("id", id_col)
