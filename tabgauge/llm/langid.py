"""Language identification by nearest centroids.

A text becomes the counts of its character n-grams (1 to 3 letters of lower-cased words,
with the word's edges), hashed to ``DIMS`` places, weighted by TF-IDF with damped counts
and brought to length 1. Each language has a few centroids, found by spherical k-means
within the language. A text gets the language of the centroid of largest cosine; the
cosine is the score. A text farther (1 - cosine) from that centroid than its limit is marked
as rejected. A text with few different n-grams is far from any centroid, so each centroid
has a limit per band of richness, the binary logarithm of the number of places a text fills:
``SLACK`` times the ``QUANTILE`` of the distances that fitted rows of the band have to the
nearest centroid of their language, each left out of its own centroid. Fewer than ``LEAST``
such rows make way for those of the whole language, then for all rows of the band, then for
the limit of the band below. No limit is above ``FARTHEST``, which also stands where no
fitted rows tell, or below ``CLOSEST``: a text half in one known language and half in
another is nearer than that.

Document frequencies come from all labelled rows to learn from. Centroids and limits are
fitted on a bounded sample: about ``SAMPLE`` of these rows, spread evenly over the languages,
chosen by a hash of their ids. Everything else reads every row and the whole of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; ties go to the first centroid, languages in code-point order; with no labelled
row every text is ``und``; an empty table gives an empty result. The label, source and id
of a row are never used for its prediction.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import unit_hash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 1 << 12
SAMPLE = 4000
CENTROIDS = 4
ROUNDS = 10
FARTHEST = 0.95
CLOSEST = 0.6
QUANTILE = 0.99
SLACK = 1.25
LEAST = 50
BANDS = 13  # of 1 to DIMS places
UNKNOWN = "und"
BATCH_CHARS = 1 << 20
BATCH_ROWS = 512
NOT_LETTERS = re.compile(r"[\W\d_]+")
# Numbers that are no digits, such as superscripts, fractions and Roman numerals: by code
# point, since few texts have one and a set in the expression would slow down all.
NUMBERS = np.array([unicodedata.category(chr(c)) in ("Nl", "No") for c in range(0x110000)])


def letters_of(texts: list[str]) -> list[str]:
    """The runs of letters of each text, in lower case, between single spaces."""
    plain = [f" {NOT_LETTERS.sub(' ', t.lower()).strip()} " for t in texts]
    odd = NUMBERS[code_points(plain)]
    if odd.any():
        ends = np.cumsum([len(p) for p in plain])
        for i in set(np.searchsorted(ends, np.flatnonzero(odd), side="right").tolist()):
            kept = "".join(" " if NUMBERS[ord(c)] else c for c in plain[i])
            plain[i] = f" {' '.join(kept.split())} "
    return plain


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


class Model(NamedTuple):
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray  # the farthest distance, of each centroid and band


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, one row per text; and whether it has a letter."""
    plain = letters_of(texts)
    letters = np.array([len(p) > 2 for p in plain], bool)
    lengths = np.array([len(p) for p in plain], np.int64)
    code = code_points(plain).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), lengths)
    counts = np.zeros(len(texts) * DIMS)
    mixed = code
    for n in (1, 2, 3):
        if n > 1:
            # Mark the length in the hash, and stay inside one text.
            mixed = mixed[:-1] * np.uint64(1_000_003) + code[n - 1 :]
            row = row[: len(mixed)]
        inside = row[: len(mixed)] == np.repeat(np.arange(len(texts)), lengths)[n - 1 :]
        spaces = code[: len(mixed)] == 32
        if n == 1:
            use = inside & ~spaces
        else:
            # Grams may begin or end with an edge, but not hold one inside.
            use = inside
            if n == 3:
                use = use & (code[1:-1] != 32)
        h = (mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        place = (h >> np.uint64(64 - 12)).astype(np.int64)
        at = row[: len(mixed)][use] * DIMS + place[use]
        counts += np.bincount(at, minlength=len(counts))
    return counts.reshape(len(texts), DIMS), letters


def slices(texts: list[str]) -> Iterator[slice]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= BATCH_CHARS or i + 1 - start >= BATCH_ROWS:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def cluster(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means, started from rows far from each other."""
    centre = unit(rows.mean(0, keepdims=True))[0]
    chosen = [int(np.argmax(rows @ centre))]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.bincount(own, minlength=len(centres)) == 0
        sums[empty] = centres[empty]
        centres = unit(sums)
    return centres


def bands(counts: np.ndarray) -> np.ndarray:
    """The band of richness of each row."""
    places = np.maximum(1, (counts > 0).sum(1))
    return np.floor(np.log2(places)).astype(np.int64)


def left_out(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its distance, the row left out of its own centre."""
    cosine = rows @ centres.T
    own = np.argmax(cosine, axis=1)
    sums = np.zeros_like(centres)
    np.add.at(sums, own, rows)
    alone = np.bincount(own, minlength=len(centres))[own] < 2
    others = (unit(sums[own] - rows) * rows).sum(1)
    cosine[np.arange(len(rows)), own] = np.where(alone, 0, others)
    nearest = np.argmax(cosine, axis=1)
    return nearest, 1 - cosine[np.arange(len(rows)), nearest]


def limits(
    langs: list[str], nearest: np.ndarray, band: np.ndarray, far: np.ndarray, farthest: float
) -> np.ndarray:
    """The farthest distance of each centroid and band, from the fitted rows' own."""
    names = np.array(langs)
    out = np.full((len(langs), BANDS), farthest)
    for c, name in enumerate(langs):
        for b in range(BANDS):
            here = band == b
            for some in (here & (nearest == c), here & (names[nearest] == name), here):
                if some.sum() >= LEAST:
                    most = max(CLOSEST, SLACK * np.quantile(far[some], QUANTILE))
                    out[c, b] = min(farthest, most)
                    break
            else:
                out[c, b] = out[c, b - 1] if b else farthest
    return out


def sample_rows(labelled: DataFrame, id_col: str, lang_col: str, size: int) -> DataFrame:
    """About ``size`` rows, as many of each language, by a hash of the id."""
    counts = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("__n"))
    each = F.lit(float(size)) / F.greatest(F.lit(1), F.lit(counts.count()))
    share = F.broadcast(counts.select(lang_col, (each / F.col("__n")).alias("__share")))
    return labelled.join(share, lang_col).where(
        unit_hash(F.lit(29), col(id_col)) < F.col("__share")
    )


def presence(labelled: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """The number of rows with a letter, and of those that fill each place; all rows count."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(DIMS, np.int64)
        for part in parts:
            texts = part.column(0).to_pylist()
            for some in slices(texts):
                counts, letters = grams(texts[some])
                n += int(letters.sum())
                seen += (counts[letters] > 0).sum(0)
        # Place -1 stands for the rows.
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, DIMS), pa.int32()), pa.array([n, *seen.tolist()], pa.int64())],
            ["place", "n"],
        )

    found = labelled.select(col(text_col)).mapInArrow(run, "place int, n bigint")
    sums = dict(found.groupBy("place").agg(F.sum("n")).collect())
    return sums.get(-1, 0), np.array([sums.get(p, 0) for p in range(DIMS)], np.int64)


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = SAMPLE,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    farthest: float = FARTHEST,
) -> Model:
    """Learn idf from all rows with text and language, and centroids and their limits from a
    bounded sample of them.

    The sample's count vectors (``size`` x ``DIMS`` small integers) come to the driver;
    the number of languages is taken to be far below ``size``.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, langs = part.column(1).to_pylist(), part.column(0).to_pylist()
            for some in slices(texts):
                counts, letters = grams(texts[some])
                held = [c.astype("<u2" if c.max() < 65536 else "<u4") for c in counts[letters]]
                names = [n for n, ok in zip(langs[some], letters) if ok]
                wide = [h.itemsize for h in held]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.string()),
                        pa.array(wide, pa.int32()),
                        pa.array([h.tobytes() for h in held], pa.binary()),
                    ],
                    ["lang", "wide", "counts"],
                )

    rows = labelled.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    chosen = sample_rows(rows.select(id_col, text_col, lang_col), id_col, lang_col, size)
    found = (
        chosen.select(col(lang_col).alias("lang"), col(text_col).alias("text"))
        .mapInArrow(run, "lang string, wide int, counts binary")
        .collect()
    )
    found.sort(key=lambda r: (r.lang, bytes(r.counts)))
    if not found:
        return Model([], np.ones(DIMS), np.zeros((0, DIMS), np.float32), np.zeros((0, BANDS)))
    counts = np.stack(
        [np.frombuffer(bytes(r.counts), f"<u{r.wide}").astype(np.float32) for r in found]
    )
    n, seen = presence(rows, text_col)
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)
    return learn(counts, np.array([r.lang for r in found]), idf, centroids, rounds, farthest)


def learn(
    counts: np.ndarray,
    lang: np.ndarray,
    idf: np.ndarray,
    centroids: int,
    rounds: int,
    farthest: float,
) -> Model:
    """The model of count vectors, their languages and the weights of the places."""
    rows = vectors(counts, idf)
    nearest, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    langs, centres = [], []
    for name in sorted(set(lang.tolist())):
        mine = lang == name
        own = cluster(rows[mine], centroids, rounds)
        at, far[mine] = left_out(rows[mine], own)
        nearest[mine] = at + len(langs)
        langs += [name] * len(own)
        centres.append(own)
    return Model(
        langs,
        idf,
        np.concatenate(centres).astype(np.float32),
        limits(langs, nearest, bands(counts), far, farthest),
    )


def classify(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    """The language of each text, its score, and whether it is rejected."""
    counts, letters = grams(texts)
    if not model.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    cosine = vectors(counts.astype(np.float32), model.idf) @ model.centroids.T
    best = np.argmax(cosine, axis=1)
    score = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0).astype(float)
    score = np.round(np.where(letters, score, 0.0), 6)
    gone = ~letters | (score < 1 - model.limits[best, bands(counts)])
    names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
    return names, score.tolist(), gone.tolist()


def predict(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    names=("lang_pred", "score", "rejected"),
) -> DataFrame:
    """The documents with their language, its score and whether they are rejected.

    Columns so named are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    lang_name, score_name, gone_name = names
    kept = docs.drop(*names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for part in parts:
            at = part.schema.get_field_index(text_col)
            texts = [t or "" for t in part.column(at).to_pylist()]
            for some in slices(texts):
                langs, score, gone = classify(own, texts[some])
                found = [
                    pa.array(langs, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(gone, pa.bool_()),
                ]
                rows = part.slice(some.start, some.stop - some.start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *found], [*part.schema.names, *names]
                )

    typed = kept.withColumns(
        {lang_name: F.lit("").cast("string"), score_name: F.lit(0.0), gone_name: F.lit(False)}
    )
    return kept.mapInArrow(run, typed.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, kept apart from learning; a null id belongs to it."""
    rest = F.crc32(col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(True))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **options,
) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **options)
    rows = docs.select(
        col(id_col).cast("bigint").alias("id"),
        held_out(id_col).alias("held_out"),
        col(text_col).cast("string").alias("text"),
    )
    return predict(rows, model, "text").select(
        F.col("id").alias(id_col), "held_out", "lang_pred", "score", "rejected"
    )


def keep_known(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **options,
) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **options)
    marked = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
        col(text_col).cast("string").alias("text"),
    )
    return predict(marked, model, "text").where("NOT rejected").select("row.*")
