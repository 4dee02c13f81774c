"""SimHash near-dedup by tables of distances to reference fingerprints.

Every text has a 64-bit SimHash of its ``words``-word shingles. Equal fingerprints are one
class; everything after works on one row per class.

A distance table holds, for each class, the Hamming distances to ``REFERENCES`` reference
fingerprints, cut into ``BLOCKS`` blocks of neighbouring bits: 16 distances of 4 bits per
block, one long. The sum over the blocks is the distance to the whole reference.

- Fingerprints within ``radius`` bits differ in at most that many blocks, and the distances
  to every reference are equal in the others. Each choice of blocks that can be left is a
  table, keyed by the distances in it; only classes of one key can link.
- Within a key, a pair is discarded as soon as its distances to some reference differ by
  more than the radius, since no coordinate can move further than the fingerprint. The
  survivors of that maximum coordinate difference are verified by their differing bits.
- A key with more than ``bucket`` classes is not paired. For a class in such a key, all
  fingerprints one bit away are written out: two classes within two bits of each other
  always share one of those, and each has at most 65 classes around it, however large the
  group is. So every link of such classes is found without pairing the group.

Links are contracted to components by hooking and pointer jumping.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a
text with fewer words than ``words`` has its whole sequence as one shingle. Texts are read
in slices of ``SLICE`` bytes, so very long ones take bounded memory beside their batch.
Repeated rows and equal ids each keep their row; null ids take part, and a component's id is
null only if all its ids are. Extra columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import saved, whole_text
from tabgauge.llm.jaccard import components

# Pickled with the functions, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 3
SEED = 42
BITS = 64
RADIUS = 2
REFERENCES = 16
BLOCKS = 5
BUCKET = 64
SLICE = 1 << 22
SPACE = b" \t\n\x0b\x0c\r"


def slices(data: bytes, limit: int) -> Iterator[bytes]:
    """A text in slices that end at white space."""
    start = 0
    while start < len(data):
        stop = min(start + limit, len(data))
        while stop < len(data) and data[stop] not in SPACE:
            stop += 1
        yield data[start:stop]
        start = stop


def votes_of(hashes: list[int], total: np.ndarray) -> int:
    """Add the set bits of the hashes, per bit from the highest; returns their number."""
    if hashes:
        raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return len(hashes)


def fingerprint(data: bytes, words: int = WORDS, limit: int = SLICE) -> int:
    """The SimHash of a text in UTF-8, unsigned."""
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    count, rest = 0, []
    for piece in slices(data, limit):
        held = rest + piece.lower().split()
        if len(held) < words:
            rest = held
            continue
        line = b" ".join(held)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        spans = zip(starts, ends[words - 1 :].tolist())
        count += votes_of([digest(line[a:b], SEED) for a, b in spans], total)
        rest = held[len(held) - words + 1 :]
    if not count:
        if not rest:
            return 0
        count = votes_of([digest(b" ".join(rest), SEED)], total)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """(id, f): the fingerprint of every row, as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [fingerprint(t.as_py(), words) for t in part.column(1)]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), signed], ["id", "f"])

    text = whole_text(text_col).cast("binary").alias("text")
    rows = docs.select(col(id_col).alias("id"), text)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, f bigint")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def references(count: int = REFERENCES) -> list[int]:
    """Fixed fingerprints to measure from, spread by a hash of their number."""
    made = [hashlib.sha256(f"reference {i}".encode()).digest()[:8] for i in range(count)]
    return [int.from_bytes(m, "big") for m in made]


def block_masks(blocks: int = BLOCKS) -> list[int]:
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def distance_table(classes: DataFrame, blocks: int) -> DataFrame:
    """(f, s0 ... ): per block the distances to all references, 4 bits each."""

    def distances(mask: int) -> Column:
        parts = [
            F.shiftleft(
                F.bit_count(F.col("f").bitwiseXOR(F.lit(signed(r))).bitwiseAND(F.lit(signed(mask))))
                .cast("bigint"),
                4 * i,
            )
            for i, r in enumerate(references())
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    masks = block_masks(blocks)
    return classes.select("f", *[distances(m).alias(f"s{i}") for i, m in enumerate(masks)])


def coordinate(side: str, reference: int, blocks: int) -> Column:
    """The distance of a row to one reference: the sum over its blocks."""
    fifteen = F.lit(15).cast("bigint")
    parts = [
        F.shiftrightunsigned(F.col(f"{side}.s{b}"), 4 * reference).bitwiseAND(fifteen)
        for b in range(blocks)
    ]
    return reduce(lambda a, b: a + b, parts)


def near(radius: int, blocks: int) -> Column:
    """No coordinate differs by more than the radius, and neither do the fingerprints."""
    close = [
        F.abs(coordinate("a", i, blocks) - coordinate("b", i, blocks)) <= radius
        for i in range(REFERENCES)
    ]
    same = F.bit_count(F.col("a.f").bitwiseXOR(F.col("b.f"))) <= radius
    return reduce(lambda a, b: a & b, [*close, same])


def links(classes: DataFrame, radius: int, blocks: int, bucket: int) -> DataFrame:
    """(a, b): enough pairs of near fingerprints to connect all that are near."""
    kept = range(blocks)
    tables = list(combinations(kept, blocks - radius))
    keys = [
        F.xxhash64(F.lit(number), *[F.col(f"s{b}") for b in table]).alias(f"k{number}")
        for number, table in enumerate(tables)
    ]
    own = ["f", *[f"s{b}" for b in kept]]
    keyed = distance_table(classes, blocks).select(*own, F.explode(F.array(*keys)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rows = saved(keyed.join(counts, "key"))
    # Two classes may meet in several tables; equal links merge later.
    small = rows.where(F.col("held") <= bucket)
    pairs = (
        small.alias("a")
        .join(small.alias("b"), F.col("a.key") == F.col("b.key"))
        .where((F.col("a.f") < F.col("b.f")) & near(radius, blocks))
        .select(F.col("a.f").alias("a"), F.col("b.f").alias("b"))
    )
    large = rows.where(F.col("held") > bucket).select("f").distinct()
    flips = [F.col("f"), *[F.col("f").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)]]
    around = large.select("f", F.explode(F.array(*flips)).alias("middle"))
    # At most 65 classes lie around a middle; each links to the smallest of them.
    lowest = F.min("f").over(Window.partitionBy("middle"))
    star = around.select("f", lowest.alias("low")).where("low < f")
    return saved(pairs.union(star.select("low", "f")).distinct())


def near_components(
    rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET
) -> DataFrame:
    """(f, component_id): the smallest id reachable from each fingerprint of ``rows``."""
    if radius != RADIUS:
        raise ValueError("large groups are linked through middles, which need a radius of 2")
    classes = saved(rows.groupBy("f").agg(F.min("id").alias("lowest")))
    whole = components(links(classes, radius, blocks, bucket)).withColumnRenamed("k", "f")
    linked = whole.join(classes, "f")
    lowest = linked.groupBy("component").agg(F.min("lowest").alias("component_id"))
    found = linked.join(lowest, "component").select("f", "component_id")
    alone = classes.join(whole, "f", "left_anti").select("f", F.col("lowest").alias("component_id"))
    return found.union(alone)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    rows = saved(fingerprints(docs, id_col, text_col, words))
    found = near_components(rows, bucket=bucket)
    return rows.join(found, "f").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
