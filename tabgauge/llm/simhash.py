"""SimHash fingerprints, and search within a Hamming radius.

A term is a word with the word after it (the last word alone), and weighs as often
as it occurs. Each term has a 128-bit hash; a fingerprint bit is set when more term
weight has it set than not. Terms are exploded in place and voted on by sums: two
32-bit lanes share one long, so 64 long sums carry all 128 counts, and votes of a
document merge before anything is written.

``likeness`` is ``max(0, cos(pi * differing bits / 128))``, the estimated cosine of the
term weights: 1 for equal texts, near 0 for unrelated ones.

``near_counts`` cuts fingerprints into ``blocks`` blocks. Two within ``radius`` differ by at
most ``radius // blocks`` bits in some block: one table per block holds each distinct
fingerprint under the block's bits, the asked ones look there under these bits with every
choice of so many flipped, and a pair counts in the first block where it is so near. Copies
share one entry.

The query's radius is chosen for texts whose term weights have a cosine of ``NEAR_COSINE``
(0.95) or more. Bits differ with a probability of acos(0.95) / pi, so 12.9 of 128 on
average, with a deviation of 3.4; ``NEAR_RADIUS`` is 1.3 deviations above, which finds nine
of ten at the cosine itself and more above it.

Edited texts: see ``with_next``. Defined results: null text is empty; an empty text has
the fingerprint of the empty term; null ids come after all others; repeated rows
follow one another; a single row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import WHITE, saved, whole_text

HALF = 64
LANES = 0x0000000100000001
RADIUS = 3
BLOCKS = 5
NEAR_COSINE = 0.95
NEAR_RADIUS = 17
NEAR_BLOCKS = 6


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, f1, f2): the two halves of each text's fingerprint. Keys are unique."""
    words = texts.select(*keys, F.split(F.col(text), WHITE).alias("w"))
    pairs = words.select(
        *keys, F.inline(F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w")).alias("v")))
    ).toDF(*keys, "a", "b")
    hashed = pairs.select(
        *keys,
        F.xxhash64("a", "b").alias("h1"),
        F.xxhash64(F.lit(7), "a", "b").alias("h2"),
    )
    lanes = F.lit(LANES).cast("bigint")
    votes = hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.sum(F.shiftrightunsigned(h, j).bitwiseAND(lanes)).alias(f"{h}_{j}")
            for h in ("h1", "h2")
            for j in range(32)
        ],
    )
    return votes.select(*keys, half("h1").alias("f1"), half("h2").alias("f2"))


def half(h: str) -> Column:
    parts = []
    for j in range(32):
        low = F.expr(f"if(({h}_{j} & 4294967295) * 2 > n, {1 << j}L, 0L)")
        bit = -(1 << 63) if j == 31 else 1 << (j + 32)
        high = F.expr(f"if(shiftrightunsigned({h}_{j}, 32) * 2 > n, 1L, 0L)")
        parts += [low, high * F.lit(bit).cast("bigint") if j < 31 else F.shiftleft(high, 63)]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return total


def as_text(f1: Column, f2: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f1, f2)])


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(bits: Column) -> Column:
    cosine = F.cos(bits * F.lit(3.141592653589793 / (2 * HALF)))
    return F.when(bits == 0, 1.0).otherwise(F.greatest(F.lit(0.0), cosine))


def id_ranges(docs: DataFrame, id_col: str, ranges: int) -> Column:
    """The number of a row's id range; -1 for null. Bounds are at most ``ranges`` ids."""
    at = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(col(id_col).cast("bigint"), at, 10_000)).first()[0]
    known = sorted(set(bounds or []))
    if not known:
        return F.when(col(id_col).isNull(), -1).otherwise(0)
    below = F.filter(F.array(*[F.lit(b).cast("bigint") for b in known]), lambda b: b < col(id_col))
    return F.when(col(id_col).isNull(), -1).otherwise(F.size(below))


def with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None
) -> DataFrame:
    """Each document with the text of the next one, by descending id.

    After the last comes the first. Rows are cut into id ranges; each range also gets
    the first row of the range after it, so no row is ordered outside its range.
    Gives (area, place, next_area, next_place, id, text, next_text); (area, place) is
    unique.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        id_ranges(docs, id_col, max(2, ranges)).alias("area"),
        col(id_col).cast("bigint").alias("id"),
        whole_text(text_col).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))
    order = F.struct(
        F.col("id").isNull().alias("last"),
        (-F.coalesce("id", F.lit(0))).alias("down"),
        F.col("mark").alias("mark"),
    )
    # One row per range.
    tops = rows.groupBy("area").agg(F.min(order).alias("top"))
    by_area = Window.orderBy("area")
    everywhere = by_area.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = saved(
        tops.select(
            "area",
            F.when(~F.col("top.last"), -F.col("top.down")).alias("id"),
            F.col("top.mark").alias("mark"),
            F.coalesce(F.lead("area").over(by_area), F.first("area").over(everywhere)).alias("to"),
        )
    )
    here, top = rows.alias("r"), F.broadcast(tops).alias("t")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("area", "id", "mark")]
    guests = here.join(top, same[0] & same[1] & same[2]).select(
        F.col("t.to").alias("area"),
        F.col("r.area").alias("home"),
        *[F.col(f"r.{c}") for c in ("id", "text", "mark")],
        F.lit(1).alias("guest"),
    )
    all_rows = rows.withColumn("home", F.col("area")).withColumn("guest", F.lit(0))
    spread = all_rows.unionByName(guests)
    down = Window.partitionBy("area").orderBy(
        "guest", F.col("id").desc_nulls_last(), F.col("mark").asc()
    )
    # The partition key of the window is the range, so its exchange deals out ranges.
    return (
        spread.select(
            "area",
            "guest",
            "id",
            "text",
            F.row_number().over(down).alias("place"),
            F.lead("text").over(down).alias("next_text"),
            F.lead("guest").over(down).alias("next_guest"),
            F.lead("home").over(down).alias("next_area"),
        )
        .where("guest = 0")
        .withColumn(
            "next_place", F.when(F.col("next_guest") == 1, 1).otherwise(F.col("place") + 1)
        )
        .drop("guest", "next_guest")
    )


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None
) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last half of the text's code points, rounded down, replaced
    by as many from the start of the next document (all of it, if it is shorter).
    """
    near = with_next(docs, id_col, text_col, ranges)
    n = F.char_length("text").cast("bigint")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (n - cut).cast("int")),
        F.substring("next_text", F.lit(1), cut),
    )
    places = ["area", "place", "next_area", "next_place", "id", "n_chars", "edited_digest"]
    texts = (
        near.withColumns({"n_chars": n, "edited": edited})
        .withColumn("edited_digest", F.unhex(F.sha2("edited", 256)))
        .select(
            *places,
            F.inline(
                F.array(
                    F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                    F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")),
                )
            ),
        )
    )
    prints = fingerprints(texts, [*places, "kind"])
    both = saved(
        prints.groupBy(*places).agg(
            *[
                F.max(F.when(F.col("kind") == kind, F.col(f))).alias(f"{name}{f[1]}")
                for kind, name in ((0, "f"), (1, "e"))
                for f in ("f1", "f2")
            ]
        )
    )
    after = both.select(
        F.col("area").alias("next_area"),
        F.col("place").alias("next_place"),
        F.col("f1").alias("n1"),
        F.col("f2").alias("n2"),
    )
    c = F.col
    return both.join(after, ["next_area", "next_place"], "left").select(
        c("id").alias(id_col),
        "n_chars",
        F.lower(F.hex("edited_digest")).alias("edited_sha256"),
        as_text(c("f1"), c("f2")).alias("fingerprint"),
        as_text(c("e1"), c("e2")).alias("edited_fingerprint"),
        likeness(distance(c("f1"), c("f2"), c("e1"), c("e2"))).alias("near_edited"),
        likeness(distance(c("f1"), c("f2"), c("n1"), c("n2"))).alias("near_next"),
        "f1",
        "f2",
    )


def signed(bits: int) -> tuple[int, int]:
    """The two halves of 128 bits, as longs."""
    halves = (bits & (2**HALF - 1), bits >> HALF)
    return tuple(m - 2**HALF if m >= 2 ** (HALF - 1) else m for m in halves)


def tables(radius: int, blocks: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Per block, the mask of its bits, and the flips under which it is looked up."""
    if radius < 0 or not 0 < blocks <= 2 * HALF:
        raise ValueError("a radius is 0 or more, and a block has a bit or more")
    edges = [round(2 * HALF * i / blocks) for i in range(blocks + 1)]
    found = []
    for low, high in zip(edges, edges[1:]):
        flips = [
            signed(sum(1 << bit for bit in some))
            for n in range(min(radius // blocks, high - low) + 1)
            for some in combinations(range(low, high), n)
        ]
        found.append((signed((1 << high) - (1 << low)), flips))
    return found


def near_counts(
    queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """For each distinct (f1, f2) of the queries, the rows of prints within the radius."""
    masks = tables(radius, blocks)
    long = lambda m: F.lit(m).cast("bigint")

    def spread(df: DataFrame, a: str, b: str) -> DataFrame:
        entries = [
            F.struct(
                F.lit(t).alias("t"),
                F.col(a).bitwiseAND(long(m1)).alias("k1"),
                F.col(b).bitwiseAND(long(m2)).alias("k2"),
            )
            for t, ((m1, m2), _) in enumerate(masks)
        ]
        return df.select("*", F.inline(F.array(*entries)))

    # One row per flip of each block.
    flips = queries.sparkSession.createDataFrame(
        [(t, x, y) for t, (_, some) in enumerate(masks) for x, y in some],
        "t int, x1 bigint, x2 bigint",
    )
    asked = spread(
        queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct(), "q1", "q2"
    )
    asked = asked.join(F.broadcast(flips), "t").select(
        "q1",
        "q2",
        "t",
        F.col("k1").bitwiseXOR(F.col("x1")).alias("k1"),
        F.col("k2").bitwiseXOR(F.col("x2")).alias("k2"),
    )
    held = spread(prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")), "f1", "f2")
    q1, q2, f1, f2 = (F.col(c) for c in ("q1", "q2", "f1", "f2"))
    first = F.lit(len(masks))
    for t in reversed(range(len(masks))):
        m1, m2 = (long(m) for m in masks[t][0])
        part = F.bit_count(q1.bitwiseXOR(f1).bitwiseAND(m1)) + F.bit_count(
            q2.bitwiseXOR(f2).bitwiseAND(m2)
        )
        first = F.when(part <= radius // blocks, t).otherwise(first)
    a, h = asked.alias("a"), held.alias("h")
    meet = [F.col(f"a.{k}") == F.col(f"h.{k}") for k in ("t", "k1", "k2")]
    within = distance(q1, q2, f1, f2) <= radius
    found = a.join(h, meet[0] & meet[1] & meet[2] & within & (first == F.col("a.t")))
    return found.groupBy("q1", "q2").agg(F.sum("n").alias("n_within")).toDF("f1", "f2", "n_within")


def simhash(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    every: int = 50,
    radius: int = NEAR_RADIUS,
    blocks: int = NEAR_BLOCKS,
) -> DataFrame:
    """``edited_fingerprints``; rows whose id is divisible by ``every`` also get the number
    of documents (itself included) within the radius, the others null."""
    prints = saved(edited_fingerprints(docs, id_col, text_col))
    asks = col(id_col) % every == 0
    counts = near_counts(prints.where(asks), prints, radius, blocks).withColumn(
        "asks", F.lit(True)
    )
    return (
        prints.withColumn("asks", F.coalesce(asks, F.lit(False)))
        .join(counts, ["f1", "f2", "asks"], "left")
        .drop("f1", "f2", "asks")
    )
