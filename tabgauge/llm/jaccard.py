"""N-gram Jaccard join by vertical partitioning, and the components it links.

A document's set holds the distinct 64-bit hashes of its ``n``-word shingles. Documents
link when ``100 * intersection >= percent * union``. Documents with equal sets form a
class; everything after works on one member per class.

Shingles have one global order: the others by hash, then frequent ones, rarest first. Linked sets share a
shingle among the first ``size - ceil(percent% of size) + 1`` of each (the prefix), so only
documents that share a prefix shingle can link:

- At the first shingle that two sets share in the order, nothing before it is shared, so
  what each has left from there on bounds their overlap. A bucket, that is the classes with
  a shingle in their prefix, pairs only classes whose bound is enough. In every such pair
  the smaller set has the shingle near its front; it is a core member of the bucket.
- In a bucket of at most ``bucket`` classes the shared prefix shingles of a pair are counted
  as well, which ends most of the others. The pairs left are verified in two waves: each
  class with the partner it shares most with, then the pairs that still lie in different
  components.
- A larger bucket (large groups of near copies, boilerplate) meets a few leaders in each
  round, core members of its smallest components. A leader has then met all others and
  leaves; the bucket ends when one component or no core member is left. Leaders grow from
  round to round, so that near copies merge at the cost of a few pairs each, and dissimilar
  classes need few rounds. No pair of different components goes unseen.

A set has a bitmap of its shingles' hashes. A bit that one set has and the other lacks stands
for a shingle at least that they do not share, which bounds their overlap and ends most
candidate pairs. The rest are verified by vertical partitioning: the order is cut into fragments by
hash, the overlap of each fragment is counted by itself, and the counts are summed per
pair. Links are contracted to components by hooking and pointer jumping.

"Frequent" is decided from counts over all documents: shingles of at least ``SEEN`` sets
of a chunk, summed over chunks, reaching ``FREQUENT``. At most ``MOST_FREQUENT`` of them, the
most frequent, are broadcast. Any choice gives the same links; it only decides which
shingles are compared first.

Defined results: white space and A-Z case are as in the contract; a null or blank text has
an empty set, links with nothing and is its own component; a text with fewer words than
``n`` has its whole sequence as one shingle; equal ids with different texts are documents
of their own; a component's id is null only if all ids in it are; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import LAST_ID, id_key, saved, saved_at, whole_text
from tabgauge.llm.suffix import Hashes, Scale, binary_column, mix, signed
from tabgauge.session import remove_path, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 4
PERCENT = 85
BUCKET = 64
# Leaders of a large bucket in the first round, and their growth from round to round.
LEADERS = 4
GROWTH = 64
FRAGMENTS = 8
# Bits of a set's bitmap, which is kept beside its fragments under a number of its own.
BITS = 1024
BITMAP = -1
SEEN = 2
FREQUENT = 8
MOST_FREQUENT = 1_000_000
CHUNK_BYTES = 2 << 20
COUNTED_SHINGLES = 3_000_000
U = np.uint64
MIXERS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes."""
    first, last = 0, len(bounds) - 1
    while first < last:
        stop = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        stop = min(max(stop, first + 1), last)
        yield first, stop
        first = stop


def shingle_sets(
    data: np.ndarray, bounds: np.ndarray, scale: Scale, words: int
) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document data[bounds[i]:bounds[i + 1]]."""
    n = len(bounds) - 1
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    # A word also starts and ends where a document does.
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    doc = np.searchsorted(bounds, starts, side="right") - 1
    hashes = Hashes(data, 0, *scale.take(len(data) + 2))
    h = mix(hashes.of(starts, ends - starts) + (ends - starts).astype(np.uint64) * MIXERS[0])
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)
    joined = h[: max(0, len(h) - words + 1)].copy()
    for k in range(1, words):
        joined = joined * MIXERS[1] + h[k : k + len(joined)]
    joined = mix(joined)
    empty = np.zeros(0, np.uint64)
    sets = []
    for i in range(n):
        a, count = first[i], size[i]
        if not count:
            sets.append(empty)
        elif count < words:
            one = np.array([count], np.uint64)
            for k in range(a, a + count):
                one = mix(one * MIXERS[2] + h[k : k + 1])
            sets.append(one)
        else:
            own = np.sort(joined[a : a + count - words + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            sets.append(own)
    return sets


def sets_of(part: pa.RecordBatch, at: int, words: int, scale: Scale):
    """(documents first to last, their sets) of a batch, chunk by chunk."""
    data, bounds = binary_column(part.column(at))
    for first, last in chunks(bounds):
        yield first, last, shingle_sets(data, bounds[first : last + 1], scale, words)


def set_digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set only."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return struct.unpack("<qq", digest)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        id_key(id_col).alias("id"),
        F.xxhash64(text).alias("mark"),
        text.cast("binary").alias("text"),
    )


def frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles and their ranks, rarest first, from all documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(0)
        # Copies within a chunk count once.
        own: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def counted() -> pa.RecordBatch:
            every = np.sort(np.concatenate([*own.values(), np.zeros(0, np.uint64)]))
            first = np.flatnonzero(np.concatenate([every[:1] == every[:1], every[1:] != every[:-1]]))
            n = np.diff(np.concatenate([first, [len(every)]]))
            keep = n >= SEEN
            return pa.RecordBatch.from_arrays(
                [signed(every[first[keep]]), pa.array(n[keep], pa.int64())], ["shingle", "n"]
            )

        for part in parts:
            for _, _, sets in sets_of(part, 0, words, scale):
                for s in sets:
                    if len(s):
                        own[set_digest(s)] = s
                        held += len(s)
                if held >= COUNTED_SHINGLES:
                    yield counted()
                    own, held = {}, 0
        yield counted()

    counts = rows.select("text").mapInArrow(run, "shingle bigint, n bigint")
    total = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = total.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    found = top.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    counts = top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(found)
    found, counts = found[order], counts[order]
    ranks = np.empty(len(found), np.int64)
    ranks[np.lexsort((found, counts))] = np.arange(len(found))
    return found, ranks


def prefix_size(n: np.ndarray | int, percent: int):
    return n - -(-percent * n // 100) + 1


def describe(
    rows: DataFrame, words: int, percent: int, hot: tuple[np.ndarray, np.ndarray]
) -> DataFrame:
    """(id, mark, n, d1, d2, prefix) of each document."""
    held = rows.sparkSession.sparkContext.broadcast(tuple(a.tobytes() for a in hot))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, (often, ranks) = Scale(0), held.value
        often, ranks = np.frombuffer(often, np.uint64), np.frombuffer(ranks, np.int64)
        for part in parts:
            for first, last, sets in sets_of(part, 2, words, scale):
                prefixes = []
                for own in sets:
                    size = prefix_size(len(own), percent) if len(own) else 0
                    if len(own) and len(often):
                        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                        is_hot = often[at] == own
                        by_rank = np.argsort(ranks[at[is_hot]])
                        own = np.concatenate([own[~is_hot], own[is_hot][by_rank]])
                    prefixes.append(own[:size].view(np.int64))
                digests = [set_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(first, last - first),
                        part.column(1).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["id", "mark", "n", "d1", "d2", "prefix"],
                )

    schema = "id bigint, mark bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>"
    return rows.mapInArrow(run, schema)


def fragments(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(k, fragment, shingles) of the classes in wanted (k, id, mark), and their bitmaps."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(0)
        edges = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
        for part in parts:
            ks = part.column(0)
            for first, _, sets in sets_of(part, 1, words, scale):
                k, number, cut = [], [], []
                for i, own in enumerate(sets):
                    for f, piece in enumerate(np.split(own, np.searchsorted(own, edges))):
                        if len(piece):
                            k.append(ks[first + i].as_py())
                            number.append(f)
                            cut.append(piece.view(np.int64))
                    k.append(ks[first + i].as_py())
                    number.append(BITMAP)
                    cut.append(bitmap(own).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k, pa.int64()),
                        pa.array(number, pa.int32()),
                        pa.array(cut, pa.list_(pa.int64())),
                    ],
                    ["k", "fragment", "shingles"],
                )

    # Repeated rows have equal ids and marks; the fragments of one of them count.
    one = rows.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("k", "text")
    return one.mapInArrow(run, "k bigint, fragment int, shingles array<bigint>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits in words of 64, one set by each shingle."""
    bits, place = np.zeros(BITS // 64, np.uint64), shingles & U(BITS - 1)
    np.bitwise_or.at(bits, (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
    return bits


def links_if(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return overlap * 100 >= (na + nb - overlap) * percent


def comparable(na: Column, nb: Column, percent: int) -> Column:
    """Sizes that can link at all."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def possible(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose bitmaps leave enough overlap for a link."""
    bits = cut.where(F.col("fragment") == BITMAP).select("k", "shingles")

    def lacking(own: str, other: str) -> Column:
        words = F.zip_with(own, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.aggregate(words, F.lit(0), lambda total, n: total + n)

    c = F.col
    overlap = F.least(c("na") - lacking("sa", "sb"), c("nb") - lacking("sb", "sa"))
    return (
        pairs.join(bits.toDF("a", "sa"), "a")
        .join(bits.toDF("b", "sb"), "b")
        .where(links_if(overlap, c("na"), c("nb"), percent))
        .select("a", "b", "na", "nb")
    )


def verify(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link, as (a, b)."""
    pairs = possible(pairs, cut, percent)
    cut = cut.where(F.col("fragment") != BITMAP)
    left = cut.select(F.col("k").alias("a"), "fragment", F.col("shingles").alias("sa"))
    right = cut.select(F.col("k").alias("b"), "fragment", F.col("shingles").alias("sb"))
    partial = (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
    )
    overlap = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    c = F.col
    return overlap.where(links_if(c("overlap"), c("na"), c("nb"), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(k, component): the smallest k that each linked k reaches."""
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("k")).union(edges.select(F.col("b").alias("k")))
    whole = ends.distinct().withColumn("component", F.col("k"))
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a")).toDF("k", "near")
        hook = both.groupBy("k").agg(F.least(F.col("k"), F.min("near")).alias("to"))
        hook = saved(hook)
        for _ in range(2):
            up = hook.select(F.col("k").alias("to"), F.col("to").alias("top"))
            hook = hook.join(up, "to").select("k", F.col("top").alias("to"))
        hook = saved(hook)
        step = hook.select(F.col("k").alias("component"), "to")
        whole = saved(
            whole.join(step, "component", "left").select(
                "k", F.coalesce("to", "component").alias("component")
            )
        )
        a = hook.select(F.col("k").alias("a"), F.col("to").alias("ta"))
        b = hook.select(F.col("k").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").where("ta <> tb")
        edges = saved(
            moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
    return whole


def viable(na: Column, pa: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether two sets can link whose first shared shingle has these places in them."""
    return F.least(na - pa, nb - pb) * (100 + percent) >= (na + nb) * percent


def core(n: Column, p: Column, percent: int) -> Column:
    """Whether a set can be the smaller one of such a pair, or as large."""
    return (n - p) * (100 + percent) >= n * (2 * percent)


def small_buckets(shared: DataFrame, percent: int, bucket: int) -> DataFrame:
    """Candidate pairs (a, b, na, nb, common) that share a prefix shingle of a small bucket."""
    small = shared.where(F.col("held") <= bucket)
    many = shared.where(F.col("held") > bucket).groupBy("k").agg(F.count(F.lit(1)).alias("many"))
    c = F.col
    left = small.select("shingle", c("k").alias("a"), c("n").alias("na"), c("p").alias("pa"))
    right = small.select(
        c("shingle").alias("s"), c("k").alias("b"), c("n").alias("nb"), c("p").alias("pb")
    )
    on = (c("shingle") == c("s")) & (c("a") < c("b")) & comparable(c("na"), c("nb"), percent)
    fits = viable(c("na"), c("pa"), c("nb"), c("pb"), percent)
    counted = (
        left.join(right, on)
        .groupBy("a", "b", "na", "nb")
        .agg(F.count(F.lit(1)).alias("common"), F.bool_or(fits).alias("fits"))
        .where("fits")
    )
    ha, hb = many.toDF("a", "ha"), many.toDF("b", "hb")
    rest = lambda n: n - prefix_column(n, percent)
    most = (
        c("common")
        + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
        + F.greatest(rest(c("na")), rest(c("nb")))
    )
    bound = F.least(most, c("na"), c("nb"))
    return (
        counted.join(ha, "a", "left")
        .join(hb, "b", "left")
        .where(links_if(bound, c("na"), c("nb"), percent))
        .select("a", "b", "na", "nb", "common")
    )


def in_waves(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The components (k, component) of the candidate pairs that link."""
    c = F.col
    ends = pairs.select(c("a").alias("k"), "*").union(pairs.select(c("b").alias("k"), "*"))
    partner = F.struct("common", "a", "b", "na", "nb")
    best = ends.groupBy("k").agg(F.max(partner).alias("best")).select("best.*").distinct()
    first = saved(best.select("a", "b", "na", "nb"))
    whole = components(verify(first, cut, percent))
    apart = (
        pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")
        .join(whole.toDF("a", "ca"), "a", "left")
        .join(whole.toDF("b", "cb"), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b", "na", "nb")
    )
    links = saved(verify(saved(apart), cut, percent))
    return joined(whole, links) if links.limit(1).count() else whole


def prefix_column(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100)) + 1


def joined(whole: DataFrame, links: DataFrame) -> DataFrame:
    """The components (k, component) after some more links."""
    ends = links.select(F.col("a").alias("k")).union(links.select(F.col("b").alias("k")))
    new = ends.distinct().join(whole, "k", "left_anti")
    whole = saved(whole.union(new.select("k", F.col("k").alias("component"))))
    a, b = whole.toDF("a", "ca"), whole.toDF("b", "cb")
    moved = links.join(a, "a").join(b, "b").where("ca <> cb")
    step = components(moved.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return saved(
        whole.join(step.toDF("component", "to"), "component", "left").select(
            "k", F.coalesce("to", "component").alias("component")
        )
    )


def large_buckets(
    shared: DataFrame,
    whole: DataFrame,
    cut_for,
    percent: int,
    bucket: int,
) -> DataFrame:
    """The components, after pairing the classes of large buckets across components."""
    c, spark = F.col, shared.sparkSession
    large = shared.where(c("held") > bucket).withColumn("core", core(c("n"), c("p"), percent))
    many = large.groupBy("k").agg(F.count(F.lit(1)).alias("many"))
    rows, path = saved_at(large.select("shingle", "k", "n", "p", "core").join(many, "k"))
    if not rows.limit(1).count():
        return whole
    cut = cut_for(rows.select("k").distinct())
    tried = scratch_path(spark)
    rows.select(c("k").alias("a"), c("k").alias("b")).where("a < b").write.parquet(tried)
    lead = LEADERS
    while True:
        own = rows.join(whole, "k", "left").withColumn("own", F.coalesce("component", "k"))
        # Buckets of several components with a core member left, and their components there.
        groups = own.groupBy("shingle", "own").agg(F.bool_or("core").alias("core"))
        state = groups.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("groups"), F.bool_or("core").alias("any")
        )
        open_ones = state.where("any AND groups > 1").select("shingle")
        now, now_path = saved_at(
            own.drop("component").join(open_ones, "shingle").select("shingle", "k", "n", "p", "core", "many", "own")
        )
        remove_path(spark, path)
        if not now.limit(1).count():
            remove_path(spark, now_path)
            remove_path(spark, tried)
            return whole
        # The smallest components first. Members of most large buckets before others: the
        # text that near copies were made from has the most in common with them.
        sizes = now.groupBy("shingle", "own").agg(F.count(F.lit(1)).alias("size"))
        able = now.where("core").join(sizes, ["shingle", "own"])
        kin = Window.partitionBy("shingle", "own").orderBy(F.desc("many"), "p", "k")
        turn = Window.partitionBy("shingle").orderBy("nth", "size", F.desc("many"), "own", "k")
        leaders = saved(
            able.withColumn("nth", F.row_number().over(kin))
            .where(c("nth") <= lead)
            .withColumn("place", F.row_number().over(turn))
            .where(c("place") <= lead)
            .select(
                "shingle",
                c("k").alias("leader"),
                c("n").alias("nl"),
                c("p").alias("pl"),
                c("own").alias("lead"),
            )
        )
        met = now.join(leaders, "shingle").where(
            (c("own") != c("lead")) & viable(c("n"), c("p"), c("nl"), c("pl"), percent)
        )
        pairs = saved(
            met.select(
                F.least("k", "leader").alias("a"),
                F.greatest("k", "leader").alias("b"),
                F.when(c("k") < c("leader"), c("n")).otherwise(c("nl")).alias("na"),
                F.when(c("k") < c("leader"), c("nl")).otherwise(c("n")).alias("nb"),
            )
            .distinct()
            .join(spark.read.schema("a bigint, b bigint").parquet(tried), ["a", "b"], "left_anti")
        )
        pairs.select("a", "b").write.mode("append").parquet(tried)
        links = saved(verify(pairs, cut, percent))
        if links.limit(1).count():
            whole = joined(whole, links)
        rows, path = saved_at(
            now.join(leaders.select("shingle", c("leader").alias("k")), ["shingle", "k"], "left_anti")
            .drop("own")
        )
        remove_path(spark, now_path)
        lead *= GROWTH


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: id, mark, n_shingles, component_id, component_mark.

    Ids are keys, with null as the largest. A mark is the hash of a text, to tell rows with
    equal ids apart; a component is named by its smallest (id, mark)."""
    rows = texts(docs, id_col, text_col)
    known = saved(describe(rows, words, percent, frequent(rows, words)))
    digest = ["d1", "d2", "n"]
    groups = known.where("n > 0").groupBy(*digest).agg(
        F.min(F.struct("id", "mark")).alias("rep"), F.first("prefix").alias("prefix")
    )
    classes = saved(
        groups.select(
            F.monotonically_increasing_id().alias("k"), "rep.id", "rep.mark", *digest, "prefix"
        )
    )
    held = Window.partitionBy("shingle")
    shared = saved(
        classes.select("k", "n", F.posexplode("prefix").alias("p", "shingle"))
        .withColumn("held", F.count(F.lit(1)).over(held))
        .where("held > 1")
    )
    names = classes.select("k", "id", "mark")

    def cut_for(ks: DataFrame) -> DataFrame:
        return saved(fragments(rows, names.join(ks, "k", "left_semi"), words))

    pairs = saved(small_buckets(shared, percent, bucket))
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k")))
    whole = in_waves(pairs, cut_for(ends.distinct()), percent)
    whole = large_buckets(shared, whole, cut_for, percent, bucket)
    own = F.struct("id", "mark")
    linked = whole.join(classes.select("k", own.alias("own")), "k")
    lowest = linked.groupBy("component").agg(F.min("own").alias("lowest"))
    by_class = linked.join(lowest, "component").select("k", "lowest")
    of_class = classes.join(by_class, "k", "left").select(
        *digest, F.coalesce("lowest", own).alias("lowest")
    )
    return (
        known.join(of_class, digest, "left")
        .withColumn("lowest", F.coalesce("lowest", own))
        .select(
            "id",
            "mark",
            F.col("n").alias("n_shingles"),
            F.col("lowest.id").alias("component_id"),
            F.col("lowest.mark").alias("component_mark"),
        )
    )


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    plain = lambda c: F.when(c != LAST_ID, c)
    return near_components(docs, id_col, text_col, **options).select(
        plain(F.col("id")).alias(id_col),
        "n_shingles",
        plain(F.col("component_id")).alias("component_id"),
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One document per component, the one of smallest id, with its own columns.

    Of rows with that same id, the one with the smallest text hash stays, and of equal
    rows the first by their other columns. Documents with empty sets all stay.
    """
    found = near_components(docs, id_col, text_col, **options)
    firsts = (
        found.where("id = component_id and mark = component_mark")
        .select("id", "mark", (F.col("n_shingles") == 0).alias("empty"))
        .distinct()
    )
    others = [col(c) for c in docs.columns if c not in (id_col, text_col)]
    # The document's own columns are out of reach of those used here.
    marked = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
        id_key(id_col).alias("id"),
        F.xxhash64(whole_text(text_col)).alias("mark"),
        (F.to_json(F.struct(*others)) if others else F.lit("")).alias("order"),
    )
    place = F.row_number().over(Window.partitionBy("id", "mark").orderBy("order"))
    kept = marked.join(firsts, ["id", "mark"]).withColumn("place", place)
    return kept.where("place = 1 or empty").select("row.*")
