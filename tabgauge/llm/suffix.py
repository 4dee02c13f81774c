"""Suffix-sorted removal of long repeated byte strings.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the
same document or another, is removed. Texts are UTF-8 bytes; strings never cross
documents.

1. Every string of ``length`` bytes holds an anchor: its ``gram``-byte piece of smallest
   hash, the leftmost of equals. Equal strings have the same anchor at the same place, so
   only strings around equal anchors can be equal. About one byte in 75 is an anchor.
   An anchor's context is all bytes of the strings that hold it.
2. Anchors meet by the hash of their piece. Where a whole context (by a second,
   independent 64-bit hash) occurs twice, all of it is covered, and nothing needs to
   be read. What is left are the edges of repeats: anchors with equal pieces in
   different contexts.
3. Only for those, contexts are cut from the texts. The suffixes that start at the anchors
   and, read backwards, the prefixes that end there are sorted by mergesort; two suffixes
   are compared by finding their common extension by binary search over polynomial
   prefix hashes. Neighbours in the two orders bound how far a string around an anchor
   can recur. Strings within these bounds are compared by their hashes, and the outermost
   matches are verified byte by byte.
4. Covered ranges merge per document, and the rest is kept.

Groups of equal anchors are worked on in one task while they have at most ``together``
members; beyond that, the strings of the members are counted on the cluster.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; rows with
the same id and text are copies of each other; null ids stay null; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import id_key, saved, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
GRAM = 50
STREAM = 1 << 20
SORTED_MEMBERS = 8_000
TOGETHER = 100_000
U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))


def byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(1000 + which).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


class Hashes:
    """Polynomial prefix hashes of a byte string: the hash of any part in one step."""

    def __init__(self, data: np.ndarray, which: int, up: np.ndarray, down: np.ndarray):
        self.down = down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values(which)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


class Scale:
    """Powers of a base and of its inverse, as long as needed."""

    def __init__(self, which: int):
        self.base, self.n = BASES[which], 0

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            # In steps, so that slightly longer strings do not compute all anew.
            self.n = n = max(1 << 12, 1 << (n - 1).bit_length())
            self.up, self.down = powers(self.base, n), powers(inverse(self.base), n)
        return self.up, self.down


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    best, have = keys, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    rest = width - have
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def anchors(
    data: np.ndarray, bounds: np.ndarray, scales, length: int, gram: int, stream: int
) -> dict[str, np.ndarray]:
    """Anchors of the documents data[bounds[i]:bounds[i + 1]], each once."""
    reach = length - gram
    found: list[tuple] = []
    for w0 in range(int(bounds[0]), int(bounds[-1]) - length + 1, stream):
        w1 = min(w0 + stream, int(bounds[-1]) - length + 1)
        lo, hi = max(int(bounds[0]), w0 - reach), min(int(bounds[-1]), w1 + 2 * length)
        part = data[lo:hi]
        first = Hashes(part, 0, *scales[0].take(len(part) + 1))
        starts = np.arange(w0 - lo, w1 - lo)
        owner = np.searchsorted(bounds, starts + lo, side="right") - 1
        whole = starts + lo + length <= bounds[owner + 1]
        if not whole.any():
            continue
        places = np.arange(w0 - lo, w1 - lo + reach)
        pieces = mix(first.of(places, gram))
        bits = U(int(len(places)).bit_length())
        keys = (pieces >> bits) << bits | np.arange(len(places), dtype=np.uint64)
        chosen = sliding_min(keys, reach + 1)[whole] & ((U(1) << bits) - U(1))
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])].astype(np.int64)
        at = places[chosen]
        doc = np.searchsorted(bounds, at + lo, side="right") - 1
        left = np.minimum(reach, at + lo - bounds[doc])
        right = np.minimum(length, bounds[doc + 1] - at - lo)
        second = Hashes(part, 1, *scales[1].take(len(part) + 1))
        shape = (left * 4096 + right).astype(np.uint64)
        context = mix(second.of(at - left, left + right) + shape * BASES[0])
        found.append((at + lo, doc, left, right, pieces[chosen], context))
    names = ["at", "doc", "left", "right", "piece", "context"]
    if not found:
        return {n: np.zeros(0, np.int64) for n in names}
    joined = [np.concatenate(c) for c in zip(*found)]
    once = np.unique(joined[0], return_index=True)[1]
    return {n: c[once] for n, c in zip(names, joined)}


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the bounds of its values, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    return data, bounds.astype(np.int64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


# --- sorting suffixes -----------------------------------------------------------------


class Suffixes:
    """Suffixes of a byte string from ``start``, cut at ``size`` bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, scale: Scale):
        self.data = np.concatenate([data, np.zeros(1, np.uint8)])
        self.hashes = Hashes(data, 0, *scale.take(len(data) + 2))
        self.start, self.size = start, size

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        a, b = self.start[i], self.start[j]
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.size[i], self.size[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.hashes.of(a, middle) == self.hashes.of(b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equal ones by ``or_equal``."""
        n = self.common(i, j)
        end_i, end_j = n >= self.size[i], n >= self.size[j]
        smaller = self.data[self.start[i] + n] < self.data[self.start[j] + n]
        return np.where(end_i & end_j, or_equal, np.where(end_i | end_j, end_i, smaller))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order within each group (members of a group are neighbours), by mergesort."""
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([first, [n]]))
        begin = np.repeat(first, size)
        stop = begin + np.repeat(size, size)
        run = 1
        while run < size.max(initial=0):
            slot = np.flatnonzero(stop - begin > run)
            place = slot - begin[slot]
            pair = begin[slot] + place // (2 * run) * 2 * run
            is_left = place % (2 * run) < run
            other = np.where(is_left, pair + run, pair)
            other_end = np.minimum(np.where(is_left, pair + 2 * run, pair + run), stop[slot])
            low = np.minimum(other, other_end)
            high = np.maximum(low, other_end)
            base = low.copy()
            me = order[slot]
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                middle = (low[live] + high[live]) // 2
                # Right run before me only if smaller; left run also if equal.
                before = self.less(order[middle], me[live], ~is_left[live])
                low[live] = np.where(before, middle + 1, low[live])
                high[live] = np.where(before, high[live], middle)
            own = slot - np.where(is_left, pair, pair + run)
            new = order.copy()
            new[pair + own + (low - base)] = me
            order = new
            run *= 2
        return order

    def longest(self, group: np.ndarray) -> np.ndarray:
        """For each member, the longest common extension with another of its group."""
        order = self.sort(group)
        best = np.zeros(len(group), np.int64)
        together = np.flatnonzero(group[order[1:]] == group[order[:-1]])
        i, j = order[together], order[together + 1]
        n = self.common(i, j)
        np.maximum.at(best, i, n)
        np.maximum.at(best, j, n)
        return best


def covered(
    data: np.ndarray,
    bounds: np.ndarray,
    left: np.ndarray,
    group: np.ndarray,
    scale: Scale,
    length: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(most, least): how far left of its anchor a member's outermost recurring strings
    start; most is -1 if none recurs. Members of a group are neighbours."""
    n = len(group)
    size = np.diff(bounds)
    right = size - left
    most, least = np.full(n, -1), np.full(n, length + 1)
    possible = np.ones(n, bool)
    far_l, far_r = left.copy(), np.minimum(right, length)
    if n <= SORTED_MEMBERS:
        anchor = bounds[:-1] + left
        far_r = Suffixes(data, anchor, np.minimum(right, length), scale).longest(group)
        back = np.ascontiguousarray(data[::-1])
        far_l = Suffixes(back, len(data) - anchor, left, scale).longest(group)
        possible = far_l + far_r >= length
    members = np.flatnonzero(possible)
    if not len(members):
        return most, least
    group, anchor = group[members].astype(np.uint64), (bounds[:-1] + left)[members]
    far_l, far_r = far_l[members], far_r[members]
    values, (up, _) = byte_values(1), Scale(1).take(length + 1)
    base, top = BASES[1], up[length - 1]
    padded = np.concatenate([np.zeros(length, np.uint8), data, np.zeros(length, np.uint8)])
    at = anchor + length
    # Rolling hash of the strings that start j bytes left of the anchors.
    h = np.zeros(len(members), np.uint64)
    for k in range(length):
        h += values[padded[at + k]] * up[k]
    high, low = np.full(len(members), -1), np.full(len(members), length + 1)
    mate_high, mate_low = high.copy(), high.copy()
    for j in range(int(far_l.max()) + 1):
        if j:
            h = (h - values[padded[at - j + length]] * top) * base + values[padded[at - j]]
        fits = np.flatnonzero((far_l >= j) & (far_r >= length - j))
        if len(fits) < 2:
            continue
        key = mix(h[fits] + group[fits] * BASES[0])
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(fits), bool)
        mate = np.zeros(len(fits), np.int64)
        a, b = order[1:][same], order[:-1][same]
        hit[a] = hit[b] = True
        mate[b], mate[a] = a, b
        who, mates = fits[hit], fits[mate[hit]]
        high[who], mate_high[who] = j, mates
        new = low[who] > length
        low[who[new]], mate_low[who[new]] = j, mates[new]
    good = np.flatnonzero(high >= 0)
    for j, mate in ((high, mate_high), (low, mate_low)):
        for k in range(length):
            step = k - j[good]
            if (padded[at[good] + step] != padded[at[mate[good]] + step]).any():
                raise ValueError("two different strings have one hash; change BASES")
    most[members[good]], least[members[good]] = high[good], low[good]
    return most, least


# --- jobs -----------------------------------------------------------------------------

DOC = ["id", "mark"]


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        id_key(id_col).alias("id"),
        F.xxhash64(text).alias("mark"),
        text.cast("binary").alias("text"),
    )


def find_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales = (Scale(0), Scale(1))
        for part in parts:
            data, bounds = binary_column(part.column(2))
            a = anchors(data, bounds, scales, length, gram, STREAM)
            ids, marks = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[a["doc"]], pa.int64()),
                    pa.array(marks[a["doc"]], pa.int64()),
                    pa.array(a["at"] - bounds[a["doc"]], pa.int64()),
                    pa.array(a["right"], pa.int32()),
                    signed(a["piece"]),
                    signed(a["context"]),
                ],
                ["id", "mark", "at", "right", "piece", "context"],
            )

    schema = "id bigint, mark bigint, at bigint, right int, piece bigint, context bigint"
    return rows.where(F.octet_length("text") >= length).mapInArrow(run, schema)


def meet(found: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors whose piece occurs again: ``solved`` if their context does too, ``asks``
    if their contexts must be read; a solved one may also ask, as a partner."""
    ordered = Window.partitionBy("piece").orderBy("context")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = F.col
    before, after = F.lag("context").over(ordered), F.lead("context").over(ordered)
    marked = found.withColumns(
        {
            "before": before,
            "after": after,
            "several": F.first("context").over(whole) != F.last("context").over(whole),
        }
    ).withColumns(
        {
            "first": c("before").isNull() | (c("before") != c("context")),
            "last": c("after").isNull() | (c("after") != c("context")),
        }
    )
    return marked.select(
        *DOC,
        "at",
        "right",
        "piece",
        (~(c("first") & c("last"))).alias("solved"),
        (c("several") & c("first")).alias("asks"),
    ).where("solved or asks")


def cut_contexts(rows: DataFrame, asking: DataFrame, length: int, gram: int) -> DataFrame:
    """(piece, id, mark, at, left, solved, context) of the anchors that ask."""
    wanted = asking.groupBy(*DOC).agg(
        F.collect_list(F.struct("at", "piece", "solved")).alias("wanted")
    )
    reach = length - gram

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, bounds = binary_column(part.column(2))
            lists = part.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(part.num_rows), counts)
            flat = lists.flatten()
            at, piece, solved = (flat.field(i) for i in range(3))
            place = at.to_numpy()
            left = np.minimum(reach, place)
            start = bounds[doc] + place - left
            stop = np.minimum(bounds[doc] + place + length, bounds[doc + 1])
            sizes = stop - start
            ends = np.concatenate([[0], np.cumsum(sizes)])
            taken = data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], sizes)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece,
                    part.column(0).take(pa.array(doc)),
                    part.column(1).take(pa.array(doc)),
                    at,
                    pa.array(left, pa.int32()),
                    solved,
                    pa.Array.from_buffers(
                        pa.binary(),
                        len(sizes),
                        [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken)],
                    ),
                ],
                ["piece", "id", "mark", "at", "left", "solved", "context"],
            )

    schema = (
        "piece bigint, id bigint, mark bigint, at bigint, left int, solved boolean, context binary"
    )
    return rows.join(wanted, DOC).select(*DOC, "text", "wanted").mapInArrow(run, schema)


def sort_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Covered ranges (id, mark, start, stop) of the anchors that are not solved."""

    def work(rows: pa.Table, scale: Scale) -> pa.RecordBatch:
        data, bounds = binary_column(rows.column("context"))
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        piece = rows.column("piece").to_numpy()
        group = np.cumsum(np.concatenate([[0], piece[1:] != piece[:-1]]))
        left = rows.column("left").to_numpy().astype(np.int64)
        most, least = covered(data, bounds, left, group, scale, length)
        use = np.flatnonzero((most >= 0) & ~rows.column("solved").to_numpy())
        at = rows.column("at").to_numpy()[use]
        ids, marks = (rows.column(c).to_numpy()[use] for c in DOC)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(marks, pa.int64()),
                pa.array(at - most[use], pa.int64()),
                pa.array(at - least[use] + length, pa.int64()),
            ],
            ["id", "mark", "start", "stop"],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, held, count = Scale(0), [], 0
        for part in parts:
            # Whole groups at a time; the last one of a batch may go on in the next.
            for i in range(0, part.num_rows, SORTED_MEMBERS):
                some = part.slice(i, SORTED_MEMBERS)
                if not some.num_rows:
                    continue
                piece = some.column(0).to_numpy()
                cut = int(np.flatnonzero(piece != piece[-1])[-1]) + 1 if piece[0] != piece[-1] else 0
                same = bool(held) and held[-1].column(0)[-1].as_py() == piece[0]
                if held and not same:
                    yield work(pa.Table.from_batches(held), scale)
                    held = []
                if cut:
                    yield work(pa.Table.from_batches([*held, some.slice(0, cut)]), scale)
                    held = []
                held.append(some.slice(cut))
        if held:
            yield work(pa.Table.from_batches(held), scale)

    placed = contexts.repartition("piece").sortWithinPartitions("piece")
    return placed.mapInArrow(run, "id bigint, mark bigint, start bigint, stop bigint")


def count_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for a task: their strings, counted by hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                data = np.frombuffer(part.column(6)[i].as_py(), np.uint8)
                left = part.column(4)[i].as_py()
                starts = np.arange(0, min(left, len(data) - length) + 1)
                sums = [
                    mix(Hashes(data, w, *Scale(w).take(len(data) + 1)).of(starts, length))
                    for w in (0, 1)
                ]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(c).slice(i, 1).take(pa.array(np.zeros(n, np.int64)))
                        for c in (0, 1, 2, 3, 5)
                    ]
                    + [pa.array(left - starts, pa.int32()), signed(sums[0]), signed(sums[1])],
                    ["piece", "id", "mark", "at", "solved", "j", "h1", "h2"],
                )

    schema = (
        "piece bigint, id bigint, mark bigint, at bigint, solved boolean, j int, "
        "h1 bigint, h2 bigint"
    )
    strings = contexts.mapInArrow(run, schema)
    key = ["piece", "j", "h1", "h2"]
    again = strings.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        strings.where("not solved")
        .join(again.select(*key), key, "left_semi")
        .groupBy(*DOC, "at")
        .agg(F.max("j").alias("most"), F.min("j").alias("least"))
        .select(
            *DOC,
            F.expr("at - most").alias("start"),
            F.expr(f"at - least + {length}").alias("stop"),
        )
    )


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    together: int = TOGETHER,
) -> DataFrame:
    """(id, mark, ranges): the covered ranges of each document that has any."""
    rows = texts(docs, id_col, text_col)
    met = saved(meet(find_anchors(rows, length, gram), length, gram))
    asking = met.where("asks")
    large = asking.groupBy("piece").count().where(F.col("count") > together).select("piece")
    contexts = cut_contexts(rows, asking, length, gram)
    reach = length - gram
    ranges = met.where("solved").select(
        *DOC,
        (F.col("at") - F.least(F.col("at"), F.lit(reach))).alias("start"),
        (F.col("at") + F.col("right")).alias("stop"),
    )
    if large.limit(1).count():
        contexts = saved(contexts)
        hot = contexts.join(large, "piece", "left_semi").select(*contexts.columns)
        ranges = ranges.union(count_contexts(hot, length))
        contexts = contexts.join(large, "piece", "left_anti").select(*contexts.columns)
    ranges = ranges.union(sort_contexts(contexts, length))
    return ranges.groupBy(*DOC).agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges")
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    real: bool = True,
    **options,
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``real`` the kept bytes and the removed (start, stop) ranges."""
    found = repeats(docs, id_col, text_col, **options)
    rows = docs.select(
        id_key(id_col).alias("id"),
        F.xxhash64(whole_text(text_col)).alias("mark"),
        col(id_col).cast("bigint").alias("plain"),
        whole_text(text_col).cast("binary").alias("text"),
    )
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[], [], [], [], [], []]
            for text, ranges in zip(part.column(1), part.column(2)):
                data = text.as_buffer()
                view = memoryview(data) if data else memoryview(b"")
                spans: list[list[int]] = []
                for r in sorted((r["start"], r["stop"]) for r in ranges.as_py() or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                digest, kept, at = hashlib.sha256(), [], 0
                for a, b in [*spans, [len(view), len(view)]]:
                    digest.update(view[at:a])
                    if real:
                        kept.append(bytes(view[at:a]))
                    at = b
                values = [len(view), sum(b - a for a, b in spans), len(spans), digest.hexdigest()]
                if real:
                    values += [b"".join(kept), [{"start": a, "stop": b} for a, b in spans]]
                for column, value in zip(out, values):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), spans_type]
            used = 6 if real else 4
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, t) for c, t in zip(out[:used], types)]],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"][
                    : used + 1
                ],
            )

    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if real:
        schema += ", kept binary, removed array<struct<start:bigint,stop:bigint>>"
    joined = rows.join(found, DOC, "left").select("plain", "text", "ranges")
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
