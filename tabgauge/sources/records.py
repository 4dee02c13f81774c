"""Records of CSV files whose quoted fields may hold line breaks, read in parallel.

A file is read as lines, in byte ranges as Spark's text reader cuts them, so a range can
begin inside a quoted field. What a line does depends on where it begins only through one
bit, inside quotes or not, and lines compose:

1. The lines with a quote give each range a map from that bit at its start to the bit at
   its end. The maps of a file, one row per range, are combined in order and fix the true
   start of every range.
2. Each range is cut into records by itself. Lines of a record that a range ends or begins
   within are put together with those of its neighbours; all other records stay in place.

Where no record goes on over a line end, and this is what step 1 finds, Spark's own reader
takes each line as a record. Quotes are read as common CSV readers do: a quote opens a field
only as its first character, a doubled one inside stands for itself, and what follows the
closing one up to the comma is plain. Such stray characters keep the quotes around them.
Lines end at a line feed, with a carriage return before it or not; a file with bare carriage
returns as line ends is read if it has no quotes. Blank lines between records are skipped.
The first record of each file is its header. Memory is bounded by a batch of lines and the
longest record.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pickled with the functions, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'
BLANK = " \t\r\n\x0b\x0c"
OPTIONS = {"header": True, "escape": QUOTE}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is still open where the line ends."""
    at = 0
    if not inside and line[:1] == QUOTE:
        at, inside = 1, True
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == QUOTE:
                at += 2
                continue
            # The rest of this field is plain.
            at = line.find(",", at + 1)
            if at < 0:
                return False
            inside = line[at + 1 : at + 2] == QUOTE
            at += 2 if inside else 1
        else:
            at = line.find("," + QUOTE, at)
            if at < 0:
                return False
            at, inside = at + 2, True


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines in order within each byte range of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
    )


class Range:
    """What the lines of a range make of a quoted field that is open, or not, at its start."""

    def __init__(self):
        # Open at the end, if the range starts outside and inside of quotes.
        self.ends = [False, True]
        # Whether a line ends outside, if the range starts inside.
        self.closes = False
        # Whether every line is a record, if the range starts outside.
        self.plain = True

    def add(self, line: str) -> None:
        if "\r" in line[:-1]:
            self.plain = False
        outside = ends_inside(line, self.ends[0])
        if self.ends[0] == self.ends[1]:
            self.ends = [outside, outside]
        else:
            self.ends = [outside, ends_inside(line, self.ends[1])]
        self.plain &= not outside
        self.closes |= not self.ends[1]


def range_maps(lines: DataFrame) -> DataFrame:
    """(file, start, outside, inside, closes, plain) of each range that has a quote."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done = None, Range(), []

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
            columns = zip(*done) if done else [[] for _ in kinds]
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for part in parts:
            for file, start, line in zip(*[c.to_pylist() for c in part.columns]):
                if (file, start) != key:
                    if key is not None:
                        done.append((*key, *now.ends, now.closes, now.plain))
                    key, now = (file, start), Range()
                now.add(line)
        if key is not None:
            done.append((*key, *now.ends, now.closes, now.plain))
        yield batch()

    names = ["file", "start", "outside", "inside", "closes", "plain"]
    schema = "file string, start bigint, " + ", ".join(f"{n} boolean" for n in names[2:])
    return lines.where(F.contains("value", F.lit(QUOTE))).mapInArrow(run, schema)


# Per file: starts of ranges that have a quote, and where the record began that is open at
# the end of each; None where none is.
Opened = dict[str, tuple[list[int], list[int | None]]]


def open_records(maps: list) -> Opened:
    """The maps of each file combined in order."""
    by_file = defaultdict(list)
    for row in maps:
        by_file[row["file"]].append(row)
    found: Opened = {}
    for file, rows in by_file.items():
        rows.sort(key=lambda r: r["start"])
        begun, keys = None, []
        for r in rows:
            if begun is None:
                begun = r["start"] if r["outside"] else None
            elif not r["inside"]:
                begun = None
            elif r["closes"]:
                begun = r["start"]
            keys.append(begun)
        found[file] = ([r["start"] for r in rows], keys)
    return found


class Cutter:
    """Cuts the lines of one range into records."""

    def __init__(self, file: str, start: int, opened: Opened):
        self.file, self.start = file, start
        starts, keys = opened.get(file, ([], []))
        before = bisect_left(starts, start) - 1
        # Where the record began that these lines belong to, and its lines so far.
        self.key = keys[before] if before >= 0 else None
        self.inside = self.key is not None
        self.lines: list[str] = []
        self.header = start == 0

    def taken(self, whole: list[pa.Array], lines: pa.Array) -> None:
        """Keep lines that are records, but for the file's first."""
        if self.header:
            for i, line in enumerate(lines):
                if (line.as_py()).strip(BLANK):
                    self.header, lines = False, lines.slice(i + 1)
                    break
            else:
                return
        if len(lines):
            whole.append(lines)

    def close(self, whole: list[pa.Array], parts: list[tuple]) -> None:
        """End the open record, or this range's part of it."""
        text = "\n".join(self.lines)
        if self.key is not None:
            parts.append((self.file, self.key, self.start, self.header and self.key == self.start, text))
            self.header = self.header and self.key != self.start
        else:
            self.taken(whole, pa.array([text]))
        self.lines, self.key = [], None

    def add(self, lines: pa.Array, whole: list[pa.Array], parts: list[tuple]) -> None:
        quoted = pc.indices_nonzero(pc.match_substring(lines, QUOTE)).to_pylist()
        begin = 0
        for i in quoted:
            line = lines[i].as_py()
            after = ends_inside(line, self.inside)
            if self.inside and not after:
                self.lines += lines.slice(begin, i + 1 - begin).to_pylist()
                self.close(whole, parts)
                begin = i + 1
            elif after and not self.inside:
                self.taken(whole, lines.slice(begin, i - begin))
                begin = i
            self.inside = after
        rest = lines.slice(begin)
        if self.inside:
            self.lines += rest.to_pylist()
        else:
            self.taken(whole, rest)

    def end(self, whole: list[pa.Array], parts: list[tuple]) -> None:
        if self.inside and self.lines:
            # The record began here unless these lines go on with an earlier one.
            self.key = self.start if self.key is None else self.key
            self.close(whole, parts)


def cut(lines: DataFrame, opened: Opened) -> DataFrame:
    """(file, key, start, header, value): whole records with null in front, and parts of
    records that began in the range ``key``."""
    held = lines.sparkSession.sparkContext.broadcast(opened)
    names = ["file", "key", "start", "header", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, parts = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            for values in whole:
                nulls = [pa.nulls(len(values), kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays([*nulls, values], names)
            if parts:
                columns = [list(c) for c in zip(*parts)]
                arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()])]
                yield pa.RecordBatch.from_arrays(arrays, names)
            whole.clear()
            parts.clear()

        for batch in batches:
            files, starts, values = batch.columns
            at = 0
            while at < batch.num_rows:
                file, start = files[at].as_py(), starts[at].as_py()
                same = pc.and_(pc.equal(files, files[at]), pc.equal(starts, starts[at]))
                n = pc.sum(same.slice(at)).as_py()
                if now is None or (now.file, now.start) != (file, start):
                    if now is not None:
                        now.end(whole, parts)
                    now = Cutter(file, start, held.value)
                now.add(values.slice(at, n), whole, parts)
                at += n
            yield from out()
        if now is not None:
            now.end(whole, parts)
            yield from out()

    schema = "file string, key bigint, start bigint, header boolean, value string"
    return lines.mapInArrow(run, schema)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """The table with every column as text, named by the header."""
    names = spark.read.options(**OPTIONS, multiLine=True).csv(path).columns
    lines = text_lines(spark, path)
    # One row per range that has a quote.
    maps = range_maps(lines).collect()
    if all(r["plain"] for r in maps):
        return spark.read.options(**OPTIONS, enforceSchema=True).csv(path).toDF(*names)
    opened = open_records(maps)
    records = cut(lines, opened)
    whole = records.where("file IS NULL").select("value")
    if any(k is not None for _, keys in opened.values() for k in keys):
        part = F.struct("start", "value")
        joined = (
            records.where("file IS NOT NULL")
            .groupBy("file", "key")
            .agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("header").alias("header"))
            .where("NOT header")
        )
        whole = whole.union(joined.select(F.array_join(F.col("parts.value"), "\n").alias("value")))
    bare = F.regexp_replace("value", r"\r\z", "")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = F.from_csv(bare, schema.toDDL(), {"escape": QUOTE}).alias("cells")
    filled = whole.where(F.col("value").rlike(r"\S"))
    return filled.select(cells).select("cells.*").toDF(*names)
