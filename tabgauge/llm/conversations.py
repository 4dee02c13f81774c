"""Conversation structure repair by weighted interval parsing.

A conversation is well formed when its role initials are ``(s?(ua)+)?``. Rows may be kept
(0), given the role user or assistant (1) or deleted (2, forced for blank rows and
duplicates), and empty turns inserted (5); a truncated row that is not deleted costs 5 more.

The repair grammar is in Chomsky normal form. Its nonterminals ``[p, q]`` are pairs of
places in the pattern: the edits of a span that lead from p to q. ``[p, r] -> [p, q] [q, r]``
joins two neighbouring spans, and ``[p, q]`` of a single row is an edit of it, closed under
insertions on both sides. A cell is the least (cost, audit), the audit being the initials of
the edits; of equal costs no audit is the beginning of another, so least cells of the parts
give the least cell of the whole. Every place in between is a nonterminal of its own, so one
cut per span sees all derivations, and spans can be combined bottom-up by length: 1, 2, 4 ...

- Faults and role initials are column expressions. Equal rows of a turn are merged into one
  with a count before any exchange; a row is a duplicate if its (role, text), as a digest of
  128 bits, has an earlier turn in the conversation.
- Narrow rows without text are sorted by (conversation, turn) over range partitions, so a
  conversation of any size is spread over tasks. Each task parses its stretch of a
  conversation into one table of cells. Only the first and last conversation of a partition
  can go on elsewhere; their tables are combined in rounds, ``FAN`` neighbours at a time.
- Rows with their text then meet their audit in one sorted exchange and are written out, or
  hashed, as they stream past. A SHA-256 runs over one conversation in order, so only there
  one task sees a whole conversation, a batch of rows at a time, with its audit.

Defined results: a null role or text is one space, and a null conversation id is a
conversation of its own. Null turns come first. Rows of one turn are taken by role, then by
digest, equal rows next to each other. A role is judged by its first character alone, as it
is written; an empty role fits nowhere. Very long texts are held one batch at a time. Extra
columns are not read. An empty table gives an empty result. ``gaps`` beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import saved

# Pickled with the functions, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Costs of the edits; fixed values.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Places in the pattern: at the start, after s, after u, after a.
PLACES = 4
START, AFTER_S, AFTER_U, AFTER_A = range(PLACES)
STEPS = {
    "s": {START: AFTER_S},
    "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
    "a": {AFTER_U: AFTER_A},
}
ENDS = (START, AFTER_A)
LEGAL = ("su", "ua", "au")
WHITE_CHARACTERS = "\t\n\x0b\x0c\r "
# Spans of this many rows are remembered; the tables of this many of them.
SHORT = 8
REMEMBERED = 50_000
# Rows of a conversation that one table of cells covers at most.
STRETCH = 100_000
FAN = 8

# A table is a flat tuple of cells, [p, q] at p * PLACES + q; None where nothing leads there.
Cell = tuple[int, str] | None
Table = tuple[Cell, ...]


def combine(left: Table, right: Table) -> Table:
    """The cells of a span from those of its two parts."""
    cells: list[Cell] = []
    for p in range(PLACES):
        row = left[p * PLACES : (p + 1) * PLACES]
        for r in range(PLACES):
            column = right[r::PLACES]
            both = [(a, b) for a, b in zip(row, column) if a is not None and b is not None]
            if not both:
                cells.append(None)
                continue
            cost = min(a[0] + b[0] for a, b in both)
            # Audits are joined only where the costs tie for the least.
            cells.append((cost, min(a[1] + b[1] for a, b in both if a[0] + b[0] == cost)))
    return tuple(cells)


def edges(letters: str, edit: str, cost: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The steps along any of the letters, as one edit."""
    return {(p, q): (cost, edit) for x in letters for p, q in STEPS.get(x, {}).items()}


def table(*cells: dict[tuple[int, int], tuple[int, str]]) -> Table:
    """The least cells of several sets of them."""
    found = [[c[p, q] for c in cells if (p, q) in c] for p in range(PLACES) for q in range(PLACES)]
    return tuple(min(f) if f else None for f in found)


def bottom_up(tables: list[Table]) -> Table:
    """Neighbouring spans combined by length until one is left."""
    while len(tables) > 1:
        pairs = [combine(a, b) for a, b in zip(tables[::2], tables[1::2])]
        tables = pairs + ([tables[-1]] if len(tables) % 2 else [])
    return tables[0]


class Parser:
    """Cells of spans of rows; those of short spans are remembered."""

    def __init__(self):
        still = {(p, p): (0, "") for p in range(PLACES)}
        one = table(still, edges("ua", "I", INSERT))
        # Any number of insertions: the closure of one.
        self.insertions = bottom_up([one] * PLACES)
        self.short: dict[str, Table] = {}

    def single(self, kind: str) -> Table:
        """The cells of one row: ``d`` for a row that must go, else its role's initial
        (``o`` for others), in upper case if it is truncated."""
        edited = {(p, p): (DELETE, "D") for p in range(PLACES)}
        if kind == "d":
            found = table(edited)
        else:
            extra = TRUNCATED if kind.isupper() else 0
            kept = edges(kind.lower(), "K", extra)
            found = table(edited, kept, edges("ua", "R", RENAME + extra))
        return combine(combine(self.insertions, found), self.insertions)

    def span(self, kinds: str) -> Table:
        found = self.short.get(kinds)
        if found is None:
            if len(self.short) >= REMEMBERED:
                self.short.clear()
            found = self.short[kinds] = bottom_up([self.single(k) for k in kinds])
        return found

    def parse(self, kinds: str) -> Table:
        """The cells of a span of rows, given by their kinds."""
        if not kinds:
            return self.insertions
        return bottom_up([self.span(kinds[i : i + SHORT]) for i in range(0, len(kinds), SHORT)])


def best(cells: Table) -> tuple[int, str]:
    """The cheapest way from the start to a place where a conversation may end."""
    return min(c for c in (cells[START * PLACES + q] for q in ENDS) if c is not None)


class Stretch:
    """Rows of one conversation that follow each other: counts, turns and kinds."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None
        self.kinds: list[str] = []
        self.rows = 0
        self.cells: Table | None = None

    def add(self, turn, initial: str, blank: bool, seen: bool, cut: bool, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.illegal += copies - 1
        self.last = initial
        if blank:
            self.blank += copies
            self.kinds.append("d" * copies)
        elif seen:
            self.duplicate += copies
            self.kinds.append("d" * copies)
        else:
            kind = initial if initial and initial in STEPS else "o"
            self.truncated += cut
            self.duplicate += copies - 1
            self.kinds.append((kind.upper() if cut else kind) + "d" * (copies - 1))
        self.rows += copies

    def close(self, parser: Parser) -> None:
        self.cells = parser.parse("".join(self.kinds))
        self.kinds = []

    def follow(self, other: Stretch) -> None:
        """Append a later stretch, but for its cells."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.high is not None and other.low == self.high:
            self.turns -= 1
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last

    def record(self, whole: bool) -> dict:
        """The fields of a row of stretches; the result itself where nothing can follow."""
        row = {name: getattr(self, name) for name in self.FIELDS}
        cells = [c if c is not None else (None, None) for c in self.cells]
        if whole:
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            row["gaps"] = gaps if gaps < 2**63 else None
            row["cost"], row["audit"] = best(self.cells)
        else:
            row["gaps"] = row["cost"] = row["audit"] = None
        row["costs"] = None if whole else [c[0] for c in cells]
        row["audits"] = None if whole else [c[1] for c in cells]
        return row

    @classmethod
    def of(cls, row: dict) -> Stretch:
        made = cls()
        for name in cls.FIELDS:
            setattr(made, name, row[name])
        made.cells = tuple(
            None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])
        )
        return made


STRETCHES = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
    "low bigint, high bigint, first string, last string, gaps bigint, cost bigint, "
    "audit string, costs array<bigint>, audits array<string>"
)
KINDS = {
    **{name: pa.int64() for name in ("blank", "duplicate", "truncated", "illegal", "turns")},
    "low": pa.int64(),
    "high": pa.int64(),
    "first": pa.string(),
    "last": pa.string(),
    "gaps": pa.int64(),
    "cost": pa.int64(),
    "audit": pa.string(),
    "costs": pa.list_(pa.int64()),
    "audits": pa.list_(pa.string()),
}


def rows_out(keys: dict[str, pa.DataType], rows: list[dict]) -> pa.RecordBatch:
    kinds = {**keys, **KINDS}
    arrays = [pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def plain(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv, turn, role, text, copies) of the rows as they are."""
    space = F.lit(" ")
    return df.select(
        col(conv_col).alias("conv"),
        col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(col(role_col).cast("string"), space).alias("role"),
        F.coalesce(col(text_col).cast("string"), space).alias("text"),
        F.lit(1).alias("copies"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """The rows with reproducible damage; what is dropped stays as a row of 0 copies."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    lot = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    text = (
        F.when(lot == 1, F.lit(""))
        .when(lot == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    return rows.select(
        "conv",
        "turn",
        F.when(lot == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """The rows with ``same``, a digest of 128 bits of role and text."""
    both = F.sha2(F.concat(F.sha2("role", 256), F.col("text")), 256)
    return rows.withColumn("same", F.unhex(F.substring(both, 1, 32)))


def faults(rows: DataFrame) -> DataFrame:
    """One narrow row per different row of a turn: initial, blank, seen, cut, copies."""
    last = F.right(F.rtrim("text", F.lit(WHITE_CHARACTERS)), F.lit(1))
    narrow = marked(rows).select(
        "conv",
        "turn",
        "role",
        "same",
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
        "copies",
    )
    merged = narrow.groupBy("conv", "turn", "role", "same", "blank", "cut").agg(
        F.sum("copies").alias("copies")
    )
    # A null turn comes before all others.
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    held = merged.where("copies > 0").withColumn("place", place)
    firsts = (
        held.groupBy("conv", "same")
        .agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("conv").alias("of"), F.col("same").alias("like"), "earliest")
    )
    on = F.col("conv").eqNullSafe(F.col("of")) & (F.col("same") == F.col("like"))
    seen = F.coalesce(place > F.col("earliest"), F.lit(False))
    return merged.join(firsts, on, "left").select(
        "conv",
        "turn",
        "role",
        "same",
        F.left("role", F.lit(1)).alias("initial"),
        "blank",
        seen.alias("seen"),
        "cut",
        "copies",
    )


ORDER = ("conv", "turn", "role", "same")


def stretches(found: DataFrame, parts: int) -> DataFrame:
    """Each partition's stretches of conversations, in order: conv, part, at, whole, fields."""
    conv = found.schema["conv"].dataType.simpleString()
    ordered = found.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    names = ["conv", "turn", "initial", "blank", "seen", "cut", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        # A conversation is whole here unless it is the partition's first or last one.
        name, now, at, part, kind = None, None, 0, 0, None
        first = True
        done: list[dict] = []

        def closed(whole: bool) -> dict:
            now.close(parser)
            return {"conv": name, "part": part, "at": at, "whole": whole, **now.record(whole)}

        def batch() -> pa.RecordBatch:
            keys = {"conv": kind, "part": pa.int32(), "at": pa.int64(), "whole": pa.bool_()}
            return rows_out(keys, done)

        for held in batches:
            kind = held.column(1).type
            part = held.column(0)[0].as_py() if held.num_rows else part
            columns = [held.column(i).to_pylist() for i in range(1, 8)]
            for conv_id, turn, initial, blank, seen, cut, copies in zip(*columns):
                if now is None or conv_id != name:
                    if now is not None:
                        done.append(closed(not first and not at))
                        first = False
                    name, now, at = conv_id, Stretch(), 0
                elif now.rows >= STRETCH:
                    done.append(closed(False))
                    now, at = Stretch(), at + 1
                now.add(turn, initial, blank, seen, cut, copies)
            if done:
                yield batch()
                done = []
        if now is not None:
            done.append(closed(False))
            yield batch()

    schema = f"conv {conv}, part int, at bigint, whole boolean, {STRETCHES}"
    return ordered.select(F.spark_partition_id().alias("part"), *names).mapInArrow(run, schema)


def joined(edge: DataFrame, rounds: int) -> DataFrame:
    """Stretches of conversations that go on over partitions, combined by neighbours."""
    conv = edge.schema["conv"].dataType.simpleString()

    def together(last: bool):
        def run(group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["at"]))
            parts = [Stretch.of(r) for r in rows]
            whole = parts[0]
            cells = [p.cells for p in parts]
            for other in parts[1:]:
                whole.follow(other)
            whole.cells = bottom_up(cells)
            keys = {"conv": group.schema.field("conv").type, "part": pa.int32(), "at": pa.int64()}
            row = {"conv": rows[0]["conv"], "part": rows[0]["part"], "at": 0, **whole.record(last)}
            return pa.Table.from_batches([rows_out(keys, [row])])

        return run

    # Stretches of one partition first, then of FAN partitions, and so on.
    rest = edge.drop("whole")
    schema = f"conv {conv}, part int, at bigint, {STRETCHES}"
    for i in range(rounds + 1):
        near = F.floor(F.col("part") / F.lit(FAN**i)).alias("near")
        rest = rest.groupBy("conv", near).applyInArrow(together(i == rounds), schema)
    return rest


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def find_repairs(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows`` are (conv, turn, role, text, copies). Writes its stretches to the scratch folder.
    """
    if parts is None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = saved(stretches(faults(rows), parts))
    rounds = max(1, math.ceil(math.log(max(parts, 2), FAN)))
    edge = joined(found.where("NOT whole"), rounds)
    return found.where("whole").select("conv", *RESULT).union(edge.select("conv", *RESULT))


class Repair:
    """The turns of one conversation after its edits, as its rows come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def next_role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def turn(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.last = role[:1]
        return edit, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.turn("I", self.next_role(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The turns up to this row, and the row itself if it stays."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.turn(edit, role if edit == "K" else self.next_role(), text)


def apply_repairs(rows: DataFrame, repairs: DataFrame, real: bool = True) -> DataFrame:
    """The repaired turns, (conv, position, edit, role, text); with ``real=False`` one row
    per conversation with the columns of ``find_repairs`` and ``repaired_sha256``, the hash
    of the turns as ``role:text``, joined by newlines."""
    conv = rows.schema["conv"].dataType.simpleString()
    turns = marked(rows).where("copies > 0").withColumn("about", F.lit(None).cast("string"))
    about = F.to_json(F.struct(*RESULT), {"ignoreNullFields": "false"})
    heads = repairs.select(
        "conv",
        *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "text")],
        F.lit(0).alias("copies"),
        F.lit(None).cast("binary").alias("same"),
        about.alias("about"),
    )
    both = heads.unionByName(turns)
    # The repair of a conversation comes before its rows.
    order = ["conv", F.col("about").isNull(), "turn", "role", "same"]
    stream = both.repartition("conv").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        name, repair, kept, digest, position, kind = None, None, {}, None, 0, None
        out: list[tuple] = []

        def take(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal position
            for edit, role, text in made:
                position += 1
                if real:
                    out.append((name, position, edit, role, text))
                else:
                    start = "\n" if position > 1 else ""
                    digest.update(f"{start}{role}:{text}".encode("utf-8", "replace"))

        def end() -> None:
            if repair is not None:
                take(repair.inserted())
                if not real:
                    out.append((name, *[kept[c] for c in RESULT], digest.hexdigest()))

        def batch() -> pa.RecordBatch:
            kinds = [kind, *types]
            columns = zip(*out) if out else [[] for _ in kinds]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for held in batches:
            kind = held.column(0).type
            columns = [held.column(i).to_pylist() for i in range(5)]
            for conv_id, role, text, copies, said in zip(*columns):
                if said is not None:
                    end()
                    kept = json.loads(said)
                    name, position, digest = conv_id, 0, hashlib.sha256()
                    repair = Repair(kept["audit"])
                for _ in range(copies):
                    take(repair.row(role, text))
            if out:
                yield batch()
                out.clear()
        end()
        if out:
            yield batch()

    if real:
        names = ["conv", "position", "edit", "role", "text"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string()]
        schema = f"conv {conv}, position bigint, edit string, role string, text string"
    else:
        names = ["conv", *RESULT, "repaired_sha256"]
        types = [*[pa.int64()] * 6, pa.string(), pa.string()]
        counts = ", ".join(f"{c} bigint" for c in RESULT[:-1])
        schema = f"conv {conv}, {counts}, audit string, repaired_sha256 string"
    return stream.select("conv", "role", "text", "copies", "about").mapInArrow(run, schema)


def repair_conversations(
    df: DataFrame, damaged: bool = False, real: bool = True, conv_col: str = "conv_id", **columns
) -> DataFrame:
    """The repaired turns of all conversations, or with ``real=False`` one row for each with
    its faults, cost, audit and hash. ``damaged=True`` damages the rows first."""
    rows = plain(df, conv_col, **columns)
    if damaged:
        rows = damage(rows)
    repairs = saved(find_repairs(rows))
    return apply_repairs(rows, repairs, real).withColumnRenamed("conv", conv_col)
