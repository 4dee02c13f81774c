"""Conversation repair against a parser that tries every cut, and against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabgauge.llm import conversations as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, about int"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(kinds):
    """Least (cost, audit) by trying all edits, row by row, over whole output strings."""
    # (output so far, capped by its place) -> least (cost, audit)
    steps = c.STEPS
    state = {c.START: (0, "")}

    def insert(now):
        now = dict(now)
        for _ in range(6):
            for p, (cost, audit) in list(now.items()):
                for x in "ua":
                    if p in steps[x]:
                        new = (cost + 5, audit + "I")
                        q = steps[x][p]
                        now[q] = min(now.get(q, new), new)
        return now

    for k in kinds:
        state = insert(state)
        after = {}
        for p, (cost, audit) in state.items():
            options = [(p, cost + 2, "D")]
            if k != "d":
                extra = 5 if k.isupper() else 0
                if p in steps.get(k.lower(), {}):
                    options.append((steps[k.lower()][p], cost + extra, "K"))
                options += [(steps[x][p], cost + 1 + extra, "R") for x in "ua" if p in steps[x]]
            for q, new, edit in options:
                after[q] = min(after.get(q, (new, audit + edit)), (new, audit + edit))
        state = after
    state = insert(state)
    return min(state[q] for q in c.ENDS if q in state)


def every_cut(parser, kinds):
    """The classic table: all spans by length, all cuts of each."""
    n = len(kinds)
    cells = {(i, 1): parser.single(k) for i, k in enumerate(kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            found = [
                c.combine(cells[i, cut], cells[i + cut, size - cut]) for cut in range(1, size)
            ]
            cells[i, size] = tuple(
                min([f[j] for f in found if f[j] is not None], default=None) for j in range(16)
            )
    return cells[0, n] if n else parser.insertions


def test_one_cut_is_enough():
    parser, rnd = c.Parser(), random.Random(1)
    words = ["".join(w) for n in range(4) for w in itertools.product("suaoSUAOd", repeat=n)]
    words += ["".join(rnd.choices("uuaasoSUAd", k=rnd.randint(4, 30))) for _ in range(300)]
    for kinds in words:
        whole = parser.parse(kinds)
        assert c.best(whole) == cheapest(kinds)
        if len(kinds) < 12:
            assert whole == every_cut(parser, kinds)


def plain_repair(rows, damaged):
    """The contract in plain Python, conversation by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        lot = zlib.crc32(key.encode()) % 20 if damaged else 9
        groups[conv] += []
        if lot == 1:
            text = ""
        elif lot == 2:
            text = re.sub("[.!?]", "", text)
        elif lot == 4:
            role = "user"
        same = hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + text).encode())
        row = (turn is not None, turn or 0, role, same.digest()[:16], turn, text)
        groups[conv] += [row] * {0: 0, 3: 2}.get(lot, 1)
    parser, out = c.Parser(), {}
    for conv, held in groups.items():
        held.sort(key=lambda r: r[:4])
        seen, kinds, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, _, _, text in held:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not bare:
                counts["blank"], kind = counts["blank"] + 1, "d"
            elif (role, text) in seen:
                counts["duplicate"], kind = counts["duplicate"] + 1, "d"
            elif bare[-1] not in ".!?":
                counts["truncated"], kind = counts["truncated"] + 1, kind.upper()
            seen.add((role, text))
            kinds += kind
        initials = [r[2][:1] for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[4] for r in held if r[4] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(kinds)
        left, made = iter(held), []
        for edit in audit:
            role = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if edit == "I":
                made.append((role, ""))
                continue
            row = next(left)
            if edit != "D":
                made.append((row[2] if edit == "K" else role, row[5]))
        assert GOOD.fullmatch("".join(r[:1] for r, _ in made))
        said = "\n".join(f"{r}:{t}" for r, t in made)
        digest = hashlib.sha256(said.encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest, made)
    return out


def conversations(seed, convs=60, large=()):
    """Random conversations with faults of every kind; some much larger than others."""
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "é. ", "One. two", ".", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [*range(convs), None]:
        n = dict(large).get(conv, rnd.randint(1, 12))
        for turn in range(n):
            usual = ["user", "assistant"][turn % 2] if rnd.random() < 0.7 else rnd.choice(roles)
            text = f"{turn} words." if rnd.random() < 0.6 else rnd.choice(texts)
            at = rnd.choice([turn, turn, turn, turn + 3, None])
            rows += [(conv, at, usual, text, "x", 1)] * rnd.choice([1, 1, 1, 2])
    rnd.shuffle(rows)
    return rows


def answers(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("damaged", [False, True])
def test_against_plain_python(spark, damaged):
    rows = conversations(3, large=[(7, 900), (30, 300), (59, 500)])
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = plain_repair(rows, damaged)
    got = answers(c.repair_conversations(df, damaged=damaged, real=False))
    assert got == {k: v[:-1] for k, v in wanted.items()}
    turns = defaultdict(list)
    made = c.repair_conversations(df, damaged=damaged)
    for r in made.orderBy("conv_id", "position").collect():
        turns[r.conv_id].append((r.role, r.text))
    assert dict(turns) == {k: v[-1] for k, v in wanted.items() if v[-1]}


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(c, "STRETCH", 16)
    rows = conversations(5, convs=12, large=[(5, 2000)])
    df = spark.createDataFrame(rows, SCHEMA)
    found = c.stretches(c.faults(c.plain(df)), 70)
    assert found.where("conv = 5").select("part").distinct().count() > 8
    repairs = c.find_repairs(c.plain(df), parts=70)
    got = answers(c.apply_repairs(c.plain(df), repairs, real=False))
    assert got == {k: v[:-1] for k, v in plain_repair(rows, False).items()}


def test_repeated_rows_are_counted_before_they_travel(spark):
    rows = [(1, 1, "user", "Hello.", "x", 1)] * 5000 + [(1, 2, "assistant", "Hi.", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert c.faults(c.plain(df)).count() == 2
    got = answers(c.repair_conversations(df, real=False))[1]
    assert got[:6] == (0, 0, 4999, 0, 4999, 9998)
    assert got[6] == "K" + "D" * 4999 + "K"


def test_odd_conversations(spark):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [
        (1, None, None, None, None, None),
        (2, -(2**63), "user", "a" * 200_000 + ".", None, None),
        (2, 2**63 - 1, "assistant", "Ok.", None, None),
        (3, 5, "system", "Be kind.", None, None),
    ]
    got = answers(c.repair_conversations(spark.createDataFrame(rows, SCHEMA), real=False))
    assert got[1] == (0, 1, 0, 0, 0, 2, "D", empty)
    assert got[2][0] is None and got[2][5:7] == (0, "KK")
    assert got[3][5:] == (2, "D", empty)
    none = spark.createDataFrame([], SCHEMA)
    assert c.repair_conversations(none, damaged=True, real=False).collect() == []
    assert c.repair_conversations(none).collect() == []


def test_all_rows_dropped(spark):
    gone = [(i, 0) for i in range(2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:5]
    rows = [(i, t, "user", "Hello.", None, None) for i, t in gone]
    got = answers(c.repair_conversations(spark.createDataFrame(rows, SCHEMA), True, False))
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {i: (0, 0, 0, 0, 0, 0, "", empty) for i, _ in gone}


def test_result_columns(spark):
    df = spark.createDataFrame(conversations(1, 3), SCHEMA)
    made = c.repair_conversations(df, damaged=True, real=False)
    assert made.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ]
    assert made.where(F.col("audit").isNull()).count() == 0
