"""Personal data by bootstrapped contextual extraction.

Seeds are the identifiers that plain rules find and check: email, ip, card (Luhn) and
phone. Other strings of a loosely similar shape are candidates: addresses with "(at)" and
"(dot)", IPv6, card-like numbers that fail the check, national phone numbers. Each
occurrence has lexical patterns: the two words before it, and the words on either side.

Distinct (pattern, identifier) pairs form a graph per kind, scored round by round on the
cluster: a pattern's confidence is the mean score of the identifiers it holds, damped for
small support and nought below ``SEEDS`` accepted ones; a candidate's score is the chance
that at least one of its patterns is right, and seeds keep score 1. In the end an
occurrence of a candidate is added if one of its own patterns and its score both reach
``CONFIDENT``. Seeds always stay.

Positions are code points, ends exclusive. Scanning is linear in the text: each rule
starts where only one start is possible.

Defined results: null text is empty and has no spans; rows with equal or null ids are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import saved, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SEEDS = 3
CONFIDENT = 0.7
CONTEXT = 80

# The contract's rules. Where no shorter match is possible, repetitions keep no way back,
# so that a long match takes no memory of its own.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Shapes of candidates; every repetition is bounded.
HIDDEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[A-Za-z0-9-]{1,63}){1,8}",
    re.IGNORECASE,
)
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")
LIKE_CARD = re.compile(r"(?<![0-9.-])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}[ .-]?[0-9]{1,4}(?![0-9.-])")
LIKE_PHONE = re.compile(
    r"(?<![0-9+.(-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9.-])"
)
WORDS = re.compile(r"[^\W\d_]+|[0-9]+|[:=#]")
SHAPES = ((0, HIDDEN), (1, IPV6), (2, LIKE_CARD), (3, LIKE_PHONE))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def byte(part: str) -> bool:
    """Whether digits, zeros in front of any number included, are at most 255."""
    value = part.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the checked rules, by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    numbers = re.search("[0-9]", text) is not None
    if numbers and "." in text:
        for m in IP.finditer(text):
            if all(byte(p) for p in m[0].split(".")):
                found.append((1, *m.span()))
    if numbers:
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
    if numbers and "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loosely shaped strings that touch no seed and no earlier candidate."""
    if re.search("[0-9]", text) is None and re.search(r"[({\[][aA][tT][)}\]]", text) is None:
        return []
    spans = sorted((a, b) for _, a, b in taken)
    found: list[tuple[int, int, int]] = []
    for kind, shape in SHAPES:
        rivals, new, i = sorted(spans + [(a, b) for _, a, b in found]), [], 0
        for m in shape.finditer(text):
            a, b = m.span()
            digits = sum(c.isdigit() for c in m[0])
            if kind == 2 and not 13 <= digits <= 19 or kind == 3 and not 8 <= digits <= 15:
                continue
            while i < len(rivals) and rivals[i][1] <= a:
                i += 1
            if i < len(rivals) and rivals[i][0] < b:
                continue
            new.append((kind, a, b))
        found += new
    return found


def contexts(text: str, start: int, end: int) -> tuple[str, str]:
    before = WORDS.findall(text[max(0, start - CONTEXT) : start].lower())[-2:]
    after = WORDS.findall(text[end : end + CONTEXT].lower())[:1]
    before = ["0" if w.isdigit() else w for w in before]
    after = ["0" if w.isdigit() else w for w in after]
    return "before " + " ".join(before), "around " + " ".join(before[-1:] + ["_"] + after)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, id, base_sha256, base spans, and all occurrences."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    seen = pa.list_(
        pa.struct(
            [
                ("kind", pa.int32()),
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("seed", pa.bool_()),
                ("value", pa.string()),
                ("before", pa.string()),
                ("around", pa.string()),
            ]
        )
    )

    def one(text: str) -> tuple[str, list[dict], list[dict]]:
        base = seeds(text)
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        found = [(s, True) for s in base] + [(s, False) for s in candidates(text, base)]
        occurrences = []
        for (k, a, b), seed in found:
            before, around = contexts(text, a, b)
            # A span may be long; its digest stands for it.
            value = text[a:b] if b - a <= 128 else hashlib.sha256(text[a:b].encode()).hexdigest()
            occurrences.append(
                {"kind": k, "start": a, "end": b, "seed": seed, "value": value,
                 "before": before, "around": around}
            )
        spans = [{"kind": k, "start": a, "end": b} for k, a, b in base]
        return hashlib.sha256(joined.encode()).hexdigest(), spans, occurrences

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [one(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], span),
                    pa.array([f[2] for f in found], seen),
                ],
                ["id", "base_sha256", "base", "seen"],
            )

    rows = docs.select(col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text"))
    kinds = "kind int, start bigint, end bigint"
    schema = (
        f"id bigint, base_sha256 string, base array<struct<{kinds}>>, seen array<struct<{kinds}, "
        "seed boolean, value string, before string, around string>>"
    )
    found = rows.mapInArrow(run, schema)
    return saved(found.withColumn("row", F.monotonically_increasing_id()))


def score(occurrences: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, confidence) and (kind, value, score) of the graph."""
    edges = saved(
        occurrences.select(
            "kind", "value", "seed", F.explode(F.array("before", "around")).alias("pattern")
        )
        .groupBy("kind", "pattern", "value")
        .agg(F.max("seed").alias("seed"))
    )
    held = edges.withColumn("score", F.col("seed").cast("double"))
    for i in range(rounds):
        patterns = held.groupBy("kind", "pattern").agg(
            F.sum("score").alias("good"), F.count(F.lit(1)).alias("n")
        )
        patterns = saved(
            patterns.where(F.col("good") >= SEEDS).select(
                "kind", "pattern", (F.col("good") / (F.col("n") + 1)).alias("confidence")
            )
        )
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))))
        values = saved(
            edges.where("not seed")
            .join(patterns, ["kind", "pattern"])
            .groupBy("kind", "value")
            .agg((1 - doubt).alias("score"))
        )
        if i + 1 < rounds:
            held = edges.join(
                values.withColumnRenamed("score", "found"), ["kind", "value"], "left"
            ).withColumn(
                "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0)))
            )
    return patterns, values


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    confident: float = CONFIDENT,
) -> DataFrame:
    """One row per document: id, counts of checked identifiers per kind, base_sha256,
    spans (all, as text), n_added, and found: (kind, start, end) of every span."""
    rows = scan(docs, id_col, text_col)
    seen = rows.select("row", F.inline("seen"))
    patterns, values = score(seen, rounds)
    sure = patterns.where(F.col("confidence") >= confident)
    good = values.where(F.col("score") >= confident)
    added = (
        seen.where("not seed")
        .select(
            "row", "kind", "start", "end", "value",
            F.explode(F.array("before", "around")).alias("pattern"),
        )
        .join(sure.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
        .join(good.select("kind", "value"), ["kind", "value"], "left_semi")
        .select("row", "kind", "start", "end")
        .distinct()
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    )
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    both = rows.drop("seen").join(added, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = F.transform(
        "found",
        lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
            s["end"].cast("string"),
        ),
    )

    def count(kind: int) -> Column:
        # A second argument of the function, with a default or not, would be the place.
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return both.withColumn("found", spans).select(
        F.col("id").alias(id_col),
        *counts,
        "base_sha256",
        F.array_join(line, ",").alias("spans"),
        (F.size("found") - F.size("base")).cast("bigint").alias("n_added"),
        "found",
    )
