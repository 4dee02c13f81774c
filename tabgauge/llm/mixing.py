"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Sources, ordered by code point with null
last, weigh 5, 2, 1, 5, 2, 1, ...; together they are to give ``share`` of all words.
No source's target is above ``most`` times its size: what is cut off is shared anew
by weight until none is above.

Within a source, the rate of a document is the one nearest to 1 in relative entropy
that meets the source's token constraint: ``rate = min(most, exp(tilt * size / mean))``.
The tilts solve the convex dual. Newton steps, kept inside a bracket, run on a table
of (source, size, documents); each step sums the constraint and its slope per source
on the cluster. Rates become whole copies by a hash of the document, then a few
documents per source, picked by one aggregate each round, change by a copy or two to
close what the rounding left open.

Defined results: null text has size 0, is taken 0 times or more at no cost; a source
whose documents are all empty has target 0; a null source is a source of its own;
repeated rows are taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import WORD, id_key, saved, small_side, unit_hash, whole_text
from tabgauge.operators.ordering import with_row_number

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
STEPS = 60
ROUNDS = 6
REACH = 1e6


def source_key(name: str):
    return F.when(col(name).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("s"), col(name).cast("string"))
    )


def row_keys(id_col: str, text_col: str, source_col: str) -> dict:
    """What a document's copies depend on."""
    text = whole_text(text_col)
    return {
        "key": source_key(source_col),
        "id": id_key(id_col),
        "mark": F.xxhash64(id_key(id_col), text),
        "size": F.regexp_count(text, F.lit(WORD)).cast("bigint"),
    }


def targets(
    rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST
) -> tuple[DataFrame, int]:
    """Per source: size, documents, target; and the number of sources."""
    sizes = saved(
        rows.groupBy("key").agg(
            F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")
        )
    )
    # "n" for null sorts before "s...", so null goes last by its own flag.
    placed = with_row_number(
        sizes.withColumn("null_last", (F.col("key") == "n").cast("int")),
        ["null_last", "key"],
        "place",
    )
    chain = F.lit(float(weights[-1]))
    for i, weight in enumerate(weights[:-1]):
        chain = F.when(F.col("place") % len(weights) == i, float(weight)).otherwise(chain)
    sources = saved(placed.withColumn("weight", chain).drop("place", "null_last"))
    count, total, heavy = sources.agg(
        F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")
    ).first()
    if not count:
        return sources.withColumn("target", F.lit(0.0)), 0
    whole = share * total
    level, full = whole / heavy, 0
    while True:
        above = F.col("source_size") * most < F.lit(level) * F.col("weight")
        n, cut, rest = sources.agg(
            F.count_if(above),
            F.sum(F.when(above, F.col("source_size") * most).otherwise(0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
        ).first()
        if n == full or not rest:
            break
        level, full = (whole - cut) / rest, n
    wanted = F.least(
        (F.col("source_size") * most).cast("double"), F.lit(level) * F.col("weight")
    )
    return sources.withColumn("target", wanted), count


def balance(rows: DataFrame, sources: DataFrame, count: int, most: int = MOST) -> DataFrame:
    """The sources with the tilt that meets each one's target."""
    cells = saved(
        rows.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    )
    full = F.col("target") >= F.col("source_size") * most
    state = saved(
        sources.withColumns(
            {
                "mean": F.col("source_size") / F.col("documents"),
                "tilt": F.when(full, REACH).otherwise(0.0),
                "low": F.lit(-REACH),
                "high": F.lit(REACH),
                "open": ~full & (F.col("source_size") > 0),
            }
        )
    )
    z = F.col("size") / F.col("mean")
    for _ in range(STEPS):
        if not state.where("open").limit(1).count():
            break
        rate = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(small_side(state.where("open"), count), "key")
            .groupBy("key")
            .agg(
                F.sum(words * F.least(rate, F.lit(float(most)))).alias("given"),
                F.sum(F.when(rate < most, words * z * rate).otherwise(0.0)).alias("slope"),
            )
        )
        joined = state.join(sums, "key", "left")
        gap = F.col("given") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        middle = (low + high) / 2
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(
            middle
        )
        still = F.col("open") & (F.abs(gap) > F.greatest(F.lit(0.25), F.col("target") * 1e-7))
        state = saved(
            joined.select(
                *sources.columns,
                "mean",
                F.when(still, step).otherwise(F.col("tilt")).alias("tilt"),
                F.when(still, low).otherwise(F.col("low")).alias("low"),
                F.when(still, high).otherwise(F.col("high")).alias("high"),
                F.coalesce(still, F.lit(False)).alias("open"),
            )
        )
    return state.drop("low", "high", "open")


def whole_copies(most: int = MOST):
    """Copies of a document from its rate, rounded by its hash."""
    rate = F.least(
        F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))),
        F.lit(float(most)),
    )
    rate = F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0))
    up = unit_hash(F.lit(17), F.col("id"), F.col("mark")) < rate - F.floor(rate)
    return (F.floor(rate) + up.cast("int")).cast("bigint")


def adjust(
    cells: DataFrame, state: DataFrame, count: int, most: int = MOST, rounds: int = ROUNDS
) -> DataFrame:
    """(key, id, mark, size, change): documents whose copies change to meet the target."""
    given = cells.groupBy("key").agg(F.sum(F.expr("m * copies * size")).alias("given"))
    gaps = saved(
        state.join(given, "key", "left").select(
            "key", (F.col("target") - F.coalesce("given", F.lit(0))).alias("gap")
        )
    )
    names = ["key", "id", "mark", "size"]
    changes = None
    for _ in range(rounds):
        now = cells
        if changes is not None:
            done = changes.groupBy(*names).agg(F.sum("change").alias("done"))
            now = now.join(done, names, "left").withColumn(
                "copies", F.col("copies") + F.coalesce("done", F.lit(0))
            )
        steps = F.explode(F.array(*[F.lit(s) for s in range(-most, most + 1) if s]))
        tried = (
            now.where("size > 0")
            .join(small_side(gaps, count), "key")
            .withColumn("change", steps)
            .where(f"copies + change between 0 and {most}")
            .withColumn("left", F.expr("abs(gap - m * size * change)"))
            .where("left < abs(gap) - 0.5")
        )
        best = tried.groupBy("key").agg(
            F.min(F.struct("left", "id", "mark", "size", "change", "m")).alias("b")
        )
        picked = saved(
            best.select("key", "b.id", "b.mark", "b.size", "b.change", F.expr("b.m").alias("m"))
        )
        if not picked.limit(1).count():
            break
        changes = picked if changes is None else changes.union(picked)
        moved = picked.select("key", F.expr("m * size * change").alias("moved"))
        gaps = saved(
            gaps.join(moved, "key", "left").select(
                "key", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap")
            )
        )
    if changes is None:
        return cells.select(*names, F.lit(0).cast("bigint").alias("change")).limit(0)
    return changes.groupBy(*names).agg(F.sum("change").alias("change"))


def decide(rows: DataFrame, **options) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their copies, the sources, and the number of sources."""
    sources, count = targets(rows, **options)
    state = balance(rows, sources, count)
    names = ["key", "id", "mark", "size"]
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("m"))
    cells = saved(
        counted.join(small_side(state, count), "key").select(
            *names, "m", whole_copies().alias("copies")
        )
    )
    changes = adjust(cells, state, count)
    final = cells.join(changes, names, "left").select(
        *names, (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")
    )
    return final, state, count


def narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    keys = row_keys(id_col, text_col, source_col)
    return saved(docs.select(col(id_col).alias("plain"), *[c.alias(k) for k, c in keys.items()]))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **options,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies."""
    rows = narrow(docs, id_col, text_col, source_col)
    final, state, count = decide(rows, **options)
    return (
        rows.join(final, ["key", "id", "mark", "size"])
        .join(small_side(state, count), "key")
        .select(
            F.col("plain").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("copies") * F.col("size")).alias("taken"),
            "copies",
        )
    )


def take_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **options,
) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    rows = narrow(docs, id_col, text_col, source_col)
    final, _, _ = decide(rows, **options)
    names = ["key", "id", "mark", "size"]
    taken = final.where("copies > 0").select(*names, F.col("copies").cast("int").alias("copies"))
    # The document's own columns are out of reach of those used here.
    marked = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
        *[c.alias(k) for k, c in row_keys(id_col, text_col, source_col).items()],
    )
    every = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return marked.join(taken, names).select("row", every.alias("copy")).select("row.*")
