"""Exact dedup: runs of text digests, merged round by round in a tree.

Texts are equal when they are identical after each stretch of white space
(space, tab to carriage return) is replaced by one space; a null text counts as
empty. Text never moves: a row travels as its SHA-256 digest, and two rows are
one group only if byte length and a second, unrelated hash agree as well.

Every input partition first makes one run: its distinct digests with the smallest
identifier and the number of rows. In each round, ``fan`` neighbouring runs meet:
they are exchanged by digest, sorted, and the entries of equal digests become one
that keeps the smallest identifier. A run has one entry per digest, so the merge
of a digest reads ``fan`` rows at most, however many copies there are.

Defined results: a null id is larger than any other; of equal ids the first row
stays; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import LAST_ID, WHITE, id_key, saved, whole_text

FAN = 16
KEY = ["digest", "n_bytes", "check"]


def text_key(text: str) -> dict:
    """Digest, length and second hash of the normalised text."""
    normal = F.regexp_replace(whole_text(text), WHITE, " ")
    return {
        "digest": F.unhex(F.sha2(normal, 256)),
        "n_bytes": F.octet_length(normal).cast("bigint"),
        "check": F.xxhash64(F.lit(1), normal),
    }


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: row number, id, digest, and the run it is in."""
    return saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            id_key(id_col).alias("id"),
            *[c.alias(name) for name, c in text_key(text_col).items()],
            F.spark_partition_id().alias("run"),
        )
    )


def merge_runs(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(digest, n_bytes, check) with the smallest (id, row) and the rows of the group."""
    keep = F.struct("id", "row")
    run = rows.groupBy("run", *KEY).agg(
        F.min(keep).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        same = Window.partitionBy("run", *KEY)
        first = same.orderBy("keep")
        run = (
            run.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
            .withColumn("total", F.sum("n").over(same))
            .withColumn("place", F.row_number().over(first))
            .where("place = 1")
            .select("run", *KEY, "keep", F.col("total").alias("n"))
        )
        runs = -(-runs // fan)
    return run.select(*KEY, "keep", "n")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = digest_rows(docs, id_col, text_col)
    groups = merge_runs(rows, fan)
    null_id = F.lit(None).cast("bigint")
    plain = lambda c: F.when(c == LAST_ID, null_id).otherwise(c)
    return rows.join(groups, KEY).select(
        plain(F.col("id")).alias(id_col),
        plain(F.col("keep.id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns.

    Rows meet their group by digest and id together, so the rows of a large group
    spread over all tasks. Repeated rows with one id keep the first by their other
    columns.
    """
    keys = [*KEY, "id"]
    keepers = merge_runs(digest_rows(docs, id_col, text_col)).select(*KEY, F.col("keep.id").alias("id"))
    others = [col(c) for c in docs.columns if c not in (id_col, text_col)]
    # The document's own columns are out of reach of those used here.
    marked = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"),
        *[c.alias(k) for k, c in text_key(text_col).items()],
        id_key(id_col).alias("id"),
        (F.to_json(F.struct(*others)) if others else F.lit("")).alias("order"),
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("order"))
    kept = marked.join(keepers, keys, "left_semi").withColumn("place", place)
    return kept.where("place = 1").select("row.*")
