"""Keyed edits of a stored Parquet table that write only the files they touch.

The edits meet the keys of the table first, beside the name of the file each key lies in;
where the keys have a range, row groups outside it are not read. Files that hold an edited
key are read whole, joined with the edits and written anew; all others stay by name. Added
keys go into the new files. The names of files found are the only thing the driver gathers.

The new files wait in a hidden folder of the table. Once they are complete, the names they
replace are noted there, and only then are files moved and removed. An edit that ended
before the note leaves the table as it was; one that ended after it is finished by the
next edit or by ``finish_edits``. One edit of a table runs at a time, and readers wait
while files are exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.expr import col
from tabgauge.operators.clean import apply_edits
from tabgauge.session import remove_path, scratch_path

STAGING = "_edits"
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.StringType)


class Folder:
    """The files of one folder, through the file system Spark uses for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self.system = self.make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.make("/".join([self.path, *names]))

    def entries(self, *names: str) -> list[tuple[str, bool]]:
        """(name, is a folder) of what readers see."""
        found = self.system.listStatus(self.at(*names))
        rows = [(f.getPath().getName(), f.isDirectory()) for f in found]
        return [r for r in rows if not r[0].startswith(("_", "."))]

    def note(self, lines: Sequence[str], *names: str) -> None:
        """Write a small text file; it appears whole or not at all."""
        part = self.at(*names[:-1], f".{names[-1]}")
        out = self.system.create(part, True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        self.system.rename(part, self.at(*names))

    def read_note(self, *names: str) -> list[str]:
        stream = self.system.open(self.at(*names))
        size = self.system.getFileStatus(self.at(*names)).getLen()
        content = bytes(stream.readNBytes(size))
        stream.close()
        return content.decode().split("\n") if content else []


def in_key_range(df: DataFrame, edits: DataFrame, key: Sequence[str]) -> Column:
    """A filter the scan can use, true for every row whose key is edited."""
    ranged = [
        k for k in key
        if isinstance(df.schema[k].dataType, RANGED) and df.schema[k].dataType == edits.schema[k].dataType
    ]
    wanted = F.lit(True)
    if not ranged:
        return wanted
    ends = edits.agg(
        *[f(col(k)).alias(f"{name}_{i}") for i, k in enumerate(ranged) for name, f in (("low", F.min), ("high", F.max))],
        *[F.count_if(col(k).isNull()).alias(f"gaps_{i}") for i, k in enumerate(ranged)],
    ).first()
    for i, k in enumerate(ranged):
        inside = F.lit(False)
        if ends[f"low_{i}"] is not None:
            inside = col(k).between(F.lit(ends[f"low_{i}"]), F.lit(ends[f"high_{i}"]))
        wanted = wanted & (inside | col(k).isNull() if ends[f"gaps_{i}"] else inside)
    return wanted


def keys_with_files(df: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """(file) of each row of a stored table whose key is edited; null equals null."""
    names = [f"__key_{i}" for i in range(len(key))]
    held = df.where(in_key_range(df, edits, key)).select(
        df.metadataColumn("_metadata")["file_name"].alias("__file"),
        *[col(k).alias(f"__held_{i}") for i, k in enumerate(key)],
    )
    wanted = edits.select(*[col(k).alias(n) for k, n in zip(key, names)]).distinct()
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & F.col(f"__held_{i}").eqNullSafe(F.col(name))
    return held.join(wanted, same, "left_semi").select(F.col("__file").alias("file"))


def touched_files(df: DataFrame, edits: DataFrame, key: Sequence[str]) -> list[str]:
    """Names of the files of a stored table that hold an edited key."""
    return sorted(r["file"] for r in keys_with_files(df, edits, key).distinct().collect())


def finish_edits(spark: SparkSession, path: str) -> None:
    """Complete an exchange of files that was noted, or drop new files that were not."""
    table = Folder(spark, path)
    if not table.system.exists(table.at(STAGING)):
        return
    if table.system.exists(table.at(STAGING, "replaced")):
        for name, _ in table.entries(STAGING, "new"):
            if not table.system.rename(table.at(STAGING, "new", name), table.at(name)):
                raise OSError(f"{name} could not be moved into {path}")
        for name in table.read_note(STAGING, "replaced"):
            table.system.delete(table.at(name), False)
    remove_path(spark, f"{path}/{STAGING}")


def edit_table(
    spark: SparkSession,
    path: str,
    edits: DataFrame,
    key: Sequence[str],
    order: str | None = None,
) -> list[str]:
    """Apply keyed edits (see ``apply_edits``) to a Parquet folder, in place.

    Returns the names of the files replaced. As many new files are written, cut by ranges
    of the key, so that the next edit finds its keys in few files. Edits that name no row
    and add none change nothing. A table with partition folders is an error.
    """
    finish_edits(spark, path)
    table = Folder(spark, path)
    if any(is_folder for _, is_folder in table.entries()):
        raise ValueError(f"{path} has partition folders; edit one of them at a time")
    aside = scratch_path(spark)
    edits.write.parquet(aside)
    try:
        fixed = spark.read.schema(edits.schema).parquet(aside)
        df = spark.read.parquet(path)
        files = touched_files(df, fixed, key)
        if files:
            old = spark.read.schema(df.schema).parquet(*[f"{path}/{name}" for name in files])
        else:
            old = spark.createDataFrame([], df.schema)
        new = apply_edits(old, fixed, key, order)
        if not files and not new.limit(1).count():
            return []
        # A key that many rows share is cut by its rows.
        row = F.xxhash64(*[col(c) for c in df.columns])
        parts = new.repartitionByRange(max(1, len(files)), *[col(k) for k in key], row)
        parts.write.parquet(f"{path}/{STAGING}/new")
        table.note(files, STAGING, "replaced")
        finish_edits(spark, path)
    finally:
        remove_path(spark, aside)
    return files
