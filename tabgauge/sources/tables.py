"""Reading and writing tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.expr import col
from tabgauge.operators.roles import normalize
from tabgauge.sources.records import read_texts

WHOLE_TYPES = [
    ("tinyint", -(2**7), 2**7 - 1),
    ("smallint", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1),
]
# Tried in this order when a CSV is read.
INFERRED_TYPES = ("int", "bigint", "double", "timestamp", "boolean")
# What texts of these types look like. Some that do not fit match too, but no text that fits
# is left out, so only these are cast: a cast that fails builds an error first.
AROUND = r"[\x00-\x20\x7F]*"
SHAPES = {
    "bigint": r"[+-]?0*(?:[0-9]{1,18}|[0-8][0-9]{18}|9[0-2][0-9]{17})",
    "double": r"[+-]?(?:nan|inf(?:inity)?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[fd]?"
    r"|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[fd]?)",
    # Years, months, days and hours of times of a day that cannot be are left out.
    "timestamp": r"[+-]?(?:(?:[0-9]{4,5}|[01][0-9]{5}|2[0-8][0-9]{4}|29[0-4][0-9]{3})"
    r"(?:-(?:0?[1-9]|1[0-2])(?:-(?:0?[1-9]|[12][0-9]|3[01])(?:[T\x20].*)?)?)?"
    r"|(?:T(?:[01]?[0-9]|2[0-3])|(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9])(?:[^0-9].*)?)",
    "boolean": "(?:t|true|y|yes|1|f|false|n|no|0)",
}
# Texts that common CSV readers take as a missing value; fixed values.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# A double is narrowed when no value moves by more than this.
FLOAT_TOLERANCE = 5e-4


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame | None:
    """A CSV file or folder with a header; None when it cannot be found or has no header.

    The usual texts for a missing value are read as missing before types are inferred
    from the whole input, in one aggregate over all columns; give a schema to save that
    pass. Quoted fields may hold commas, doubled quotes and line breaks. What is damaged
    further in shows when the rows are read.
    """
    try:
        texts = read_texts(spark, path)
    except AnalysisException:
        return None
    cells = {c: F.when(~col(c).isin(MISSING_TEXTS), col(c)) for c in texts.columns}
    texts = texts.select(*[cell.alias(c) for c, cell in cells.items()])
    if schema is not None:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        kinds = {f.name: f.dataType.simpleString() for f in schema}
    else:
        kinds = infer_types(texts)
    named = [c for c in texts.columns if c in kinds]
    return normalize(texts.select(*[col(c).try_cast(kinds[c]).alias(c) for c in named]))


def reads_as(text: Column, kind: str) -> Column:
    """The text as one of the inferred types, null where it is none: ``try_cast``, but
    quick on texts that do not fit."""
    if kind == "int":
        whole = reads_as(text, "bigint")
        return F.when(whole.between(-(2**31), 2**31 - 1), whole.cast("int"))
    fits = text.rlike(rf"(?is)\A{AROUND}{SHAPES[kind]}{AROUND}\z")
    return F.when(fits, text.try_cast(kind))


def infer_types(texts: DataFrame) -> dict[str, str]:
    """The first of a few types that all texts of a column fit; string for none."""
    if not texts.columns:
        return {}
    fits = texts.agg(
        *[
            F.coalesce(
                F.bool_and(reads_as(F.trim(col(c)), kind).isNotNull() | col(c).isNull())
                & (F.count(col(c)) > 0),
                F.lit(False),
            ).alias(f"{i}_{kind}")
            for i, c in enumerate(texts.columns)
            for kind in INFERRED_TYPES
        ]
    ).first()
    return {
        c: next((kind for kind in INFERRED_TYPES if fits[f"{i}_{kind}"]), "string")
        for i, c in enumerate(texts.columns)
    }


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize(spark.read.parquet(path))


def narrow_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Whole numbers in the smallest type that holds them; floats on request.

    One aggregate finds the ranges of all columns.
    """
    whole = [
        f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))
    ]
    doubles = [f.name for f in df.schema if floats and isinstance(f.dataType, T.DoubleType)]
    if not whole and not doubles:
        return df
    ranges = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(col(c)).alias(f"a{i}") for i, c in enumerate(whole)],
        *[F.max(col(c)).alias(f"b{i}") for i, c in enumerate(whole)],
        *[
            F.max(F.abs(col(c) - col(c).cast("float").cast("double"))).alias(f"d{i}")
            for i, c in enumerate(doubles)
        ],
    ).first()
    kinds = {}
    for i, name in enumerate(whole):
        low, high = ranges[f"a{i}"], ranges[f"b{i}"]
        if low is not None:
            fits = [k for k, a, b in WHOLE_TYPES if a <= low and high <= b]
            if fits:
                kinds[name] = fits[0]
    for i, name in enumerate(doubles):
        moved = ranges[f"d{i}"]
        if moved is not None and moved <= FLOAT_TOLERANCE:
            kinds[name] = "float"
    return df.select(
        *[col(c).cast(kinds[c]).alias(c) if c in kinds else col(c) for c in df.columns]
    )


def to_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header each; quotes are doubled and white space is kept."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **kept).csv(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Ordered lines of text as one small file."""
    lines.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(path)
