"""Types of texts: as try_cast finds them, and quick where a text does not fit."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tabgauge.sources.tables import INFERRED_TYPES, infer_types, reads_as

TEXTS = [
    "", " ", "0", "1", "-1", "+7", "007", "1.", ".5", "1.5", "-.5e3", "1e5", "1E-5", "1e", "e1", "1d", "2.5F", "1L",
    "0x1p3", "0x.8P-2f", "0x1", "NaN", "+NaN", "nan", "inf", "-Infinity", "INFINITY", "infin", "2147483647",
    "2147483648", "-2147483648", "-2147483649", "9223372036854775807", "9223372036854775808",
    "-9223372036854775808", "-9223372036854775809", "9199999999999999999", "9300000000000000000",
    "8999999999999999999", "0" * 40 + "12", "1" * 25, "1_000", "1,5", "--1", "+", "-", "t", "T", "true", "TRUE",
    "tRuE", "y", "Yes", "n", "NO", "f", "False", "ja", "tru", "on", "\t12\n", "\x0012\x7f", "12\x85", " 12",
    "١٢", "１", "yeſ", "1998-04-23 00:00:00", "2020-13-01", "2020-1-1", "12:30", "3-MEDIUM", "x",
]


def test_as_try_cast(spark):
    rnd = random.Random(2)
    texts = TEXTS + [f"{a}{t}{b}" for t in TEXTS for a, b in (("\x1f", "\t"), ("\r", "\x0b"), ("\x80", ""))]
    letters = "0123456789+-.eExXpPdfNaInfTtrueyso \t\x00"
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 6))) for _ in range(3000)]
    texts += [str(rnd.choice([-1, 1]) * (2**63 + rnd.randint(-(10**rnd.randint(1, 18)), 10**rnd.randint(1, 18)))) for _ in range(300)]
    pick = lambda *c: rnd.choice(c)
    for _ in range(6000):
        date = pick("", "+", "-") + pick("1998", "0001", "98", "12345", "294247", "294248", "290308", "899999", "1234567", "000012")
        for _ in range(rnd.randint(0, 3)):
            date += pick("-", "-", "-", "/") + pick("1", "01", "12", "13", "00", "0", "28", "31", "32", "001", "")
        time = "".join(pick("0", "7", "07", "23", "24", "59", "60", "099", "") + pick(":", ":", ":", ".", "") for _ in range(rnd.randint(0, 4)))
        zone = pick("", "", "", "Z", "+01:00", " UTC", "-8", " Europe/Paris", " foo", "\n")
        texts.append(pick(date, time, date + pick("T", " ", "t", "  ") + time, "T" + time, "+" + time, "t" + time) + zone)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in INFERRED_TYPES:
        made = rows.select("t", reads_as(F.col("t"), kind).alias("a"), F.col("t").try_cast(kind).alias("b"))
        assert made.schema["a"].dataType == made.schema["b"].dataType
        wrong = made.where("NOT (a <=> b)").collect()
        assert not wrong, (kind, wrong[:5])


@pytest.mark.parametrize("text", ["'word ' || id", "(3000000000 + id) || ' of'", "CAST(id + 0.5D AS string)", "CAST(300000 + id AS string)"])
def test_texts_that_do_not_fit_are_quick(spark, tmp_path, text):
    path = str(tmp_path / "texts")
    spark.range(0, 200_000, 1, 4).selectExpr(f"{text} AS t").write.parquet(path)
    rows = spark.read.parquet(path)

    def seconds(job):
        job()
        began = time.monotonic()
        job()
        return time.monotonic() - began

    # Casts of one type, all in vain; five types are tried in the other job.
    failing = F.concat(F.lit("x"), "t").try_cast("int")
    plain = seconds(lambda: rows.agg(F.count(failing)).collect())
    assert seconds(lambda: infer_types(rows)) < 2 * plain
