"""CSV records with quotes and line breaks, against pandas, with ranges cut anywhere."""

import csv
import random

import pandas as pd
import pytest

from tabgauge.sources import records
from tabgauge.sources.tables import read_csv, to_csv


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few lines each."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "150")
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, old):
        spark.conf.set(name, value)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def by_pandas(path):
    read = pd.read_csv(path, dtype=str, keep_default_na=False)
    return list(read.columns), sorted(
        tuple(None if v == "" else v for v in row) for row in read.itertuples(index=False)
    )


def written(path, rows, end="\n", header=("id", "text", "note")):
    with open(path, "w", newline="") as file:
        made = csv.writer(file, lineterminator=end)
        made.writerow(header)
        made.writerows(rows)


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    pieces = ["one", "two words", '"', '""', ",", "\n", "\r\n", "é\U0001f600", " ", "x" * 40, "\n\n"]
    text = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 1, 3, 6])))
    rows = [(i, f"a{text()}", f"{text()}z") for i in range(n)]
    # Fields that go on over several ranges, with and without quotes in them.
    rows.insert(n // 3, (n, "begin " + "long line\n" * 80 + "end", "z"))
    rows.insert(n // 2, (n + 1, "begin " + 'a "quoted" line\n' * 60 + "end", "\nz"))
    return rows


def test_state_of_a_line():
    cases = ["", "a,b", '"a', '"a"', '"a""', '"a"""', '"a"b"', '"a"b,"', 'a"b', 'a,"b', 'a,"b",c', '",', '""']
    rnd = random.Random(1)
    cases += ["".join(rnd.choice('",a') for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    for line in cases:
        for inside in (False, True):
            made = list(csv.reader([('"' if inside else "") + line + "\n", "next\n"]))
            assert records.ends_inside(line, inside) == (made[-1] != ["next"]), (line, inside)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_fields_over_range_edges(spark, small_ranges, tmp_path, seed, end):
    path = str(tmp_path / "notes.csv")
    written(path, random_rows(seed), end)
    lines = records.text_lines(spark, path)
    assert lines.select("start").distinct().count() > 20
    opened = records.open_records(records.range_maps(lines).collect())
    assert sum(k is not None for _, keys in opened.values() for k in keys) > 5
    columns, wanted = by_pandas(path)
    got = records.read_texts(spark, path)
    assert got.columns == columns and rows_of(got) == wanted


def test_types_are_inferred_behind_line_breaks(spark, tmp_path):
    path = str(tmp_path / "few.csv")
    with open(path, "w") as file:
        file.write('id,note,v\n1,"line one\nline two",2.5\n\n2,"say ""hi"", ok",3\n3,plain,NA\n')
    got = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "string", "double"]
    assert rows_of(got) == [(1, "line one\nline two", 2.5), (2, 'say "hi", ok', 3.0), (3, "plain", None)]


def test_a_folder_of_files_and_a_header_with_a_line_break(spark, small_ranges, tmp_path):
    wanted = []
    for i in range(3):
        rows = [(f"{i}-{j}", "text\nwith breaks" * (j % 4), "z") for j in range(40)]
        written(tmp_path / f"part{i}.csv", rows, header=("id", "long\nname " + "x" * 300, "note"))
        wanted += [(a, b or None, c) for a, b, c in rows]
    got = records.read_texts(spark, str(tmp_path))
    assert got.columns[1].startswith("long\nname") and rows_of(got) == sorted(wanted)


def test_plain_files_stay_with_the_csv_reader(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    written(path, [(1, 'a "b"', "x,y"), (2, "", '5" pipe')])
    got = records.read_texts(spark, path)
    assert "csv" in got._jdf.queryExecution().toString().lower()
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert rows_of(got) == by_pandas(path)[1]


def test_stray_quotes_do_not_run_on(spark, tmp_path):
    path = str(tmp_path / "stray.csv")
    with open(path, "w") as file:
        file.write('id,note,v\n1,5" pipe,a\n2,"b\nc",d\n3,x"y"z,e\n')
    assert rows_of(records.read_texts(spark, path)) == by_pandas(path)[1]


def test_an_open_quote_takes_the_rest(spark, small_ranges, tmp_path):
    path = str(tmp_path / "open.csv")
    with open(path, "w") as file:
        file.write("id,note,v\n1,a,b\n" + '2,"rest\n' + "more,lines\n" * 60)
    got = rows_of(records.read_texts(spark, path))
    assert got[0] == ("1", "a", "b") and got[1][0] == "2" and len(got) == 2
    assert got[1][1].count("more,lines") == 60


def test_writing_keeps_every_text(spark, tmp_path):
    texts = ["a\nb", 'say "hi"', " spaced ", "a,b", "\r\nx", "\\", '\\"', "tab\t", '"', "é"]
    rows = [(i, f"{t}") for i, t in enumerate(texts)]
    path = str(tmp_path / "out")
    to_csv(spark.createDataFrame(rows, "id int, t string"), path)
    assert rows_of(read_csv(spark, path)) == rows
    empty = str(tmp_path / "empty")
    to_csv(spark.createDataFrame([], "id int, t string").coalesce(1), empty)
    made = read_csv(spark, empty)
    assert made is None or made.count() == 0
