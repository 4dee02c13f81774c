"""The registered queries with and without the optional corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def copied(folder: Path, *left_out: str) -> Path:
    def absent(path: str, names: list[str]) -> set[str]:
        here = Path(path)
        return {n for n in names if str((here / n).relative_to(ROOT)) in left_out or n == ".git"}

    return Path(shutil.copytree(ROOT, folder / "copy", ignore=absent))


def registered(folder: Path) -> list[set[str]]:
    made = subprocess.run(
        [sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True
    )
    return [set(line.split()) for line in made.stdout.splitlines()[:2]]


@pytest.mark.parametrize(
    "left_out",
    [
        ("tabgauge/llm", "tests/llm"),
        ("tabgauge/llm", "tests/llm", "corpus_pipeline.py"),
    ],
)
def test_other_queries_stay_without_the_corpus_part(tmp_path, left_out):
    names, with_sql = registered(copied(tmp_path, *left_out))
    assert "describe" in names and with_sql <= names
    assert not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert "pipeline" not in names


def test_a_fault_inside_the_corpus_part_is_not_hidden(tmp_path):
    folder = copied(tmp_path)
    (folder / "tabgauge/llm/queries.py").parent.mkdir(exist_ok=True)
    (folder / "tabgauge/llm/queries.py").write_text("import no_such_module\n")
    with pytest.raises(subprocess.CalledProcessError):
        registered(folder)
