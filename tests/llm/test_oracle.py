"""Registered queries with SQL against DuckDB, and the entry's guard."""

import subprocess
import sys
from pathlib import Path

import pytest

from pointloom.llm.registry import QUERIES, SQL

from ..compare import DATA, same, tables

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.skipif(not DATA.exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    same(QUERIES[name](spark, str(DATA)).toPandas(), tables().execute(SQL[name]).df())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


def test_entry_without_this_folder(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "pointloom").mkdir()
    for p in (ROOT / "pointloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "pointloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False"
