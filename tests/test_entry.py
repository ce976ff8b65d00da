from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["mask", "entities"] and df.collect()
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 75


def test_nothing_else_needs_the_training_data_operators(tmp_path):
    """A copy without them imports, with the other queries."""
    for p in ("cairn", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "cairn/llm"], check=True)
    code = "import __spark_entry__ as e; assert e.llm is None and 'archetype_histogram' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_other_missing_modules_are_errors(tmp_path):
    for p in ("cairn", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    (tmp_path / "cairn/operators/ops.py").unlink()
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode
