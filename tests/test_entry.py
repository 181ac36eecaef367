"""The entry points work without the optional part."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points

ROOT = os.path.dirname(os.path.abspath(entry_points.__file__))
CORE = {name for name, query in entry_points.queries().items() if query.__module__.startswith("custvalue.plans")}


@pytest.mark.parametrize("left_out", [["custvalue/llm", "tests/llm"], ["custvalue/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, left_out):
    copy = tmp_path / "copy"
    away = {os.path.join(ROOT, x) for x in left_out}

    def ignored(folder, names):
        return [n for n in names if n.startswith(".git") or n == "__pycache__" or os.path.join(folder, n) in away]

    shutil.copytree(ROOT, copy, ignore=ignored)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names, statements = [set(x.split()) for x in run.stdout.splitlines()[-2:]]
    assert names == CORE and statements <= CORE and len(statements) > 60
