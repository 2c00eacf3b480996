"""The entry module without the optional operators: their queries are missing, all others stay."""

import os
import shutil
import subprocess
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONAL = os.path.exists(f"{HOME}/ledgerline/llm/queries.py")


@pytest.mark.parametrize("lost", ["nothing", "folder", "library"])
def test_queries_that_are_left(tmp_path, lost):
    shutil.copytree(f"{HOME}/ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{HOME}/{name}"):
            shutil.copy(f"{HOME}/{name}", tmp_path)
    if lost == "folder" and OPTIONAL:
        os.rename(tmp_path / "ledgerline/llm", tmp_path / "elsewhere")
        (tmp_path / "ledgerline/llm/__pycache__").mkdir(parents=True)  # what an old run leaves behind
    if lost == "library":
        (tmp_path / "zstandard.py").write_text("raise ImportError('no zstandard here')")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    every, numbered, known = done.stdout.split()
    assert known == "True" and int(every) > 190 and (int(numbered) > 0) == (lost == "nothing" and OPTIONAL)
