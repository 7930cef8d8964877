"""The rest works when the corpus subpackage, its tests and the pipeline are gone, one by one or together."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [("tidewatch/llm",), ("corpus_pipeline.py",), ("tidewatch/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_imports(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        target = copy / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    said = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, operators, pipeline = said.stdout.split()[-3:]
    assert int(n) > 190 and pipeline == "False"
    assert (copy / "tidewatch/llm").exists() == (int(operators) >= 10)


def test_entry_works_without_a_library_that_the_corpus_needs(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in ("bpe", "queries"):
        path = copy / f"tidewatch/llm/{name}.py"
        if path.exists():
            path.write_text(path.read_text().replace("from __future__ import annotations\n", "from __future__ import annotations\n\nimport a_library_that_is_not_here\n", 1))
    said = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-2:] == ["0", "False"]
