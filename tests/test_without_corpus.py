"""The library, its queries and the driver contract work without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_folders(tmp_path, pipeline):
    shutil.copytree(ROOT / "vectide", tmp_path / "vectide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    got = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, with_sql, corpus = got.stdout.split()
    assert int(n) >= int(with_sql) > 50 and corpus == "False", got.stderr


def test_other_failures_are_raised(tmp_path):
    shutil.copytree(ROOT / "vectide", tmp_path / "vectide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_nowhere")
    got = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode and "a_module_that_is_nowhere" in got.stderr
