"""The core imports and runs without the optional corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LOAD = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q))"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_core_imports_without_the_corpus_operators(tmp_path, left):
    """Both folders are gone; the pipeline file may be gone or still there."""
    skipped = shutil.ignore_patterns("llm", "__pycache__", ".git", *({"corpus_pipeline.py"} - set(left)))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    ran = subprocess.run([sys.executable, "-B", "-c", LOAD], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    every, corpus = map(int, ran.stdout.split())
    assert every > 150 and corpus == 0


def test_nothing_outside_imports_the_corpus_operators():
    for path in (ROOT / "sightline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sightline.llm" not in path.read_text(), path
