"""What is registered, with the operators on text and without them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from patronage.oracle import ORACLE
from patronage.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent
LISTED = """
import __spark_entry__ as entry
print(*sorted(entry.queries()))
print(*sorted(entry.oracle_sql()))
"""


def test_library_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_import_without_the_text_folders(tmp_path, also):
    """With both folders gone the library is registered as before, whether the pipeline's file is left or not."""
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *also)
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    assert not (copy / "patronage" / "llm").exists() and not (copy / "tests" / "llm").exists()
    listed = subprocess.run([sys.executable, "-c", LISTED], cwd=copy, capture_output=True, text=True, check=True)
    names, twins = (set(line.split()) for line in listed.stdout.splitlines())
    assert names == set(QUERIES) and twins == set(ORACLE)
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider",
                                "tests"], cwd=copy, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
