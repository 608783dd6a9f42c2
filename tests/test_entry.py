"""The entry where the training-data subpackage is absent."""

import shutil
import subprocess
import sys

import __spark_entry__
from assaymill.plans import queries as plans
from tests.conftest import ROOT

LISTED = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


def names_of_copy(folder, *absent):
    """Query names of a copy of the repository without some of its files."""
    copy = shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *absent))
    for each in ("tests/test_queries.py", "tests/test_streaming.py"):
        assert (copy / each).exists()
    said = subprocess.run([sys.executable, "-B", "-c", LISTED], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    collected = subprocess.run([sys.executable, "-B", "-m", "pytest", "--collect-only", "-q", "tests", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout[-2000:]
    return set(said.stdout.rpartition("NAMES")[2].split())


def test_without_the_subpackage(tmp_path):
    """With or without the pipeline beside it, everything else is there, and all tests can be collected."""
    assert names_of_copy(tmp_path / "a", "llm") == set(plans.FOUND)
    assert names_of_copy(tmp_path / "b", "llm", "corpus_pipeline.py") == set(plans.FOUND)


def test_with_the_subpackage():
    assert set(plans.FOUND) < set(__spark_entry__.queries()) or not __spark_entry__.llm_queries
