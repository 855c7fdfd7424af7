"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(len([k for k in q if k.startswith('op') or k == 'pipeline']))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    assert got.returncode == 0, got.stderr
    assert got.stdout.strip() == "0"


def test_the_rest_passes_without_them(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    run = lambda *more: subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *more], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    # All of them can be collected; those that take seconds are run, all others are run by the driver.
    found = run("--collect-only", "tests")
    assert found.returncode == 0, found.stdout[-2000:]
    got = run("tests/test_parse.py", "tests/test_operators.py", "tests/test_lexer.py", "tests/test_literal_index.py")
    assert got.returncode == 0, got.stdout[-2000:]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
