"""The entry works without the optional operators: their folders, or a package they need."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"


def _run(folder, code=COUNT):
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


@pytest.fixture
def copy(tmp_path):
    """The repository without the optional folders."""
    for name in ("__spark_entry__.py", "cartwheel"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    return tmp_path


def test_without_the_optional_folders(copy):
    queries, oracle, optional = _run(copy)
    assert queries == oracle and int(queries) >= 68 and optional == "False"


@pytest.mark.parametrize("package", ["zstandard", "duckdb", "xxhash"])
def test_without_a_package_they_need(copy, package):
    code = f"import sys; sys.modules[{package!r}] = None; sys.path.insert(0, {ROOT!r}); " + COUNT
    assert _run(ROOT, code) == _run(copy)
