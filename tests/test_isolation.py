"""The entry without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


def copied(folder: Path, *absent: str) -> Path:
    without = lambda at, names: [n for n in names if n in (".git", "__pycache__") or str((Path(at) / n).relative_to(REPO)) in absent]
    return Path(shutil.copytree(REPO, folder / "copy", ignore=without))


def imported(folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120, env={"PYTHONPATH": ".", "PATH": "/usr/bin:/bin"})


@pytest.mark.parametrize("absent", [("tallybook/llm", "tests/llm"), ("tallybook/llm", "tests/llm", "corpus_pipeline.py")])
@pytest.mark.parametrize("leftover", [False, True])
def test_entry_imports_without_the_subpackage(tmp_path, absent, leftover):
    folder = copied(tmp_path, *absent)
    if leftover:
        (folder / "tallybook/llm/__pycache__").mkdir(parents=True)
    done = imported(folder)
    assert done.returncode == 0, done.stderr
    count, optional, named = done.stdout.split()
    assert int(count) > 100 and optional == "False" and named == "True"


def test_a_broken_module_is_not_swallowed(tmp_path):
    folder = copied(tmp_path, "tests/llm")
    package = folder / "tallybook/llm"
    if not package.exists():
        pytest.skip("the subpackage is absent")
    (package / "queries.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in imported(folder).stderr
