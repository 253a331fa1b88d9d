"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def names_in(folder):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_without_the_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "tests", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    names = names_in(tmp_path / "repo")
    assert "groups_in_range" in names and not any(n.startswith("op") or n == "pipeline" for n in names if n != "ordered_head")
    assert names <= names_in(ROOT)


def test_library_does_not_import_the_corpus_operators():
    for path in (ROOT / "geoquilt").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"label", "n"}
