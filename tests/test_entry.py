import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).resolve().parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_imports_without_llm(tmp_path):
    for name in ("weftline", "__spark_entry__.py"):
        source, target = REPO / name, tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), sorted(q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_rest_never_names_llm():
    for path in (REPO / "weftline").rglob("*.py"):
        if "llm" not in path.relative_to(REPO / "weftline").parts:
            assert "weftline.llm" not in path.read_text(), path
