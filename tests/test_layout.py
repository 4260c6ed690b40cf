"""The rest works without the corpus subpackage, and nothing else imports it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "eventloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "eventloom.llm" not in p.read_text(), p


def test_entry_without_the_subpackage(tmp_path):
    for name in ("eventloom", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op1_mix' not in q and len(q) > 100; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin:" + str(Path(sys.executable).parent)})
