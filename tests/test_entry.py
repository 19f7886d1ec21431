import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part(tmp_path):
    """The engine imports and offers its own queries where the training-data operators are missing."""
    for name in ("__spark_entry__.py", "lexspan"):
        (tmp_path / name).symlink_to(ROOT / name) if name != "lexspan" else (tmp_path / name).mkdir()
    for p in (ROOT / "lexspan").iterdir():
        if p.name != "llm":
            (tmp_path / "lexspan" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'phrase_search' in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "lexspan").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
