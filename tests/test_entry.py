import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_flagship_query(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "rank", "word", "weight"] and df.count() > 0


def test_sql_only_for_queries():
    assert not __spark_entry__.oracle_sql().keys() - __spark_entry__.queries().keys()


def test_without_the_llm_folders(tmp_path):
    """What remains imports, and has the core's queries."""
    from velumra.plans import queries

    shutil.copytree(REPO / "velumra", tmp_path / "velumra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == sorted(queries.QUERIES), said.stderr


def test_core_does_not_know_the_llm_package():
    for path in (REPO / "velumra").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
