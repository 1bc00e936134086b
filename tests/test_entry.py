import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LLM = (ROOT / "terralex" / "llm").is_dir()


def test_entry_and_names(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "score" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [["terralex/llm"], ["corpus_pipeline.py"], ["terralex/llm", "corpus_pipeline.py"]])
def test_the_rest_imports_without_training_text_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *(Path(g).name for g in gone)))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    names = ran.stdout.split()
    assert "bm25f_search" in names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == (LLM and "terralex/llm" not in gone)
