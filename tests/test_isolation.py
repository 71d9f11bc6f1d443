"""The engine without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def test_without_the_corpus_folders(tmp_path):
    """With the corpus folders gone the entry module has the other queries, whether the pipeline's file is left or not."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / name).exists():
            shutil.copy(HERE / name, tmp_path)
    shutil.copytree(HERE / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and 'flagship' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
