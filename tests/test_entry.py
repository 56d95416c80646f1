"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(e.__file__).parent


def test_names():
    assert e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 150 and all(r["n_answers"] == 1 for r in rows)


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data operators, with and without the pipeline's file, all other queries are there."""
    others = {k for k in e.queries() if not k.startswith("op") and k != "pipeline"}
    shutil.copytree(ROOT / "kgloom", tmp_path / "kgloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert set(said.stdout.split()) == others
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
