"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() >= 0 and "event_type" in df.columns


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "lodestream", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "lodestream").mkdir()
    for p in (ROOT / "lodestream").iterdir():
        if p.name != "llm":
            (tmp_path / "lodestream" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hourly_features' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
