"""The entry module: its contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_contract(spark):
    known, twins = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(twins) <= set(known) and "kv_live_snapshot" in twins
    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).columns == ["key", "value", "expiry_ns", "seq"]


def test_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "keystrata"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "keystrata" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 30, done.stderr
