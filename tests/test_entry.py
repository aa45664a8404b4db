"""The driver's contract, with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "NDVI" in df.columns


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_text_operators(tmp_path):
    """What stands when the subpackage, its tests and the pipeline are gone."""
    for f in ("__spark_entry__.py", "terradelta"):
        src = ROOT / f
        if src.is_dir():
            shutil.copytree(src, tmp_path / f, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / f)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'monthly_median_composite' in n and 'pipeline' not in n and not any(x.startswith('op') and x[2].isdigit() for x in n); print(len(n))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) > 50
