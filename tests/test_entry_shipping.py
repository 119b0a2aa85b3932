"""The entry module works when imported from another working directory: the package is
shipped to the Python workers instead of relying on their current directory."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(REPO, '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", m.entry(spark).count())
print("PANEL", m.queries()["g12_selfcheck_group"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="consonance-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 10" in out.stdout, out.stderr[-2000:]
    assert "PANEL" in out.stdout, out.stderr[-2000:]
