"""Workers that cannot import the package: what runs in them travels with its code."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tests.conftest import SMALL

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # of the driver alone
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).config("spark.local.dir", {shared!r}).getOrCreate())
def absent(batches):
    import importlib.util
    import pandas as pd
    for _ in batches:
        yield pd.DataFrame({{"seen": [importlib.util.find_spec("weftwork") is not None]}})
assert not any(r["seen"] for r in spark.range(1).mapInPandas(absent, "seen boolean").collect())
import __spark_entry__
queries = __spark_entry__.queries()
for name in {names!r}:
    assert queries[name](spark, {data!r}).count() > 0, name
    print("ran", name)
"""
NAMES = ["op1_quality_rules", "op2_pack_sequences", "op3_cotrained_quality", "op9_simhash_classes", "op11_prefix_trie", "op12_nearest", "op13_ranked_search", "pipeline"]


@pytest.mark.parametrize("names", [NAMES], ids=["python"])
def test_workers_need_no_package(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=str(ROOT), shared=str(tmp_path), names=names, data=SMALL)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")] == names
