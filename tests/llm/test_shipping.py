"""Corpus queries on executors that do not have the package: tasks start in another folder, without a path to it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from opsloom.session import get_spark
spark = get_spark("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
try:
    spark.range(1).mapInPandas(lambda b: (x.assign(id=__import__("opsloom") and 1) for x in b), "id long").collect()
except Exception as error:
    assert "No module named 'opsloom'" in str(error)
else:
    raise SystemExit("the package is importable in the tasks: this shows nothing")
for name in {["op1_adaptive_ann", "op3_language_id", "op5_exact_topk", "op7_best_fit_packing", "op9_simhash", "op11_prefix_trie", "op12_periodic_runs", "op13_token_files"]!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count(), name
print("all shipped")
"""


def test_queries_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all shipped" in done.stdout, done.stderr[-3000:]
