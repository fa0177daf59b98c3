import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as e
assert len(e.entry(spark).toPandas()) == 6
assert set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()["assign_nearest"](spark, "/root/testdata/sf0.001").toPandas()))
"""


def test_tasks_run_where_the_package_is_not_on_the_path(tmp_path):
    """Workers start in another folder and only get what travels with the job."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.strip().splitlines()[-1]) > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """In a copy without them the entry imports, nothing else asks for them, and queries run."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py",
                                                              "__pycache__", "*.json"))
    script = SCRIPT.format(root=str(copy)) + """
assert not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
assert "crowdgap.llm" not in sys.modules
import crowdgap
assert crowdgap.__file__.startswith({copy!r})
""".format(copy=str(copy))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
