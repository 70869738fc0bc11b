"""Queries with Python tasks must run when the executors cannot import the
package (a driver started from another folder, nothing installed)."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_python_tasks_run_outside_the_repo(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        import __spark_entry__ as e
        q = e.queries()
        print("ROWS", q["knn"](spark, "/root/testdata/sf0.001").count(),
              q["embed_documents_stored"](spark, "/root/testdata/sf0.001").count(),
              q["kmeans_clusters"](spark, "/root/testdata/sf0.001").count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 2500 200 500" in out.stdout, out.stderr[-3000:]
