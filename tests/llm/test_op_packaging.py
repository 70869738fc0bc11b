"""The operators' Python tasks must run on executors that cannot import the
package (a driver started from another folder, nothing installed)."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES = ["op2_edit_fingerprints", "op6_repeated_spans", "op7_simhash_ball", "op8_decontaminate", "op9_pieces",
           "op10_language_id", "op11_best_fit_packing", "op12_spelling_variants", "op13_periodic_runs", "pipeline"]


def test_python_tasks_run_outside_the_repo(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").getOrCreate())
        import __spark_entry__ as e
        q = e.queries()
        for name in {QUERIES!r}:
            print("ROWS", name, q[name](spark, "/root/testdata/sf0.001").count() > 0, flush=True)
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=900)
    assert [line for line in out.stdout.splitlines() if line.startswith("ROWS")] == [
        f"ROWS {name} True" for name in QUERIES], out.stderr[-3000:]
