"""The package reaches Python workers that do not see the repository."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from convlake.functions import text as T
from convlake.session import configure
spark = configure(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate())
sys.stdout.write(spark.range(1).select(T.canonicalize_person(F.lit("Ing._Novák,_doc"))).first()[0] + "|")
sys.stdout.write(spark.range(1).select(T.canonicalize_person(F.lit("Ing._Nov\\u00e1k\\uff0c doc"))).first()[0])
"""


def test_functions_run_outside_the_repository(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout == "novak|novak", out.stderr[-2000:]
