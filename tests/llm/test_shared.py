import os
import subprocess
import sys

from millrace.llm import _shared as S

PROGRAM = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from millrace.llm import _shared as S
from millrace.llm.near_duplicates import components
df = S.written(components(spark.range(9).selectExpr("id + 1 as a", "id as b")))
assert df.count() == 9
where = S.shared_dir(spark).removeprefix("file://")
held = os.listdir(where)
assert len([x for x in held if "edges" in x]) == 1, held
print(where)
if sys.argv[2] == "stop":
    spark.stop()
    left = [x for x in os.listdir(where) if x.startswith('millrace')] if os.path.exists(where) else []
    assert not left, left
"""


def run(folder, how):
    out = subprocess.run([sys.executable, "-c", PROGRAM, folder, how], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()[-1]


def test_no_table_is_left_after_the_session_or_the_driver(tmp_path):
    for how in ("stop", "leave"):
        where = run(f"file://{tmp_path}", how)
        assert not [x for x in os.listdir(where) if x.startswith("millrace")]


def test_discard(spark):
    before = S.tables()
    df = S.written(spark.range(3))
    (path,) = S.tables() - before - {S.shared_dir(spark)}
    assert df.count() == 3
    S.discard([path])
    assert path not in S.tables() and not os.path.exists(path.removeprefix("file://"))


def test_batches_and_free_names(spark):
    df = spark.createDataFrame([(1,)], "__H int")
    assert S.fresh(df, "h", "h") == ["__h_", "__h__"]
