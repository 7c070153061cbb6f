import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
conf = {{
    "spark.master": "local-cluster[2,1,512]", "spark.executor.memory": "512m", "spark.driver.memory": "512m", "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://{tmp}/c", "spark.driver.extraJavaOptions": "-XX:ErrorFile={tmp}/jvm-%p.log",
}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__ as e
for _ in range(2):
    print("rows", e.queries()["dom_tokens"](spark, {data!r}).count())
"""


def test_kernels_run_where_executors_lack_the_package(tmp_path, small):
    """The whole environment, but for what would show the package to the executors; a JVM's own log is part of a failure."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": f"{tmp_path}/w", "SPARK_LOCAL_DIRS": f"{tmp_path}/l"}
    (tmp_path / "cwd").mkdir()
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), tmp=tmp_path, data=small)], cwd=tmp_path / "cwd", env=env, capture_output=True, text=True, timeout=300)
    logs = "\n".join(p.read_text(errors="replace")[:2000] for p in tmp_path.glob("jvm-*.log"))
    assert done.returncode == 0, f"{done.stderr[:3000]}\n...\n{done.stderr[-3000:]}\n{logs}"
    counts = [x for x in done.stdout.splitlines() if x.startswith("rows")]
    assert len(counts) == 2 and counts[0] == counts[1] != "rows 0"
