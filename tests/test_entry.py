"""The entry module without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith(('op1_', 'pipeline')) for n in q))"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_the_rest_stands_alone(tmp_path, pipeline_too):
    shutil.copytree(f"{ROOT}/tierstats", tmp_path / "tierstats", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *([] if pipeline_too else ["corpus_pipeline.py"])]:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    n_queries, n_oracles, corpus = out.stdout.split()
    assert int(n_queries) > 180 and int(n_oracles) > 150 and corpus == "False"
