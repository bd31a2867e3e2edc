"""The entry points stand without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/lodestead", tmp_path / "lodestead", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(k.startswith('op') or k == 'pipeline' for k in q), set(o) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for pipeline in (False, True):  # the pipeline may be there although what it needs is not
        if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        found = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert found.returncode == 0, found.stderr
        n, twins, any_corpus, within = found.stdout.split()
        assert int(n) > 60 and int(twins) > 60 and any_corpus == "False" and within == "True"
